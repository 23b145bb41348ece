"""Words of whole texts as 64-bit hashes, read off the bytes of an Arrow column without an object for each word.

A word is a maximal run of bytes other than ASCII white space, which is a run of characters
other than those, for UTF-8.  Its hash is a polynomial over its bytes, from prefix sums; a word of ``PIECE``
bytes or more is hashed alone.  Memory beside the column is bounded by ``PIECE`` bytes and the words' own arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes worked on at a time.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each bit of the 64-bit numbers over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse, modulo 2 to the 64."""
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def prefix(values: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Prefix sums, from 0, of values weighed with the base's powers."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * scale[: len(values)], out=out[1:])
    return out


def _hashed(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and stop byte of each word; no word goes on over a place of ``begins``."""
    solid = np.r_[False, ~_SPACE[data], False]
    edge = solid[1:] & ~solid[:-1]
    edge[begins] = solid[1:][begins]
    first = np.flatnonzero(edge[:-1])
    last = solid[:-1] & ~solid[1:]
    last[begins] = solid[:-1][begins]
    stop = np.flatnonzero(last)
    scale, inverse = powers(PIECE + 1)
    sums = prefix(_BYTE[data], scale)
    h = (sums[stop] - sums[first]) * inverse[first]
    return mixed(h + (stop - first).astype(np.uint64)), first, stop


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another in ``data`` (text i from ``offsets[i]`` to ``offsets[i + 1]``): each word's hash,
    first byte, stop byte, and the number of words up to the start of each text."""
    n = len(data)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < n:
        stop = min(at + PIECE, n)
        if stop - at == PIECE:
            space = np.flatnonzero(_SPACE[data[at:stop]])
            text = np.searchsorted(offsets, stop, side="right") - 1  # the last text that starts here or before
            cut = max(at + int(space[-1]) + 1 if len(space) else at, int(offsets[text]))
            if cut <= at:  # one word that does not end here
                end = int(offsets[np.searchsorted(offsets, at, side="right")])
                while stop < end and not _SPACE[data[stop : stop + PIECE]].any():
                    stop = min(stop + PIECE, end)
                space = np.flatnonzero(_SPACE[data[stop : min(stop + PIECE, end)]])
                stop = stop + int(space[0]) if len(space) else end
                found.append((np.array([xxhash.xxh64_intdigest(data[at:stop].tobytes())], np.uint64), np.array([at]), np.array([stop])))
                at = stop
                continue
            stop = cut
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, side="right")] - at
        h, first, last = _hashed(data[at:stop], inside)
        found.append((h, first + at, last + at))
        at = stop
    h, first, last = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
    return h.astype(np.uint64, copy=False), first, last, np.searchsorted(first, offsets)


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string column's rows in slices of about ``most`` bytes, of one row at least: number of the first row, bytes, offsets."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        own = offsets[at : to + 1]
        yield at, whole[own[0] : own[-1]], own - own[0]
        at = to

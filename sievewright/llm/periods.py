"""Periodic runs of words, found on a harmonic grid by prefix hashes.

A *run* is a stretch of consecutive words whose smallest period is q (words q apart are the same), at least
``max(least, 2 * q)`` words long, that no neighbouring word extends keeping the period.

A run of period p has p words or more of which each equals the one p words on, so one of them stands at a multiple
of p.  The grid has, for each period p up to half the text, the places 0, p, 2p, ...: n * ln(n) pairs of a period and a place
in all.  For all pairs at once, of many texts at once, the *longest common extension* of (place, place + p) is binary-searched forwards and
backwards on prefix hashes modulo two primes; the two extensions are the run.  Runs of one stretch are one
run, of the smallest period.  The words of what is left are then compared themselves; should a hash
have lied, the text is searched again with other bases.

Scale: a narrow map, one row in and one row out.  Pairs are worked on ``PAIRS`` at a time, texts in slices of
``words.PIECE`` bytes (a longer text alone), so beside the text's own words memory is bounded.

Defined results: a null text has no words, as has an empty one or one of white space: no runs, collapsed
to the empty string.  Equal texts have equal results, repeated rows each their own; an empty table gives an empty table.  Other
columns pass through; a clash with an added column's name raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, absent, need
from .words import PIECE, hashed_words, pieces

#: Words of a run at least.
LEAST = 12
#: Pairs of a period and a place worked on at a time (the grid of one period of one text may be larger).
PAIRS = 1 << 19
_PRIMES = np.array([[2_147_483_629], [2_147_483_587]], np.int64)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _prefix_hashes(ids: np.ndarray, attempt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of prefix hashes, and of the bases' powers."""
    rng = np.random.default_rng(attempt)
    base = rng.integers(1 << 20, 1 << 30, (2, 1))
    power = np.ones((2, len(ids) + 1), np.int64)
    done = 1
    while done <= len(ids):  # powers by doubling
        more = min(done, len(ids) + 1 - done)
        power[:, done : done + more] = power[:, :more] * (power[:, done - 1 : done] * base % _PRIMES) % _PRIMES
        done += more
    value = (ids[None, :] % _PRIMES.astype(np.uint64)).astype(np.int64)
    sums = np.zeros((2, len(ids) + 1), np.int64)
    np.cumsum(value * power[:, :-1] % _PRIMES, axis=1, out=sums[:, 1:])
    return sums % _PRIMES, power


def _extension(sums: np.ndarray, power: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, ahead: bool) -> np.ndarray:
    """For all pairs at once the most words, up to ``room``, that agree after (before) ``at`` and ``at + period``."""
    least, most = np.zeros(len(at), np.int64), room.copy()
    shift = power[:, period]
    open_ = np.flatnonzero(least < most)
    step = 0
    while len(open_):
        # first short stretches, then halves of what is left
        low, high = least[open_], most[open_]
        half = np.minimum((low + high + 1) // 2, low + (1 << min(2 * step, 40)))
        i = at[open_] if ahead else at[open_] - half
        j = i + period[open_]
        same = ((sums[:, i + half] - sums[:, i]) % _PRIMES * shift[:, open_] % _PRIMES == (sums[:, j + half] - sums[:, j]) % _PRIMES).all(axis=0)
        least[open_] = np.where(same, half, low)
        most[open_] = np.where(same, high, half - 1)
        open_ = open_[least[open_] < most[open_]]
        step += 1
    return least


def grid_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, attempt: int = 0) -> np.ndarray:
    """Runs in the texts whose words' ids stand from ``bounds[i]`` to ``bounds[i + 1]``: rows (start, stop, period), sorted."""
    sums, power = _prefix_hashes(ids, attempt)
    n = np.diff(bounds)
    halves = n // 2
    text = np.repeat(np.arange(len(n)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    places = (n[text] - 1) // period
    ends = np.cumsum(places)
    found = [np.empty((0, 3), np.int64)]
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - places[at] + PAIRS, side="right")))
        count = places[at:to]
        which = np.repeat(np.arange(at, to), count)
        p = period[which]
        g = bounds[text[which]] + (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * p
        kept = np.flatnonzero(ids[g] == ids[g + p])
        g, p, own = g[kept], p[kept], text[which[kept]]
        more = _extension(sums, power, g + 1, p, bounds[own + 1] - g - p - 1, True)
        before = _extension(sums, power, g, p, g - bounds[own], False)
        start, stop = g - before, g + p + 1 + more
        long = stop - start >= np.maximum(least, 2 * p)
        if long.any():
            found.append(np.unique(np.stack([start[long], stop[long], p[long]], axis=1), axis=0))
        at = to
    every = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(every), bool)  # rows of one stretch stand together, the smallest period first
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    return every[first]


def _true(words: list[bytes], runs: np.ndarray) -> bool:
    """Whether the words themselves have these periods, and lose them beyond."""
    n = len(words)
    return all(words[s : e - p] == words[s + p : e] and (s == 0 or words[s - 1] != words[s - 1 + p]) and (e == n or words[e] != words[e - p]) for s, e, p in runs.tolist())


def verified(words: list[bytes], runs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The runs (start, stop, period) if their words bear them out; else those that other bases find."""
    attempt = 0
    while not _true(words, runs):
        attempt += 1
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
        runs = grid_runs(ids, np.array([0, len(words)]), least, attempt)
    return runs


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words less those that stand in any run after its first period, joined by spaces."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def find(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Add ``runs``: array of (start, length, period) by start, then period, in words from 0; ``collapsed``: the text's words less
    each run's repetitions, joined by spaces; and ``n_words``."""
    need(df, text)
    absent(df, "runs", "collapsed", "n_words")
    place = df.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in pieces(batch.column(place)):
                ids, _, _, bounds = hashed_words(data, offsets)
                every = grid_runs(ids, bounds, least)
                edges = np.searchsorted(every[:, 0], bounds)
                rows, collapsed = [], []
                for i in range(len(offsets) - 1):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    runs = every[edges[i] : edges[i + 1]] - [bounds[i], bounds[i], 0]
                    if len(runs):
                        runs = verified(words, runs, least)
                        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                        collapsed.append(collapse(words, runs))
                    else:
                        collapsed.append(b" ".join(words))
                    rows.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs.tolist()])
                out = [pa.array(rows, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string()), pa.array(np.diff(bounds), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(rows)).columns, *out], names=names)

    names = [*df.columns, "runs", "collapsed", "n_words"]
    added = T.StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, n_words bigint")
    return df.mapInArrow(search, T.StructType([*df.schema.fields, *added.fields]))


def looped(text: Column, start: Column, period: Column) -> Column:
    """The text's words joined by spaces, each word from ``start`` on replaced so that the words repeat with ``period``."""

    def repeat(bound: Column) -> Column:
        words, a, p = bound["words"], bound["start"], bound["period"]
        places = F.sequence(F.lit(0), F.size(words) - 1)
        return F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # bound in an array of one, so that the words are cut once and not for each place
    return F.transform(F.array(F.struct(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"), start.alias("start"), period.alias("period"))), repeat)[0]

"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

``encode`` cuts the rows into *chunks* of about ``CHUNK_CHARS`` characters and each text
into pre-tokens (the matches of the tokenizer's pattern).  A chunk has a list of its
distinct pre-tokens, and at each position a pre-token's rank in that list by
frequency.  Two shuffles follow:

1. the lists, dealt out by the words' hash into ``BUCKETS`` buckets a shuffle partition, one partition for
   every ``PARTITION`` bytes of text or more, as the session asks:
   a bucket's task sees all chunks' words of that hash and encodes each distinct
   one once, by rank merges;
2. the ids of each bucket's words, back to the chunks, which put them in place of the
   ranks and cut the result at the documents' ends.

The positions travel as variable-length ranks beside the words, addressed by chunk, so
a frequent word costs one entry a chunk and no bucket gets more than its share of words.
A task holds one chunk, or one bucket's dictionary, at a time.  All blocks are
compressed.

``decode`` joins the token-byte table: a gather over the vocabulary's concatenated
bytes, of a size that the vocabulary fixes.

Token ids are binary columns of little-endian unsigned 32-bit integers.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated
rows are encoded each; special tokens' strings are ordinary text.  The rows' order
within a partition must be the same when a task runs again, as it is for files.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import itertools
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import absent, need, tasks_for

#: Characters of text in a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 14_000_000
#: Positions of a chunk worked on at a time.
PIECE = 1 << 18
#: Buckets of words for each shuffle partition that the session asks for.
BUCKETS = 2
#: Bytes of text for each shuffle partition, and the most of them: with more, a chunk's lists for a bucket have few words.
PARTITION, MOST_PARTITIONS = 128 << 20, 8_192
_BLOCKS = "chunk string, bucket int, words binary, ranks binary, docs array<struct<doc: bigint, end: bigint>>"
_DOCS = pa.list_(pa.struct([("doc", pa.int64()), ("end", pa.int64())]))


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes in id order, each id's start and length."""
    found = {i: token for token, i in ranks(path).items()}
    tokens = [found.get(i, b"") for i in range(max(found) + 1)]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + sizes[i]`` for every i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pack(numbers: np.ndarray) -> np.ndarray:
    """Each number as 7-bit groups, low ones first, the last with a clear high bit."""
    numbers = numbers.astype(np.uint64)
    groups = np.ones(len(numbers), np.int64)
    for s in (7, 14, 21, 28, 35):
        groups += numbers >> np.uint64(s) > 0
    ends = np.cumsum(groups)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for s in range(int(groups.max(initial=0))):
        has = groups > s
        more = (groups[has] > s + 1).astype(np.uint8) << 7
        out[(ends - groups)[has] + s] = (numbers[has] >> np.uint64(7 * s) & np.uint64(127)).astype(np.uint8) | more
    return out


def unpack(packed: np.ndarray) -> np.ndarray:
    """The numbers under 2^32 that ``pack`` has written, some at a time."""
    ends = packed < 128
    out = np.empty(int(np.count_nonzero(ends)), np.uint32)
    at = done = 0
    while at < len(packed):
        last = np.flatnonzero(ends[at : at + 4 * PIECE])
        part = packed[at : at + int(last[-1]) + 1]
        first = np.r_[0, last[:-1] + 1]
        found = (part[first] & 127).astype(np.uint32)
        for s in range(1, int((last - first).max()) + 1):
            has = last - first >= s
            found[has] |= (part[first[has] + s] & 127).astype(np.uint32) << np.uint32(7 * s)
        out[done : done + len(found)] = found
        at, done = at + len(part), done + len(found)
    return out


def _squeeze(*parts: np.ndarray | bytes) -> bytes:
    """Compressed byte blocks, each after its length."""
    blocks = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(b"".join([np.array([len(x) for x in blocks], "<u8").tobytes(), *blocks]), 3)


def _expand(data: bytes, parts: int) -> list[np.ndarray]:
    whole = np.frombuffer(zstandard.decompress(data), np.uint8)
    sizes = whole[: 8 * parts].view("<u8").astype(np.int64)
    return np.split(whole[8 * parts :], np.cumsum(sizes)[:-1])


def _blocks(chunk: str, rows: list[tuple[int, bytes | None, bytes | None, list | None]]) -> pa.RecordBatch:
    bucket, words, ranks, docs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(rows), pa.string()), pa.array(bucket, pa.int32()), pa.array(words, pa.binary()), pa.array(ranks, pa.binary()), pa.array(docs, _DOCS)],
        names=["chunk", "bucket", "words", "ranks", "docs"],
    )


def _split(pattern: str, buckets: int):
    """Map over rows ``(id, text)``: for each chunk a block of ranks (bucket -1) and a block of words for each bucket."""
    from pyspark import TaskContext

    find = regex.compile(pattern).findall

    def blocks(name: str, words: list[str], of: np.ndarray, docs: list[dict]) -> pa.RecordBatch:
        by_rank = np.argsort(-np.bincount(of, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        ranks = b"".join(pack(rank[of[at : at + PIECE]]).tobytes() for at in range(0, len(of), PIECE))
        raw = [w.encode() for w in words]
        words.clear()
        own = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in raw), np.int32, len(raw))[by_rank]
        rows: list[tuple] = [(-1, None, _squeeze(ranks, own.astype(np.min_scalar_type(buckets))), docs)]
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(buckets + 1))
        for b in range(buckets):
            listed = [raw[i] for i in by_rank[order[edges[b] : edges[b + 1]]].tolist()]
            if listed:
                rows.append((b, _squeeze(pack(np.fromiter(map(len, listed), np.int64, len(listed))), b"".join(listed)), None, None))
        return _blocks(name, rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        code: dict[str, int] = {}
        codes, docs, chars = array("I"), [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal code, codes, docs, chars, number
            words, of, ends = list(code), np.frombuffer(codes, np.uint32), docs
            code, codes, docs, chars, number = {}, array("I"), [], 0, number + 1
            return blocks(f"{part}:{number}", words, of, ends)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                if docs and chars + len(text) > CHUNK_CHARS:
                    yield chunk()
                    _trim()
                codes.extend([code.setdefault(w, len(code)) for w in find(text)])
                docs.append({"doc": doc.as_py(), "end": len(codes)})
                chars += len(text)
        if docs:
            yield chunk()
        _trim()

    return split


def _encode_words(path: str, pattern: str):
    """Map over blocks sorted by bucket: words become ids, each distinct word of a bucket once."""

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoding(path, pattern)._encode_single_piece
        bucket, known = -1, {}
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, own, words, ranks, docs = (batch.column(i)[row].as_py() for i in range(5))
                if own < 0:
                    yield _blocks(chunk, [(own, None, ranks, docs)])
                    continue
                if own != bucket:
                    bucket, known = own, {}
                sizes, raw = _expand(words, 2)
                ends, raw = np.cumsum(unpack(sizes)).tolist(), raw.tobytes()
                found = []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = merge(word)
                    found.append(ids)
                counts = pack(np.fromiter(map(len, found), np.int64, len(found)))
                yield _blocks(chunk, [(own, _squeeze(counts, pack(np.fromiter(itertools.chain.from_iterable(found), np.int64))), None, None)])
        known = {}
        _trim()

    return encode_words


def _trim() -> None:
    """Give freed memory back, as an idle worker keeps its process."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def decoded(path: str, ids: np.ndarray) -> np.ndarray:
    """The bytes of tokens, one after another: the join with the token-byte table."""
    table, starts, sizes = token_bytes(path)
    return table[spread(starts[ids], sizes[ids])]


def _packed(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Bytes cut at offsets, as a binary column."""
    blob = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return blob.cast(pa.binary())


def _reassemble(buckets: int, path: str | None):
    """Map over blocks sorted by chunk and bucket: each document's ids, and their decoding if there is a path."""

    def whole(ranks: bytes, docs: list[dict], blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        packed, own = _expand(ranks, 2)
        at, own = unpack(packed), own.view(np.min_scalar_type(buckets))
        order = np.argsort(own, kind="stable")  # ranks as the buckets list them
        listed = [_expand(b, 2) for b in blocks]
        none = np.empty(0, np.uint32)
        sizes = np.concatenate([unpack(x) for x, _ in listed]) if listed else none
        ids = np.concatenate([unpack(x) for _, x in listed]) if listed else none
        starts = np.empty(len(own), np.int64)
        counts = np.empty(len(own), np.int64)
        starts[order], counts[order] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        first = 0
        while first < len(docs):
            begin, last = docs[first - 1]["end"] if first else 0, first + 1
            while last < len(docs) and docs[last]["end"] - begin <= PIECE:
                last += 1
            some = docs[first:last]
            here = at[begin : some[-1]["end"]]
            each = counts[here]
            tokens = ids[spread(starts[here], each)]
            cuts = np.r_[0, np.cumsum(each)][np.array([0, *(d["end"] - begin for d in some)])]
            columns = [pa.array([d["doc"] for d in some], pa.int64()), _packed(tokens, cuts * 4)]
            if path:
                columns.append(_packed(decoded(path, tokens), np.r_[0, np.cumsum(token_bytes(path)[2][tokens])][cuts]))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])
            first = last

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[bytes, list[dict]] | None = None
        blocks: list[bytes] = []
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(1)[row].as_py() < 0:
                    if head:
                        yield from whole(*head, blocks)
                        _trim()
                    head, blocks = (batch.column(3)[row].as_py(), batch.column(4)[row].as_py()), []
                else:
                    blocks.append(batch.column(2)[row].as_py())
        if head:
            yield from whole(*head, blocks)
        head, blocks = None, []
        _trim()

    return reassemble


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", round_trip: bool = False) -> DataFrame:
    """``(id_col, ids)`` for each row of ``df``; ``id_col`` is a bigint.

    With ``round_trip`` also ``decoded``, as ``decode`` adds it, in the task that has the ids at hand.
    """
    need(df, id_col, text)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(tasks_for(df.sparkSession), min(MOST_PARTITIONS, -(-size // PARTITION)))
    buckets = max(BUCKETS * tasks_for(df.sparkSession), tasks)
    split = rows.mapInArrow(_split(pattern, buckets), _BLOCKS)
    # words go to their bucket, ranks wherever their chunk's name falls
    to = F.when(F.col("bucket") < 0, F.xxhash64("chunk")).otherwise(F.col("bucket").cast("long"))
    dealt = split.withColumn("to", to).repartition(tasks, "to").sortWithinPartitions("bucket").drop("to")
    known = dealt.mapInArrow(_encode_words(path, pattern), _BLOCKS)
    back = known.repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket")
    return back.mapInArrow(
        _reassemble(buckets, path if round_trip else None), "id bigint, ids binary" + ", decoded binary" * round_trip
    ).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add ``name``: the bytes of the tokens in the packed column ``ids``; null stays null."""
    need(df, ids)
    absent(df, name)

    @F.pandas_udf("binary")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([None if packed is None else decoded(path, np.frombuffer(packed, "<u4")).tobytes() for packed in column], dtype=object)

    return df.withColumn(name, of(F.col(ids)))

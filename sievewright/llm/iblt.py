"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs, cut at sentence ends and at ``LONGEST`` characters, are hashed
to 64-bit digests (a repeated piece's later occurrences have digests of their own).
Each digest enters ``HASHES`` cells of a sketch; a cell has a count, the XOR of its digests
and the XOR of their checks.  Sketches of two versions subtract cell by cell, what they
share cancels, and *peeling* cells of one digest recovers the digests
that only one version has.  Where cells stay unpeeled the sketch was too small for the
difference: both versions are sketched again ``GROWTH`` times larger.

``fingerprint`` is the sketch of ``CELLS`` cells in base64; ``reconcile`` compares
a text with others and gives the number of differing digests and the likeness
``(shared) / (all)``.  ``successors`` pairs each row with the next by id.

Scale: ``reconcile`` is a narrow map.  ``successors`` moves each text once, to the range
of ids it belongs to (ranges are approximate quantiles, ``RANGES`` a shuffle partition; an id, null too, with more rows
than a range has its rows dealt out by their texts' hash); the first row of a range is sent to the range before it as well.

Defined results: a null text is an empty one; an empty text has an empty sketch; two
empty texts have likeness 1; equal texts have equal fingerprints.  Null ids come first,
equal ids are ordered by their texts' hash; the last row's successor is the first row, a lone
row's is itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import absent, need, tasks_for

HASHES, CELLS, GROWTH, LONGEST, RANGES = 3, 30, 4, 64, 3
#: Rows compared at a time, and cells held at a time.
ROWS, MOST_CELLS = 128, 1 << 18
_PIECE = re.compile(r"[^\n.!?]{1,%d}[.!?\n]*|[.!?\n]+" % LONGEST)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def digests(text: str | None) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraph pieces."""
    seen: dict[str, int] = {}
    out = []
    for piece in _PIECE.findall(text or ""):
        n = seen.get(piece, 0)
        seen[piece] = n + 1
        out.append(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), n))
    return np.unique(np.array(out, np.uint64))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _A
    h = (h ^ (h >> np.uint64(33))) * _B
    return h ^ (h >> np.uint64(29))


def _checks(h: np.ndarray) -> np.ndarray:
    return (_mixed(h, 17) >> np.uint64(32)).astype(np.uint32)


def _cells(h: np.ndarray, size: int) -> np.ndarray:
    """Each digest's ``HASHES`` cells, one in each part of the table."""
    part = size // HASHES
    return np.stack([(_mixed(h, size * HASHES + i) % np.uint64(part)).astype(np.int64) + i * part for i in range(HASHES)])


def sketches(versions: list[np.ndarray], size: int = CELLS) -> np.ndarray:
    """A row of cells for each array of digests."""
    cells = np.zeros(len(versions) * size, _CELL)
    h = np.concatenate(versions) if versions else np.empty(0, np.uint64)
    if len(h):
        row = np.repeat(np.arange(len(versions)) * size, [len(v) for v in versions])
        at = (_cells(h, size) + row).ravel()
        cells["count"] = np.bincount(at, minlength=len(cells))
        np.bitwise_xor.at(cells["key"], at, np.tile(h, HASHES))
        np.bitwise_xor.at(cells["check"], at, np.tile(_checks(h), HASHES))
    return cells.reshape(len(versions), size)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.copy()
    out["count"] -= b["count"]
    out["key"] ^= b["key"]
    out["check"] ^= b["check"]
    return out


def peel(cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each row of subtracted cells the digests that only the first and only the second version has; None if cells are left."""
    rows, size = cells.shape
    count, key, check = (np.ascontiguousarray(cells[name]).ravel() for name in ("count", "key", "check"))
    found_row, found_key, found_sign = [], [], []
    maybe = np.arange(rows * size)
    while len(maybe):
        pure = maybe[np.abs(count[maybe]) == 1]
        pure = pure[_checks(key[pure]) == check[pure]]
        if not len(pure):
            break
        order = np.lexsort((pure // size, key[pure]))
        pure = pure[order]
        row, h = pure // size, key[pure]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        row, h, sign = row[new], h[new], count[pure][new]
        found_row.append(row)
        found_key.append(h)
        found_sign.append(sign)
        maybe = (_cells(h, size) + row * size).ravel()
        np.subtract.at(count, maybe, np.tile(sign, HASHES))
        np.bitwise_xor.at(key, maybe, np.tile(h, HASHES))
        np.bitwise_xor.at(check, maybe, np.tile(_checks(h), HASHES))
        maybe = np.unique(maybe)
    left = (count.reshape(rows, size) != 0).any(axis=1) | (key.reshape(rows, size) != 0).any(axis=1)
    row, h, sign = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_row, found_key, found_sign))
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(rows + 1))
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for i in range(rows):
        mine = order[edges[i] : edges[i + 1]]
        out.append(None if left[i] else (h[mine][sign[mine] > 0], h[mine][sign[mine] < 0]))
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests only in ``a`` and only in ``b``, by sketches of growing size."""
    out: list = [None] * len(a)
    waiting, size = list(range(len(a))), CELLS
    last = CELLS * GROWTH**3 * (1 + max((len(x) + len(y) for x, y in zip(a, b, strict=True)), default=0))
    while waiting and size <= last:
        # where the counts alone show that this size cannot do, it is not tried
        now = [i for i in waiting if size >= 2 * abs(len(a[i]) - len(b[i]))]
        step = max(1, MOST_CELLS // size)
        for at in range(0, len(now), step):
            some = now[at : at + step]
            for i, found in zip(some, peel(subtract(sketches([a[i] for i in some], size), sketches([b[i] for i in some], size))), strict=True):
                out[i] = found
        waiting = [i for i in waiting if out[i] is None]
        size *= GROWTH
    for i in waiting:  # digests that collide in cells and checks at every size
        out[i] = np.setdiff1d(a[i], b[i]), np.setdiff1d(b[i], a[i])
    return out


def likeness(n_a: int, n_b: int, differing: int) -> float:
    return (n_a + n_b - differing) / (n_a + n_b + differing) if n_a + n_b else 1.0


def encoded(versions: list[np.ndarray]) -> list[str]:
    """Fingerprint strings: the number of digests, then the cells of the smallest sketch."""
    return [f"{len(h)}:{base64.b64encode(cells.tobytes()).decode()}" for h, cells in zip(versions, sketches(versions), strict=True)]


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add ``name``: the fingerprint of the column ``text``."""
    need(df, text)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(encoded([digests(t) for t in texts]), dtype=object)

    return df.withColumn(name, of(F.col(text)))


_COMPARED = "struct<fingerprint: string, likeness: double, only_base: array<bigint>, only_other: array<bigint>>"


def reconcile(df: DataFrame, base: str, others: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``fingerprint`` of the column ``base`` and, for each ``name: column`` of
    ``others``, the struct ``name (fingerprint, likeness, only_base, only_other)`` with the recovered digests."""
    need(df, base, *others.values(), *keep)
    absent(df.select(*keep), "fingerprint", *others)
    n = len(keep)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("fingerprint", pa.string()), ("likeness", pa.float64()), ("only_base", pa.list_(pa.int64())), ("only_other", pa.list_(pa.int64()))])
        known: dict[str | None, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                columns = [batch.column(n + i).to_pylist() for i in range(1 + len(others))]
                # a text is often another's successor: its digests are kept until the next rows
                fresh = {t: known[t] if t in known else digests(t) for t in dict.fromkeys(t for c in columns for t in c)}
                known = fresh
                first = [fresh[t] for t in columns[0]]
                out = [pa.array(encoded(first), pa.string())]
                for column in columns[1:]:
                    other = [fresh[t] for t in column]
                    found = differences(first, other)
                    like = [likeness(len(x), len(y), len(p) + len(q)) for x, y, (p, q) in zip(first, other, found, strict=True)]
                    lists = [pa.array([np.sort(f[i]).view(np.int64) for f in found], pa.list_(pa.int64())) for i in (0, 1)]
                    out.append(pa.StructArray.from_arrays([pa.array(encoded(other), pa.string()), pa.array(like, pa.float64()), *lists], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *out], names=[*keep, "fingerprint", *others])

    added = T.StructType.fromDDL(", ".join(["fingerprint string", *(f"`{name}` {_COMPARED}" for name in others)]))
    kept = T.StructType([*df.select(*keep).schema.fields, *added.fields])
    return df.select(*keep, F.col(base).alias("_base"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(others.values()))).mapInArrow(compare, kept)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over rows sorted by (range, sent ahead, id): each row with the next of its range."""
    last: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for place, ahead, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = text.as_py()
            if last is not None and last[0] == place:
                out.append((last[1], last[2], text))
            # of rows sent ahead only the first has a predecessor
            last = None if ahead else (place, doc, text)
            if len(out) == ROWS:
                yield _paired(out)
                out = []
        if out:
            yield _paired(out)


def _paired(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, following = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(following, pa.string())], names=["id", "text", "next_text"])


def successors(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, text, next_text)``: each row and the text of the next row by ascending id."""
    need(df, id_col, text)
    spark = df.sparkSession
    tasks = tasks_for(spark)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("at"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = RANGES * tasks
    # an id that is the quantile of several ranges has rows for as many: they are dealt by their texts' hash
    bounds, repeats = np.unique(np.array(rows.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)), np.float64), return_counts=True)
    below = np.cumsum(repeats) - repeats

    @F.pandas_udf("int")
    def place(at: pd.Series, tie: pd.Series) -> pd.Series:
        x = at.to_numpy(np.float64)
        i = np.searchsorted(bounds, x, side="right") - 1
        if not len(bounds):
            return pd.Series(np.zeros(len(x), np.int32))
        own = np.floor((tie.to_numpy(np.float64) / 2.0**64 + 0.5) * repeats[i]).clip(0, repeats[i] - 1)
        found = np.where(bounds[i] == x, below[i] + 1 + own, below[i] + repeats[i])
        return pd.Series(np.where(i < 0, 0, found).astype(np.int32))

    placed = rows.withColumn("place", place("at", "tie"))
    first = {r["place"]: tuple(r["least"]) for r in placed.groupBy("place").agg(F.min(F.struct("at", "tie")).alias("least")).collect()}  # one row for each range
    ranges = sorted(first)
    before = {first[p]: ranges[i - 1] for i, p in enumerate(ranges)}  # the range that a range's first row is sent to as well

    @F.pandas_udf("array<int>")
    def sent(at: pd.Series, tie: pd.Series, own: pd.Series) -> pd.Series:
        """Twice the range, and one more where the row is sent ahead."""
        return pd.Series([[2 * p, 2 * before[a, t] + 1] if (a, t) in before else [2 * p] for a, t, p in zip(at, tie, own, strict=True)], dtype=object)

    moved = placed.withColumn("to", F.explode(sent("at", "tie", "place"))).select(
        F.shiftright("to", 1).alias("range"), (F.col("to") % 2 == 1).alias("ahead"), "id", "text", "at", "tie"
    )
    ordered = moved.repartition(tasks, "range").sortWithinPartitions("range", "ahead", "at", "tie").select("range", "ahead", "id", "text")
    return ordered.mapInArrow(_pairs, "id bigint, text string, next_text string").withColumnRenamed("id", id_col)

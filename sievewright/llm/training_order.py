"""Training-order materialisation: every sequence at a pseudo-random global slot of fixed-stride shards.

``write_order`` cuts each row's token ids into records of ``length`` ids, numbered without gaps.  A keyed
Feistel network over the next power of four, cycle-walking until the number is in range, permutes the
numbers into *slots*: a bijection that any task computes by itself.  The records are dealt out in
contiguous ranges of slots, by number and not by hash, travelling in compressed blocks of one range each; a range's task
puts them at their slots, which needs no sort, and writes its shards as raw files:
slot ``s`` is at byte ``(s mod per_shard) * stride`` of the file of shard ``s // per_shard``.  A row for each shard goes to
a table of ``MANIFEST`` beside them.  ``read_order`` reads any range of slots, seeking by stride, so a run can resume anywhere.

A record is the row's id, its part and its number of ids (little-endian 64-bit), then ``length`` ids of ``width`` bytes,
padded with zeros.  Null ids are written as the least 64-bit integer.

Recovery: a shard is written beside its name and then renamed, so a task that runs again, or twice, leaves one whole file of the
same bytes.  Numbering takes two jobs over the input; a task that does not meet the rows that the first job counted in its partition
fails, so the input must come in the same order when it is read again, as files do.

Defined results: a null or empty column of ids is one record of no ids; repeated rows have records of
their own; an empty table has no shard; only the named columns are read, so others cannot clash.  Memory: one Arrow batch
and ``BLOCK`` bytes of records where they are cut, one range of slots (``RANGE`` bytes and a shard) where they are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, tasks_for

ROUNDS, KEY = 6, 0x5EED
NO_ID = -(1 << 63)
#: Bytes of records that a range of slots has at most, unless the session asks for more ranges.
RANGE = 48 << 20
#: Bytes of records that a task gathers before it packs them by ranges.
BLOCK = 8 << 20
MANIFEST = "shard bigint, first_slot bigint, records bigint, length int, width int, per_shard bigint, file string"
RECORDS = "slot bigint, id bigint, part bigint, n bigint, ids binary"


def slots(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permutation of ``0 .. n - 1`` under a key: Feistel rounds, walking while out of range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (1 << 64) - 1) for r in range(1, ROUNDS + 1)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xFF51AFD7ED558CCD)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ (f >> np.uint64(29) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def record_type(length: int, width: int) -> np.dtype:
    """A record's layout; its size is the stride."""
    return np.dtype([("id", "<i8"), ("part", "<i8"), ("n", "<i8"), ("ids", f"<u{width}", length)])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path)


def _bounds(span: int, spans: int, shards: int) -> tuple[int, int]:
    """The first shard of a range of slots, and the first of the next: shard ``s`` is in range ``s * spans // shards``."""
    return -(-span * shards // spans), -(-(span + 1) * shards // spans)


def _numbered(starts: dict[int, tuple[int, int, int]], total: int, spans: int, per_shard: int, kind: np.dtype, key: int):
    """Map over rows ``(id, ids, mark)``: blocks of their slots and records, each of one range."""
    length, width = kind["ids"].shape[0], kind["ids"].base.itemsize
    shards = -(-total // per_shard)

    def packed(numbers: np.ndarray, record: np.ndarray) -> pa.RecordBatch:
        slot = slots(numbers, total, key)
        span = slot // per_shard * spans // shards
        order = np.argsort(span, kind="stable")
        found, first = np.unique(span[order], return_index=True)
        blocks = [zstandard.compress(b"".join((slot[g].data, record[g].view(np.uint8).data)), 3) for g in np.split(order, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], names=["span", "block"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        first, wanted, marked = starts.get(partition, (0, 0, 0))
        at, seen, held, begun = first, 0, [], first
        for batch in batches:
            seen ^= int(np.bitwise_xor.reduce(batch.column(2).to_numpy(zero_copy_only=False))) if batch.num_rows else 0
            for doc, given in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(given.as_py() or b"", f"<u{width}")
                n = max(1, -(-len(ids) // length))
                if at + n > first + wanted:
                    break
                record = np.zeros(n, kind)
                record["id"], record["part"] = NO_ID if doc is None else doc, np.arange(n)
                record["n"] = np.clip(len(ids) - length * np.arange(n), 0, length)
                record["ids"] = np.pad(ids, (0, n * length - len(ids))).reshape(n, length)
                held.append(record)
                at += n
                if (at - begun) * kind.itemsize >= BLOCK:
                    yield packed(np.arange(begun, at), np.concatenate(held))
                    held, begun = [], at
        if held:
            yield packed(np.arange(begun, at), np.concatenate(held))
        if (at - first, seen) != (wanted, marked):
            raise RuntimeError(f"partition {partition} is not as it was counted: the input must come in the same order when it is read again, as files do")

    return records


def _written(path: str, total: int, spans: int, per_shard: int, kind: np.dtype):
    """Map over blocks sorted by range: shards' files, and their rows of the manifest."""
    length, width = kind["ids"].shape[0], kind["ids"].base.itemsize
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = located(path)

        def done(span: int, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            begin, end = _bounds(span, spans, -(-total // per_shard))
            first, stop = begin * per_shard, min(end * per_shard, total)
            records, there = np.zeros(stop - first, kind), np.zeros(stop - first, bool)
            for block in blocks:
                raw = zstandard.decompress(block)
                n = len(raw) // (8 + kind.itemsize)
                at = np.frombuffer(raw, "<i8", n) - first
                records[at], there[at] = np.frombuffer(raw, kind, n, 8 * n), True
                del raw
            if not there.all():
                raise RuntimeError(f"slots of range {span} have no record")
            for shard in range(begin, end):
                some = records[(shard - begin) * per_shard :][:per_shard]
                name, beside = f"{root}/shard-{shard:010d}.bin", f"{root}/_{uuid.uuid4().hex}"
                with where.open_output_stream(beside) as out:
                    out.write(pa.py_buffer(some.view(np.uint8)))
                if where.get_file_info(name).type == fs.FileType.File:
                    where.delete_file(name)
                where.move(beside, name)
                row = [shard, shard * per_shard, len(some), length, width, per_shard, f"shard-{shard:010d}.bin"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        rows = ((span, block.as_py()) for batch in batches for span, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for span, group in groupby(rows, key=lambda row: row[0]):
            yield from done(span, (block for _, block in group))

    return write


def write_order(df: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids", width: int = 4, length: int = 1_024, per_shard: int = 2_048, key: int = KEY) -> DataFrame:
    """Write all sequences of ``df`` in training order under ``path``, a folder that all executors share; the manifest.

    ``ids`` is a binary column of little-endian ``width``-byte integers, as ``bpe.encode`` gives with 4.
    """
    need(df, id_col, ids)
    if width not in (1, 2, 4):
        raise ValueError("width is 1, 2 or 4")
    spark = df.sparkSession
    kind = record_type(length, width)
    size = F.coalesce(F.octet_length(ids), F.lit(0))
    parts = F.greatest(F.ceil(size / (length * width)), F.lit(1))
    # of a row's place in its partition, its id and its ids: rows in another order have other marks
    mark = F.xxhash64(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(ids))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids).alias("ids"), mark.alias("mark"))
    counted = df.select(F.spark_partition_id().alias("p"), parts.alias("n"), mark.alias("mark"))
    # one row for each partition
    counts = {r["p"]: (int(r["n"]), r["mark"]) for r in counted.groupBy("p").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark")).collect()}
    total, starts = 0, {}
    for p in sorted(counts):
        starts[p], total = (total, *counts[p]), total + counts[p][0]
    where, root = located(path)
    where.create_dir(root)
    shards = -(-total // per_shard)
    spans = max(1, min(shards, max(tasks_for(spark), -(-total * kind.itemsize // RANGE))))
    placed = rows.mapInArrow(_numbered(starts, total, spans, per_shard, kind, key), "span int, block binary")
    ranges = placed.repartitionById(spans, "span").sortWithinPartitions("span")
    ranges.mapInArrow(_written(path, total, spans, per_shard, kind), MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_order(spark: SparkSession, path: str, from_slot: int = 0, to_slot: int | None = None) -> DataFrame:
    """``(slot, id, part, n, ids)`` of the records from ``from_slot`` up to ``to_slot``, in order within a shard; ``ids`` without padding.

    A shard is read from the first byte that is asked on; others are not opened.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter(F.col("first_slot") + F.col("records") > from_slot)
    if to_slot is not None:
        manifest = manifest.filter(F.col("first_slot") < to_slot)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = located(path)
        for batch in batches:
            for row in batch.to_pylist():
                kind = record_type(row["length"], row["width"])
                first = max(from_slot, row["first_slot"])
                stop = row["first_slot"] + row["records"] if to_slot is None else min(to_slot, row["first_slot"] + row["records"])
                with where.open_input_file(f"{root}/{row['file']}") as f:
                    f.seek((first - row["first_slot"]) * kind.itemsize)
                    record = np.frombuffer(f.read((stop - first) * kind.itemsize), kind)
                if len(record) != stop - first:
                    raise RuntimeError(f"{row['file']} is short")
                ids = [r[:n].tobytes() for r, n in zip(record["ids"], record["n"].tolist(), strict=True)]
                doc = pa.array(record["id"].copy(), mask=record["id"] == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, stop)), doc, pa.array(record["part"].copy()), pa.array(record["n"].copy()), pa.array(ids, pa.binary())], names=["slot", "id", "part", "n", "ids"]
                )

    return manifest.repartition(tasks_for(spark), "shard").mapInArrow(read, RECORDS)

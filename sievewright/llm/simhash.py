"""SimHash near-duplicates through BK-trees.

``fingerprint`` adds a SimHash column, ``link`` finds all pairs of distinct
fingerprints within a Hamming radius up to connectivity, ``components`` joins
links into groups and ``near_duplicates`` does all three.

*Shards.*  A BK-tree over all fingerprints would have to be broadcast whole, and
at radius 4 of 64 bits it prunes little.  So the trees are sharded by *probes*:
masks that select some of the bits.  Fingerprints that agree under a probe meet
in one shard, which builds its own tree, children keyed by their integer Hamming
distance to the parent, and each of them asks the tree, following only the edges within
the radius of its distance.  The bits are cut into ``radius + agree`` runs, with a probe for every
``agree`` of them: two fingerprints within the radius agree on that many runs whole, so no link is
lost.  ``agree`` is the least number at which a shard can have ``TREE`` fingerprints or fewer, and a probe looks at
only so many bits of each run as that takes: the probes are as few, and the trees as large, as the number of fingerprints allows.
Nothing is broadcast.  A shard of more than ``SHARD`` fingerprints is split by hash; each two
of its parts meet in a block of their own, so a task never holds more than two parts.

All trees of a batch of shards grow and are searched level by level together, in arrays; the
search holds at most ``FRONT`` steps at a time.  Where connectivity is all that is asked, a subtree
that already hangs together through its parent is not searched by those that hang
together with the parent too, and a shard yields its components as stars, not its pairs: the links'
number follows the fingerprints'.

*Similarity.*  ``representatives`` links texts by the Jaccard similarity of their
sets of shingles.  Sets meet where one of ``BANDS`` keys agrees, each of ``WIDTH`` of
the set's minima under multiplied hashes: a pair at 0.8 is missed once in 9,000.  In ``STARS``
rounds the sets of a key meet one of theirs; what is similar to that one hangs together.  Keys whose sets still hang apart
make *families*: sets that share such keys, directly or through others.  A family is a shard that each of its sets is sent to once, whatever the
keys they share; it asks its BK-tree of 128-bit fingerprints, at a radius that a pair of the asked similarity hardly ever exceeds.  Every
candidate is decided by the two sets themselves, in the shard: what leaves it is links, as stars, so that a large family whose members are just
below the asked similarity does not make all its pairs as rows.  A family of more than ``FAMILY`` sets is split as a large shard is.

Defined results: words are separated by ASCII white space, A-Z are lower-cased; a
null or empty text and one without words have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle.  The component of
rows whose ids are all null is null.  Repeated rows fall in one component.  An empty table gives
no rows.  Other columns pass through ``representatives``, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import absent, cut, dealt_join, free, need, reread, spread_join, tasks_for

SEED = 42
#: Most fingerprints of a part of a shard; fingerprints of a shard as probes are chosen; steps of a search held at a time.
SHARD, TREE, FRONT = 16_384, 1_024, 1 << 20
#: A part of the fingerprints tells which shards are large.
PART = 16
#: Keys of a set of shingles, and the minima of each.
BANDS, WIDTH = 30, 6
#: Standard deviations above the mean distance that a fingerprint may be off.
SPREAD = 4
#: Rounds in which the sets of a key meet one of theirs; most sets of a part of a family; shingles compared at a time.
STARS, FAMILY, SLICE = 2, 1_024, 4_096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HASHES = 1 << 16


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 hash bits for a lane beyond the first (SplitMix64)."""
    if not lane:
        return h
    z = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashed(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes of all shingles, repeated ones too, some at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)
    whole, h64 = b" ".join(words), xxhash.xxh64_intdigest
    starts, stops = (ends - sizes - 1)[: len(words) - k + 1], ends[k - 1 :] - 1
    for at in range(0, len(starts), _HASHES):
        span = zip(starts[at : at + _HASHES].tolist(), stops[at : at + _HASHES].tolist(), strict=True)
        yield np.fromiter((h64(whole[a:b], SEED) for a, b in span), np.uint64, min(_HASHES, len(starts) - at))


def _majority(hashes: Iterator[np.ndarray], lanes: int) -> list[int]:
    """Unsigned 64-bit lanes; a bit is 1 if it is set in over half the hashes."""
    counts, n = np.zeros((lanes, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for lane in range(lanes):
            bits = np.unpackbits(_mix(h, lane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def simhash(text: str | None, shingle: int, lanes: int = 1) -> list[int]:
    """Unsigned 64-bit lanes; a bit is 1 if it is set in over half the shingles' hashes."""
    return _majority(_hashed(text, shingle), lanes)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashed(text, shingle)]))


_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys; two sets have each of them in common with a chance of their similarity to the power ``WIDTH``."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2_048):
        least = np.minimum(least, (hashes[None, at : at + 2_048] * _TIMES).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, WIDTH))], np.uint64)


def fingerprint(df: DataFrame, text: str = "text", shingle: int = 5, bits: int = 64, name: str = "fp") -> DataFrame:
    """Add ``name``: array<bigint> of ``bits / 64`` lanes (the unsigned lanes' bits)."""
    need(df, text)
    absent(df, name)
    if bits % 64 or bits <= 0:
        raise ValueError("bits is a positive multiple of 64")
    lanes = bits // 64

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(simhash(t, shingle, lanes), np.uint64).view(np.int64) for t in texts], dtype=object)

    return df.withColumn(name, of(F.col(text)))


def exact_probes(radius: int, bits: int = 64, agree: int = 2, taken: int | None = None) -> list[int]:
    """Bit masks; fingerprints within ``radius`` agree under at least one.  ``taken`` bits of each run are looked at, all by default:
    fingerprints that agree on a run agree on any part of it."""
    edges = np.linspace(0, bits, radius + agree + 1).astype(int).tolist()
    runs = [(1 << (b if taken is None else min(b, a + taken))) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(some) for some in itertools.combinations(runs, agree)]


def agreement(n: int, radius: int, bits: int = 64) -> int:
    """The least number of runs to agree on at which a shard of ``n`` even fingerprints can have at most ``TREE``."""
    return next((k for k in range(radius) if n <= TREE << int(bits * k / (radius + k))), radius)


def taken_bits(n: int, agree: int, radius: int, bits: int = 64) -> int:
    """Bits of each run that a probe looks at: the fewest at which a shard of ``n`` even fingerprints has at most ``TREE``."""
    wanted = max(0, math.ceil(math.log2(max(1, n) / TREE)))
    return min(-(-wanted // agree), bits // (radius + agree)) if agree else 0


def probes_for(n: int, radius: int, bits: int = 64) -> list[int]:
    """The probes of ``n`` fingerprints."""
    agree = agreement(n, radius, bits)
    return exact_probes(radius, bits, agree, taken_bits(n, agree, radius, bits))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, masks: list[int], lanes: int) -> Column:
    """One key for each probe."""
    part = lambda mask, lane: fp[lane].bitwiseAND(F.lit(_signed(mask >> 64 * lane & (1 << 64) - 1)))
    return F.array(*(F.xxhash64(F.lit(i), *(part(m, lane) for lane in range(lanes))) for i, m in enumerate(masks)))


class Groups:
    """Components of a shard's fingerprints, as links come in."""

    def __init__(self, n: int) -> None:
        self.label, self.waiting, self.n = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.n += len(a)
        if self.n > 1_000_000:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, self.n = [], 0
            while len(a):
                la, lb = self.label[a], self.label[b]
                apart = la != lb
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
                while True:
                    up = self.label[self.label]
                    if (up == self.label).all():
                        break
                    self.label = up
        return self.label


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


class Forest:
    """BK-trees of many shards: ``x`` are rows of lanes, ``shard`` their shards' numbers, ascending from 0.

    Level by level: ``roots`` are the nodes of a level, ``children`` the keys ``node * width + distance`` of the
    next level's nodes, in order, so the children within a range of distances are a range of places.
    """

    def __init__(self, x: np.ndarray, shard: np.ndarray) -> None:
        self.x, self.width = x, 64 * x.shape[1] + 1
        self.roots: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        #: each row's distance to its parent and the parent; a root of a shard is its own
        self.parent, self.edge = np.arange(len(x)), np.zeros(len(x), np.int64)
        self.steps = 0
        rows, node = np.arange(len(x)), shard
        while len(rows):
            first = np.r_[True, node[1:] != node[:-1]]
            roots = rows[first]
            self.roots.append(roots)
            rows, node = rows[~first], node[~first]
            self.parent[rows] = roots[node]
            self.edge[rows] = apart(x[rows], x[roots[node]])
            keys = node * self.width + self.edge[rows]
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            children, node = np.unique(keys, return_inverse=True)
            self.children.append(children)

    def near(self, asking: np.ndarray, shard: np.ndarray, radius: int, connect: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asking row, row) of a shard within ``radius``; with ``connect`` only enough to connect them,
        as rows hang together with a parent that is within the radius."""
        # a piece of work: rows asking, the first node of each and how many nodes of the level it asks
        work = [(0, asking, shard, np.ones(len(asking), np.int64))] if len(asking) else []
        while work:
            level, rows, start, count = work.pop()
            ends = np.cumsum(count)
            if len(rows) > 1 and ends[-1] > FRONT:
                half = min(max(1, int(np.searchsorted(ends, ends[-1] // 2))), len(rows) - 1)
                work += [(level, rows[half:], start[half:], count[half:]), (level, rows[:half], start[:half], count[:half])]
                continue
            node = np.arange(ends[-1]) + np.repeat(start - (ends - count), count)
            rows = np.repeat(rows, count)
            root = self.roots[level][node]
            far = apart(self.x[rows], self.x[root]).astype(np.int64)
            self.steps += len(rows)
            held = far <= radius
            yield rows[held], root[held]
            if level + 1 < len(self.roots):
                base, keys = node * self.width, self.children[level]
                least = np.where(held & connect, radius + 1, np.maximum(far - radius, 0))
                low = np.searchsorted(keys, base + least)
                n = np.searchsorted(keys, base + np.minimum(far + radius, self.width - 1), side="right") - low
                more = n > 0
                if more.any():
                    work.append((level + 1, rows[more], low[more], n[more]))


def shard_groups(x: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """For each row the smallest row of its shard it is linked to within ``radius`` steps, and the steps of the search."""
    forest, groups = Forest(x, shard), Groups(len(x))
    close = np.flatnonzero((forest.edge <= radius) & (forest.parent != np.arange(len(x))))
    groups.add(close, forest.parent[close])
    for a, b in forest.near(np.arange(len(x)), shard, radius, connect=True):
        groups.add(a, b)
    return groups.settle(), forest.steps


def _shards(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Columns of whole shards, some at a time, of rows sorted by their first ``keys`` columns; the shards' numbers come first."""
    held: list[pa.RecordBatch] = []

    def whole() -> list[np.ndarray | pa.Array]:
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([table.column(i).to_numpy() for i in range(keys)], axis=1)
        columns = [table.column(i).combine_chunks() for i in range(keys, table.num_columns)]
        return [np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)]), *columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        edge = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        if edge:
            held.append(batch.slice(0, edge))
            yield whole()
            held = []
        held.append(batch.slice(edge))
    if held:
        yield whole()


def _lanes_of(column: pa.Array, lanes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)


def _shard_links(radius: int, lanes: int):
    """A map over rows sorted by shard: links of the fingerprints of each, found through its tree."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x, i: pa.FixedSizeListArray.from_arrays(pa.array(x[i].view(np.int64).ravel()), lanes).cast(pa.list_(pa.int64()))
        for shard, fp in _shards(batches, 3):
            x = _lanes_of(fp, lanes)
            label, _ = shard_groups(x, shard, radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([of(x, label[linked]), of(x, linked)], names=["a", "b"])

    return links


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of sorted sets share, by products of slices of their membership."""
    sizes = [len(x) for x in sets]
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(of, minlength=len(values)) > 1  # of an element of one set nothing is shared
    column = np.cumsum(shared) - 1
    kept = shared[of]
    owner, column = owner[kept], column[of[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        low, high = np.searchsorted(column, [at, at + SLICE])
        member = np.zeros((len(sets), min(SLICE, int(column[-1]) + 1 - at)), np.float32)
        member[owner[low:high], column[low:high] - at] = 1
        out += member @ member.T
    return out


def _family_links(radius: int, lanes: int, similarity: float):
    """A map over sets ``(key, i, j, label, fp, set)`` sorted by shard: links of similar sets of different labels that a tree finds."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, node, label, fp, content in _shards(batches, 3):
            node, label = (c.to_numpy(zero_copy_only=False) for c in (node, label))
            x, groups = _lanes_of(fp, lanes), Groups(len(node))
            values, edges = content.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(content.value_lengths().to_numpy(zero_copy_only=False))]
            starts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            for first, last in itertools.pairwise(starts.tolist()):
                n = last - first
                own = label[first:last]
                if (own == own[0]).all():
                    continue
                sets = [values[edges[k] : edges[k + 1]] for k in range(first, last)]
                sizes, common = np.array([len(v) for v in sets]), overlaps(sets)
                rows = np.arange(n)
                for a, b in Forest(x[first:last], np.zeros(n, np.int64)).near(rows, np.zeros(n, np.int64), radius):
                    both = common[a, b]
                    kept = (own[a] != own[b]) & (both >= similarity * (sizes[a] + sizes[b] - both) - 1e-6)
                    groups.add(first + a[kept], first + b[kept])
            root = groups.settle()
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[linked]]), pa.array(node[linked])], names=["a", "b"])

    return links


def blocks(keyed: DataFrame, by: str, most: int, sampled: int) -> DataFrame:
    """``keyed``, of columns ``key`` and others, with ``i, j``: the two parts of its shard that meet in a block.

    ``by`` names the column that deals a shard of more than ``most`` rows into parts.
    """
    # which shards to split is estimated from one in ``sampled`` rows; the pairs are the same however they are split
    part = keyed.filter(F.pmod(F.xxhash64(by, F.lit(SEED)), F.lit(sampled)) == 0).groupBy("key").agg((F.count("*") * sampled).alias("n"))
    large = cut(part.filter(F.col("n") > most).select(F.col("key").alias("large"), F.ceil(F.col("n") / most).cast("int").alias("parts")))
    if large.isEmpty():
        return keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    parts = F.coalesce("parts", F.lit(1))
    placed = keyed.join(large, keyed.key == large.large, "left").withColumn("_parts", parts).drop("large", "parts")
    placed = placed.withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return placed.withColumns({"i": F.least("_part", "_other"), "j": F.greatest("_part", "_other")}).drop("_parts", "_part", "_other")


def link(fps: DataFrame, radius: int, masks: list[int], lanes: int = 1, fp: str = "fp") -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough to connect all within ``radius`` under a common probe."""
    keyed = fps.select(F.explode(_keys(F.col(fp), masks, lanes)).alias("key"), F.col(fp).alias("fp"))
    shards = blocks(keyed, "fp", SHARD, PART).select("key", "i", "j", "fp").repartition(tasks_for(fps.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return shards.mapInArrow(_shard_links(radius, lanes), "a array<bigint>, b array<bigint>").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a bigint, b bigint)``; the root is the component's smallest node.

    Alternating large-star and small-star steps; each round is cut by a checkpoint and shuffles its edges twice.
    """
    node = Window.partitionBy("a")
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.filter("a <> b").select("a", "b")
    while True:
        both = edges.select(F.explode(turned).alias("e")).select("e.*").repartition("a").distinct()
        both = cut(both.withColumns({"low": F.min("b").over(node), "high": F.max("b").over(node)}))
        # Finished when every node but the roots has one neighbour, its root.
        if both.filter("low < a and low < high").isEmpty():
            return both.filter("b = low").select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        large = both.filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        small = large.withColumn("m", F.min("b").over(node))
        edges = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b")


def grouped(df: DataFrame, id_col: str, text: str, shingle: int, bits: int, radius: int) -> DataFrame:
    """``(id, fp, component)`` for each row: its fingerprint and its group's smallest id."""
    need(df, id_col, text)
    lanes = bits // 64
    named = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = cut(fingerprint(named, "text", shingle, bits).select("id", "fp"))
    of = lambda c: F.col(c)[0] if lanes == 1 else F.xxhash64(c)
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", of("fp")))
    edges = link(fps, radius, probes_for(fps.count(), radius, bits), lanes)
    roots = components(edges.select(of("a").alias("a"), of("b").alias("b")))
    linked = cut(fps.join(roots, "node").select("root", "fp", "least"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    joined = spread_join(linked, least, "root").select("fp", "component")
    alone = fps.join(roots, "node", "left_anti").select("fp", F.col("least").alias("component"))
    return spread_join(rows, joined.union(alone), "fp").select("id", "fp", "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = 64, radius: int = 4) -> DataFrame:
    """``(id_col, fp, component)`` for each row; the component is the smallest id reachable over links.

    All pairs within ``radius`` are linked, by exact probes.
    """
    return grouped(df, id_col, text, shingle, bits, radius).withColumnRenamed("id", id_col)


def radius_of(similarity: float, bits: int) -> int:
    """A Hamming distance that two texts whose shingle sets have this Jaccard similarity hardly ever exceed:
    the mean and ``SPREAD`` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def _marks(shingle: int, lanes: int):
    """A text's set of shingles as a hash, its size, its fingerprint and its keys."""

    @F.pandas_udf("node bigint, n int, fp array<bigint>, keys array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame(
            {
                "node": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
                "n": np.array([len(s) for s in sets], np.int32),
                "fp": [np.array(_majority(iter([s]), lanes), np.uint64).view(np.int64) for s in sets],
                "keys": [band_keys(s).view(np.int64) for s in sets],
            }
        )

    return of


def similar(sets: DataFrame, texts: Callable[[DataFrame], DataFrame], shingle: int, similarity: float, bits: int) -> DataFrame:
    """``(node, root)`` of the sets linked to others by a Jaccard similarity of ``similarity`` or more.

    ``sets`` are ``(node, n, fp, keys)``, one row a set; ``texts`` gives ``(node, text)``, a text of each set of a table of ``node``.
    """
    lanes, spark = bits // 64, sets.sparkSession
    radius = radius_of(similarity, bits)
    # a set holds the keys that others have too
    keyed = sets.select("node", F.explode("keys").alias("key")).withColumn("count", F.count("*").over(Window.partitionBy("key")))
    held = keyed.filter("count > 1").groupBy("node").agg(F.collect_list("key").alias("keys"))
    held = cut(held.join(sets.select("node", "n", "fp"), "node"))

    @F.pandas_udf("array<bigint>")
    def set_of(some: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in some], dtype=object)

    shelf = reread(texts(held.select("node")).select("node", set_of("text").alias("set")), "shingles")

    distance = sum((F.bit_count(F.col("fp")[i].bitwiseXOR(F.col("hub_fp")[i])) for i in range(lanes)), F.lit(0))
    near = (F.least("n", "hub_n") / F.greatest("n", "hub_n") >= similarity) & (distance <= radius)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` whose sets are similar; many may have the same ``a``."""
        pairs = cut(pairs.distinct())
        both = spread_join(pairs, shelf.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(shelf.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return cut(both.filter(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"))

    total = held.agg(F.sum(F.size("keys"))).first()[0] or 0
    labels, links = None, []
    for turn in range(STARS + 1):
        labelled = held.withColumn("label", F.col("node")) if labels is None else cut(held.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
        posted = labelled.select(F.explode("keys").alias("key"), "node", "n", "fp", "label")
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "fp", "label"))
        apart_still = posted.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), hub.alias("hub"), F.count("*").alias("rows")).filter("low < high")
        apart_still = cut(apart_still.select("key", "rows", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "fp", "label"))))
        if apart_still.isEmpty():
            break
        if turn < STARS:
            starred = dealt_join(posted, apart_still, ["key"], "rows", total).filter((F.col("label") != F.col("hub_label")) & near)
            links = [verified(starred.select(F.col("hub_node").alias("a"), F.col("node").alias("b")))]
        else:
            # a set's family is the component of the keys that it shares with sets that it does not hang together with
            met_apart = dealt_join(posted.select("key", "node"), apart_still.select("key", "rows", "hub_node"), ["key"], "rows", total)
            families = components(met_apart.select(F.col("hub_node").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("key"))
            members = cut(labelled.select("node", "label", "fp").join(families, "node"))
            shards = blocks(members.select("key", "node", "label", "fp"), "node", FAMILY, 1).join(shelf, "node").select("key", "i", "j", "node", "label", "fp", "set")
            shards = shards.repartition(tasks_for(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
            links = [shards.mapInArrow(_family_links(radius, lanes, similarity), "a bigint, b bigint")]
        # what hangs together already goes on as stars
        stars = [] if labels is None else [labels.select(F.col("root").alias("a"), F.col("node").alias("b"))]
        labels = components(reduce(DataFrame.union, links + stars))
    return labels if labels is not None else sets.select("node", F.col("node").alias("root")).limit(0)


def representatives(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 128) -> DataFrame:
    """The rows of ``df``, one of each group of near-duplicates: the one with the smallest id, null ids first.

    Texts are linked if the Jaccard similarity of their shingle sets is ``similarity`` or more; rows
    with the same set are one group, those without words too.
    """
    need(df, id_col, text)
    ident, tie = free(df, "_id"), free(df, "_tie")
    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    marked = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("tie"), _marks(shingle, bits // 64)(F.col(text)).alias("m"))
    sets = cut(marked.select("id", "tie", "m.*").groupBy("node").agg(F.min(F.struct("id", "tie")).alias("row"), *(F.first(c).alias(c) for c in ("n", "fp", "keys"))))
    keyed = df.withColumns({ident: own(id_col), tie: F.xxhash64(F.col(text))})
    of_row = sets.select("node", own("row.id").alias(ident), F.col("row.tie").alias(tie))

    def texts(nodes: DataFrame) -> DataFrame:
        # a set has one pair of keys, and a pair one text, so that repeated rows are dropped where the join has brought them
        wanted = of_row.join(nodes, "node", "left_semi")
        return keyed.select(ident, tie, F.col(text).alias("text")).join(wanted, [ident, tie]).dropDuplicates([ident, tie]).select("node", "text")

    roots = similar(sets.filter("n > 0").drop("row"), texts, shingle, similarity, bits)
    rooted = sets.select("node", "row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("row").alias("kept")).select(own("kept.id").alias(ident), F.col("kept.tie").alias(tie))
    # repeated rows are equal in both keys; the join has already brought them together
    return keyed.join(kept, [ident, tie], "left_semi").dropDuplicates([ident, tie]).drop(ident, tie)

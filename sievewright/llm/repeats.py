"""Substring dedup by seed and extend: words covered by passages that an earlier document has too.

A *window* is ``WINDOW`` consecutive words of one document.  A word goes if a window covers it whose words
stand, in this order, in a document of a smaller id too; so the stretches that go are the maximal repeats of
``WINDOW`` words or more.

*Seeds*: each window has an anchor, the run of ``GRAM`` words in it with the least hash (winnowing), which the
window's words alone decide.  Consecutive windows of one anchor are its *context*: the anchor extended both ways as far as
windows that it stands for go.  A document gives one row for each distinct (anchor, context).

*Extension*, without a pair of documents for each link:

1. an anchor has an earliest document.  A row of a later one with the same context as the earliest is a repeat as a
   whole: all windows of the context go;
2. where contexts of one anchor differ, they agree up to some word on either side: those rows, and the earliest document's, are
   taken apart into their windows, and the earliest document of each window decides;
3. a document's windows that go are put together to maximal stretches, and cut out.

Anchors, contexts and windows are compared as pairs of 64-bit hashes (anchor, context or window), 128 bits in all.

Scale: what is shuffled is a row of three numbers for each anchor, about one for fifteen words, and the windows of contested anchors;
the texts of documents that have such, and once more all texts with what goes.  No join makes more rows than it reads.  Anchors
and windows with more than one in ``common.HOT`` rows are dealt out under salts; what is broadcast is those keys, fewer than ``HOT``.  Texts are
worked on in slices of ``words.PIECE`` bytes, a longer one in stretches of ``STRETCH`` windows.

Defined results: a null text has no words and is kept as the empty string, as are empty texts and texts of white space; a text of fewer words than a window stays.
A row with a null id keeps its words, and is nobody's earlier document.  Rows of one id do not count against each
other; each is judged against smaller ids.  An empty table gives an empty table.  Other columns pass through; a clash with an added column's name
raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, absent, dealt_join, free, need, reread
from .words import PIECE, hashed_words, mixed, pieces, powers, prefix

#: Words of a window, and of an anchor in it.
WINDOW, GRAM = 50, 10
#: Windows of a very long text worked on at a time.
STRETCH = 1 << 18


class Anchors:
    """Anchors of texts: for each the text's number, its first and last window's start, the anchor's and the context's hash."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, window: int, gram: int):
        """Of texts whose words' hashes stand from ``bounds[i]`` to ``bounds[i + 1]``."""
        self.words, self.window, self.gram = words, window, gram
        parts = []
        if len(words) <= STRETCH + window - 1:
            parts.append(self._of(words, bounds))
        else:
            for i in range(len(bounds) - 1):
                for at in range(bounds[i], max(bounds[i] + 1, bounds[i + 1] - window + 1), STRETCH):
                    to = min(at + STRETCH + window - 1, bounds[i + 1])
                    text, first, last, gram_hash, context = self._of(words[at:to], np.array([0, to - at]))
                    parts.append((text + i, first + at, last + at, gram_hash, context))
        self.text, self.first, self.last, self.hash, self.context = (np.concatenate([p[k] for p in parts]) for k in range(5))

    def _of(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        window, gram = self.window, self.gram
        none = np.empty(0, np.int64)
        if len(words) < window:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        scale, inverse = powers(max(PIECE, STRETCH + window) + 1)
        sums = prefix(words, scale)
        grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(sums) - gram])
        # the place of the least, leftmost of equals, among the anchors of each window: by stretches of 1, 2, 4, ...
        best, size, width = np.arange(len(grams)), 1, window - gram + 1
        while size < width:
            step = min(size, width - size)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(grams[left] <= grams[right], left, right)
            size += step
        n = np.maximum(np.diff(bounds) - window + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + bounds[text]
        if not len(start):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        own = best[start]
        edge = np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1
        begin, end = np.r_[0, edge], np.r_[edge, len(own)] - 1
        first, last, at = start[begin], start[end], own[begin]
        shape = mixed((at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64) + np.uint64(1))
        context = mixed((sums[last + window] - sums[first]) * inverse[first] ^ shape)
        return text[begin], first, last, grams[at], context

    def windows(self, first: int, last: int) -> np.ndarray:
        """Hashes of the windows that start from ``first`` to ``last``."""
        scale, inverse = powers(max(PIECE, STRETCH + self.window) + 1)
        sums = prefix(self.words[first : last + self.window], scale)
        n = last - first + 1
        return mixed((sums[self.window :] - sums[: -self.window]) * inverse[:n])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _one_each(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return [c[new] for c in columns]


def seeds(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc, anchor, context)`` of the rows ``(doc, text)``, each once for a row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in pieces(batch.column(1)):
                words, _, _, bounds = hashed_words(data, offsets)
                found = Anchors(words, bounds, window, gram)
                doc, anchor, context = _one_each(ids[at + found.text], found.hash, found.context)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), _signed(anchor), _signed(context)], names=["doc", "anchor", "context"])

    return docs.mapInArrow(read, "doc bigint, anchor bigint, context bigint")


def _windows_of(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``(doc, anchor, window)`` of the contexts ``contested`` of the rows ``(doc, text, contested)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2)
            for at, data, offsets in pieces(batch.column(1)):
                words, _, _, bounds = hashed_words(data, offsets)
                found = Anchors(words, bounds, window, gram)
                edges = np.searchsorted(found.text, np.arange(len(offsets)))
                docs_, anchors, windows = [], [], []
                for i in range(len(offsets) - 1):
                    mine = slice(edges[i], edges[i + 1])
                    here = np.flatnonzero(np.isin(found.context[mine], wanted[at + i].values.to_numpy().view(np.uint64))) + edges[i]
                    for k in here[np.unique(found.context[here], return_index=True)[1]]:
                        w = found.windows(found.first[k], found.last[k])
                        windows.append(w)
                        anchors.append(np.full(len(w), found.hash[k]))
                        docs_.append(np.full(len(w), ids[at + i]))
                if docs_:
                    doc, anchor, w = _one_each(*(np.concatenate(c) for c in (docs_, anchors, windows)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), _signed(anchor), _signed(w)], names=["doc", "anchor", "window"])

    return docs.mapInArrow(read, "doc bigint, anchor bigint, window bigint")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each document of ``(doc, text)`` with any, hashes of the contexts and of the single windows that earlier ones have: ``(doc, contexts, windows)``."""
    rows = reread(seeds(docs, window, gram), "repeats-seeds")
    shared = rows.groupBy("anchor").agg(
        F.min("doc").alias("earliest"), F.max("doc").alias("latest"), F.min_by("context", "doc").alias("seen"),
        (F.min("context") != F.max("context")).alias("differ"), F.count("*").alias("n"),
    ).filter("earliest < latest").drop("latest")
    met = dealt_join(rows, reread(shared, "repeats-anchors"), ["anchor"], "n")
    whole = (F.col("doc") > F.col("earliest")) & (F.col("context") == F.col("seen"))
    contested = F.col("differ") & ((F.col("doc") == F.col("earliest")) | (F.col("context") != F.col("seen")))
    kinds = met.select("doc", "context", whole.alias("whole"), contested.alias("contested")).filter("whole or contested")
    lists = kinds.groupBy("doc").agg(F.collect_list(F.when(F.col("whole"), F.col("context"))).alias("contexts"), F.collect_list(F.when(F.col("contested"), F.col("context"))).alias("contested"))
    lists = reread(lists, "repeats-contexts")
    apart = docs.join(lists.filter(F.size("contested") > 0), "doc").select("doc", "text", "contested")
    windows = reread(_windows_of(apart, window, gram), "repeats-windows")
    keys = ["anchor", "window"]
    twice = windows.groupBy(*keys).agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest"), F.count("*").alias("n")).filter("earliest < latest").drop("latest")
    later = dealt_join(windows, reread(twice, "repeats-shared"), keys, "n").filter("doc > earliest")
    singles = later.groupBy("doc").agg(F.collect_list("window").alias("windows"))
    none = F.array().cast("array<bigint>")
    both = lists.join(singles, "doc", "left").select("doc", "contexts", F.coalesce("windows", none).alias("windows"))
    return both.filter((F.size("contexts") > 0) | (F.size("windows") > 0))


def _covered(found: Anchors, own: slice, bounds: np.ndarray, i: int, contexts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which words of text ``i`` its repeated contexts and windows cover."""
    begin, n = bounds[i], bounds[i + 1] - bounds[i]
    depth = np.zeros(n + 1, np.int64)
    here = np.flatnonzero(np.isin(found.context[own], contexts)) + own.start
    np.add.at(depth, found.first[here] - begin, 1)
    np.add.at(depth, found.last[here] - begin + found.window, -1)
    if len(windows):
        for at in range(0, n - found.window + 1, STRETCH):
            last = min(at + STRETCH, n - found.window + 1) - 1
            starts = np.flatnonzero(np.isin(found.windows(begin + at, begin + last), windows)) + at
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + found.window, -1)
    return np.cumsum(depth[:-1]) > 0


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def remove(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add ``n_words``; ``removed``: the maximal stretches (start, stop), in words from 0, that earlier documents have too; ``kept``:
    the other words, joined by spaces.  ``id_col`` holds integers."""
    need(df, id_col, text)
    absent(df, "n_words", "removed", "kept")
    if not 0 < gram < window:
        raise ValueError("an anchor is shorter than a window")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    lists = reread(repeated(docs, window, gram), "repeats-lists")
    doc, salt, contexts, windows = (free(df, name) for name in ("_doc", "_salt", "_contexts", "_windows"))
    # null ids are dealt out by their texts
    keyed = df.withColumns({doc: F.col(id_col).cast("long"), salt: F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text), F.lit(SALTS * SALTS)) + 1).otherwise(0)})
    keyed = keyed.withColumn(doc, F.coalesce(doc, F.lit(0)))
    found = lists.select(F.col("doc").alias(doc), F.lit(0).cast("bigint").alias(salt), F.col("contexts").alias(contexts), F.col("windows").alias(windows))
    joined = keyed.join(found, [doc, salt], "left").select(*df.columns, contexts, windows)
    place, n = df.columns.index(text), len(df.columns)
    names = [*df.columns, "n_words", "removed", "kept"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.uint64)
        for batch in batches:
            for at, data, offsets in pieces(batch.column(place)):
                words, _, _, bounds = hashed_words(data, offsets)
                rows = range(len(offsets) - 1)
                wanted = [[empty if (x := batch.column(n + c)[at + i]).values is None else x.values.to_numpy().view(np.uint64) for c in (0, 1)] for i in rows]
                touched = any(len(a) or len(b) for a, b in wanted)
                anchors = Anchors(words, bounds, window, gram) if touched else None
                edges = np.searchsorted(anchors.text, np.arange(len(offsets))) if anchors else None
                spans, kept = [], []
                for i in rows:
                    own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    if len(wanted[i][0]) or len(wanted[i][1]):
                        gone = _covered(anchors, slice(edges[i], edges[i + 1]), bounds, i, *wanted[i])
                        step = np.diff(gone.astype(np.int8), prepend=0, append=0)
                        spans.append([{"start": a, "stop": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)])
                        own = [own[k] for k in np.flatnonzero(~gone)]
                    else:
                        spans.append([])
                    kept.append(b" ".join(own))
                out = [pa.array(np.diff(bounds), pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(rows)).columns[:n], *out], names=names)

    added = T.StructType.fromDDL("n_words bigint, removed array<struct<start: bigint, stop: bigint>>, kept string")
    return joined.mapInArrow(cut_out, T.StructType([*df.schema.fields, *added.fields]))

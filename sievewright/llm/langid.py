"""Language identification by bit-sliced Bloom filters of character n-grams.

``learn`` counts the n-grams (``ORDERS`` characters, words' edges included) of a bounded
sample of labelled rows, keeps each language's ``top`` most frequent and sets them in
the languages' Bloom filters.  The filters are stored bit-sliced: one row of bits for
each position, a bit for each language, so that a look-up ANDs ``HASHES`` rows and has
the mask of all languages that contain the n-gram.  ``predict`` sums each language's
bits over a text's n-grams, takes off what the filter's false positives are expected to
add, and decides for the largest sum.

Bounds: the sample has about ``sample_docs`` rows of each language, drawn by a hash of
the id; at most ``1 / LEAST`` n-grams of a language reach the driver;
the model has ``POSITIONS`` rows of ``languages / 64`` words, whatever the corpus holds.
Prediction is a narrow map over whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text with none
of the known n-grams gets the language with most rows, score 0; ties go to the language
that has more rows, then by name.  Rows with a null language are not learned from.
With nothing to learn from every prediction is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import absent, free, need

ORDERS, HASHES, POSITIONS = (3, 4), 2, 1 << 18
#: N-grams rarer than this share of a language's are not kept.
LEAST = 2e-5
MOST_LANGUAGES = 1_024
UNKNOWN = "und"
#: Characters taken at a time.
BLOCK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Lower-cased code points, every run of other characters than letters a single space, a space at both ends."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letters()[x], x, np.uint32(32))
    return x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of each order, block by block."""
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint64)
        for order in ORDERS:
            n = min(len(part) - order + 1, BLOCK)
            if n <= 0:
                continue
            h = np.full(n, order, np.uint64)
            for i in range(order):
                h = (h + part[i : i + n]) * _PRIME
                h ^= h >> np.uint64(29)
            yield h


def popcounts(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 64 bits set."""
    low = words & np.uint64(0xFFFF)
    if (low == words).all():  # up to sixteen languages: one count of the masks themselves
        times = np.bincount(low.astype(np.int64))
        return np.array([times[np.arange(len(times)) >> i & 1 == 1].sum() if len(times) >> i else 0 for i in range(64)], np.float64)
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.float64)


@dataclass
class Filters:
    languages: list[str]
    #: positions x words of 64 languages
    rows: np.ndarray
    #: share of positive answers each language's filter gives by chance
    chance: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the words of bits of all languages whose filters contain it."""
        bits = POSITIONS.bit_length() - 1
        found = self.rows[(h & np.uint64(POSITIONS - 1)).astype(np.int64)]
        for i in range(1, HASHES):
            found = found & self.rows[(h >> np.uint64(bits * i) & np.uint64(POSITIONS - 1)).astype(np.int64)]
        return found

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Hits of each language, less those expected by chance, and the number of n-grams."""
        hits, n = np.zeros(len(self.languages)), 0
        for h in grams(letters(text)):
            masks = self.masks(h)
            n += len(h)
            hits += np.concatenate([popcounts(masks[:, w]) for w in range(masks.shape[1])])[: len(hits)]
        return np.maximum(0.0, (hits - n * self.chance) / (1 - self.chance)), n

    def decide(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return UNKNOWN, 0.0
        counts, _ = self.counts(text)
        best = int(counts.argmax())
        return self.languages[best], float(counts[best] / counts.sum()) if counts[best] else 0.0


def build(languages: list[str], grams_of: dict[str, np.ndarray]) -> Filters:
    rows = np.zeros((POSITIONS, max(1, -(-len(languages) // 64))), np.uint64)
    bits, fill = POSITIONS.bit_length() - 1, []
    for i, language in enumerate(languages):
        h = grams_of.get(language, np.empty(0, np.uint64))
        at = np.unique(np.concatenate([(h >> np.uint64(bits * j) & np.uint64(POSITIONS - 1)).astype(np.int64) for j in range(HASHES)]))
        rows[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill.append(len(at) / POSITIONS)
    return Filters(languages, rows, np.array(fill) ** HASHES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in total.items():
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        total.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for h in grams(letters(text.as_py())):
                total.setdefault(lang, []).append(h)
        if sum(len(h) for found in total.values() for h in found) > 4 * BLOCK:
            yield from flush()
    yield from flush()


def learn(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 3_000, top: int = 4_000) -> Filters:
    """Filters from the rows of ``df`` that have a language and a text."""
    need(df, id_col, text, lang)
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return build([], {})
    share = F.create_map(*(x for r in rows for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_docs / r["count"])))))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = drawn.select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    common = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).filter(F.col("share") >= LEAST)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = common.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "gram").toPandas()
    return build([r["lang"] for r in rows], {k: v.to_numpy(np.int64).view(np.uint64) for k, v in kept.groupby("lang")["gram"]})


def predict(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the language's share of all languages' corrected hits."""
    need(df, text)
    absent(df, "lang_pred", "score")
    decided = free(df, "_decided")
    shared = df.sparkSession.sparkContext.broadcast(filters)  # POSITIONS rows: 2 MB for 64 languages

    @F.pandas_udf("lang_pred string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.decide(t) for t in texts], columns=["lang_pred", "score"])

    return df.withColumn(decided, decide(F.col(text))).select(*df.columns, f"{decided}.lang_pred", f"{decided}.score")

"""Spelling variant grouping by forward and reversed sorted dictionaries.

``count_words`` counts the words of all texts.  ``near`` finds all pairs of words that differ by exactly one
inserted, deleted or replaced character; ``group`` gives each word the frequent form that it varies, and the root of that chain.

One edit leaves a half of the shorter word intact: two words of which the shorter has s characters share their first s // 2
characters or their last.  So the dictionary is sorted twice, forwards and reversed, by length class and shared part, and scanned by range:
words that share a prefix (a suffix) of half the length stand in one *block*.  A block of more than ``BLOCK`` words is *subdivided*: the
edit lies in the characters that the block does not share, of which one edit again leaves a half intact, so each
word goes on into a block that shares the half before as well and one that shares the half behind; and so on until one character
is left, where the alphabet bounds a block's size.  Within a block each word is verified against the others.  A pair may share several
blocks; it is reported in the one that always taking the shared prefix, where there is one, leads to.  A block knows the *way* that led to it
(0 for each half before, 1 for each half behind): two ways may share the same characters, one of them by a larger block than the other.

Scale: texts are read once; words are counted before they are shuffled.  All that follows has a row or a few for
each distinct word.  Blocks are counted before their words meet, so no task gets a large one; words of a block with more than
one in ``common.HOT`` rows are dealt out under salts when the counts are joined.  Chains of forms grow at least ``RATIO``-fold
at each step, so they are short; they are followed by doubling.

Defined results: a null text has no words, and no word is empty; a null id leaves words as they are; repeated rows count each; an empty table gives an empty table.
Words and ties are ordered by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, need, reread, tasks_for

#: Words of a block that is scanned; larger ones are subdivided.
BLOCK = 64
#: A form occurs so many times as often as its variant at least.
RATIO = 5
#: Distinct words counted in a task before they are handed on.
HELD = 1 << 18
_RUN = re.compile("[a-zÀ-ÿ]+")
_PARTS = ["length", "before", "behind", "way", "head", "tail"]


def misspelt(doc_id: int | None, word: str, one_in: int) -> str:
    """The word, or for one in ``one_in`` (by the CRC-32 of ``<doc_id>:<word>``) without one of its characters."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % one_in else word[:at] + word[at + 1 :]


def count_words(df: DataFrame, text: str = "text", doc_id: str | None = None, one_in: int = 199) -> DataFrame:
    """``(word, n)`` of all texts: runs of Latin letters, A-Z in lower case.

    Where ``doc_id`` names a column of integers, one word in ``one_in`` loses a character in some documents: planted misspellings.
    """
    need(df, text, *([doc_id] if doc_id else []))

    def handed(total: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for own, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes in lower case: of ASCII letters only
                found = Counter(_RUN.findall((whole.as_py() or "").encode().lower().decode()))
                if doc_id is None:
                    total.update(found)
                    continue
                for word, n in found.items():
                    total[misspelt(own, word, one_in)] += n
                if len(total) >= HELD:
                    yield handed(total)
                    total.clear()
        yield handed(total)

    ids = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    counted = df.select(ids.alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("word <> ''")


def _split(middle: Column) -> Column:
    return F.floor(middle / 2).cast("int")


def _blocks(rows: DataFrame) -> DataFrame:
    """Each row's two blocks: of the characters that its block does not share, the half before is shared too, or the half behind."""
    half = _split(F.col("length") - F.col("before") - F.col("behind"))
    side = lambda before, behind, step: F.struct(before.alias("before"), behind.alias("behind"), F.concat("way", F.lit(step)).alias("way"))
    sides = F.array(side(F.col("before") + half, F.col("behind"), "0"), side(F.col("before"), F.col("behind") + half, "1"))
    parted = rows.select("word", "n", "length", F.explode(sides).alias("side")).select("word", "n", "length", "side.before", "side.behind", "side.way")
    return parted.withColumns({"head": F.left("word", F.col("before")), "tail": F.right("word", F.col("behind"))})


def _canonical(length: int, way: str, prefix: int) -> bool:
    """Whether a pair that shares so long a prefix comes this way by taking a shared prefix wherever there is one."""
    a = b = 0
    for step in way:
        half = (length - a - b) // 2
        if (prefix >= a + half) != (step == "0"):
            return False
        a, b = (a + half, b) if step == "0" else (a, b + half)
    return True


def _pairs(length: int, way: str, words: list[str]) -> Iterator[tuple[int, int]]:
    """Positions of the block's words that are one edit apart, the pairs that belong to other blocks left out."""
    same = [i for i, w in enumerate(words) if len(w) == length]
    longer = [i for i, w in enumerate(words) if len(w) == length + 1]

    def table(which: list[int], width: int) -> np.ndarray:
        return np.frombuffer("".join(words[i] for i in which).encode("utf-32-le"), np.uint32).reshape(len(which), width)

    short, long = table(same, length), table(longer, length + 1)
    for k, i in enumerate(same):
        other = short[k + 1 :] != short[k]
        for j in np.flatnonzero(other.sum(axis=1) == 1):
            if _canonical(length, way, int(other[j].argmax())):
                yield i, same[k + 1 + int(j)]
        if len(longer):
            ahead, back = long[:, :-1] != short[k], (long[:, 1:] != short[k])[:, ::-1]
            prefix = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length)
            suffix = np.where(back.any(axis=1), back.argmax(axis=1), length)
            for j in np.flatnonzero(prefix + suffix >= length):
                if _canonical(length, way, int(prefix[j])):
                    yield i, longer[int(j)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block: each pair of near words, from either side."""
    key: tuple | None = None
    words: list[str] = []
    counts: list[int] = []
    out: list[tuple[str, str, int]] = []

    def handed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "other", "n"])

    def block() -> None:
        if len(words) > 1:
            for i, j in _pairs(key[0], key[3], words):
                out.extend(((words[i], words[j], counts[j]), (words[j], words[i], counts[i])))

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for *own, word, n in zip(*columns, strict=True):
            if tuple(own) != key:
                block()
                key, words, counts = tuple(own), [], []
            words.append(word)
            counts.append(n)
        if len(out) > 10_000:
            yield handed()
    block()
    yield handed()


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, other, n)``: all pairs of distinct ``words (word, n)``, not empty, that differ by one edit, from either side; ``n`` is the other's."""
    need(words, "word", "n")
    tasks = tasks_for(words.sparkSession)
    # a word is the shorter or equal one of pairs of its own length, the longer one of pairs of the length below
    lengths = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    rows = words.select("word", "n", lengths.alias("length")).filter("length > 0").withColumns({"before": F.lit(0), "behind": F.lit(0), "way": F.lit("")})
    ready: list[DataFrame] = []
    while True:
        rows = reread(_blocks(rows), "variants-blocks")
        sizes = rows.groupBy(*_PARTS).agg(F.count("*").alias("size"), F.count_if(F.char_length("word") == F.col("length")).alias("short")).filter("size > 1 and short > 0")
        sizes = reread(sizes.withColumn("more", F.col("size")), "variants-sizes")
        met = dealt_join(rows, sizes.drop("short"), _PARTS, "size")
        open_ = (F.col("more") > block) & (_split(F.col("length") - F.col("before") - F.col("behind")) > 0)
        ready.append(met.filter(~open_).select(*_PARTS, "word", "n"))
        rows = met.filter(open_).select("word", "n", "length", "before", "behind", "way")
        if sizes.filter(open_).isEmpty():
            break
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    # two dictionaries, forwards by the shared head, and backwards by the shared tail
    every = reread(every, "variants-words")
    order = ["length", "before", "behind", "way", "head", F.reverse("tail")]
    sorted_ = every.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "word")
    return sorted_.select(*_PARTS, "word", "n").mapInArrow(_scan, "word string, other string, n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``, no form null: the end of each chain."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        reach = reread(reach, "variants-roots")
        on = reach.select(F.col("word").alias("at"), F.col("root").alias("next"))
        met = reach.join(on, reach["root"] == on["at"], "left")
        if met.filter("next is not null").isEmpty():
            return reach
        reach = met.select("word", F.coalesce("next", "root").alias("root"))


def group(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each of ``words (word, n)``, which are distinct: its near word of
    largest n (ties: the smallest), if that is ``ratio`` times its own or more; the last of its chain of forms."""
    words = reread(words.select("word", "n"), "variants-vocabulary")
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("other").alias("other")))
    found = near(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    forms = words.join(found, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")
    )
    forms = reread(forms, "variants-forms")
    roots = _roots(forms.filter("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""A training-data pipeline over ``documents``: five stages, each an operator of ``sievewright.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns all that it keeps; but for the last, with
the columns of ``documents``.  ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import bpe, mixing, simhash, toxicity, trigrams
from sievewright.llm.common import documents, reread

#: Texts of this score or more are rejected.
TOXIC = 0.7
#: Words of a block of the mix: large, so that few documents are cut.
BLOCK = 128


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of ``docs``."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    found = trigrams.scan(docs)
    text = trigrams.redacted(F.col("text"), F.col("secrets"))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources weighing 3, 1, 2: a row for each time that a document, or a part of it, is taken."""
    taken = mixing.mix(docs, block_tokens=BLOCK).filter("taken > 0")
    return mixing.materialise(docs, taken).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN, round_trip=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", clean), ("simhash", distinct), ("secrets", safe), ("mixing", mixed), ("bpe", encoded)]

#: The first stage's model is fitted by descent, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = reread(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

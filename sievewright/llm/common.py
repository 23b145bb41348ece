"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in ``HOT`` of all rows is hot; there are fewer than ``HOT`` of them.
HOT, SALTS = 256, 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; where none is named, a temporary one
    in a local session, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reread(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: for tables with texts."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tasks_for(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for; explicit repartitions follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(n)


def need(df: DataFrame, *columns: str) -> None:
    """Fail early, naming what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def absent(df: DataFrame, *columns: str) -> None:
    """Fail early where a column to be added is there already, in any case of its letters."""
    have = {c.lower() for c in df.columns}
    if clash := [c for c in columns if c.lower() in have]:
        raise ValueError(f"columns {', '.join(clash)} are there already")


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def spread_join(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row of ``lookup`` that has their ``key``; both are read twice.

    Keys of more than one in ``HOT`` rows are hot.  Their rows are dealt out under ``SALTS`` salts, with a
    copy of the lookup's row for each, so no task gets all rows of a key.  What is broadcast
    is the hot keys: fewer than ``HOT``.
    """
    rest = [c for c in rows.columns if c != key]
    total = rows.count()
    hot = F.broadcast(rows.groupBy(key).count().filter(F.col("count") * HOT > total).select(F.col(key).alias("_hot")))
    salted = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*rest), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    dealt = lookup.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), SALTS - 1).otherwise(0)))).drop("_hot")
    return salted.join(dealt, [key, "_salt"]).drop("_salt")


def dealt_join(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """``rows`` with the one row of ``lookup``, if any, that has their ``keys``; ``lookup`` knows the number ``n`` of rows of its keys.

    As in ``spread_join``, keys of more than one in ``HOT`` rows are dealt out under ``SALTS`` salts; ``n`` is left out.  ``rows`` are
    counted where their ``total`` is not given, and ``lookup`` is read twice.
    """
    total = rows.count() if total is None else total
    hot = F.broadcast(lookup.filter(F.col(n) * HOT > total).select(*keys, F.lit(True).alias("_hot")))
    rest = [c for c in rows.columns if c not in keys]
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    dealt = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) * HOT > total, SALTS - 1).otherwise(0)))).drop(n)
    return salted.join(dealt, [*keys, "_salt"]).drop("_salt")

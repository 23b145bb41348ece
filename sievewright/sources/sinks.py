"""Writers of state: skipped when unchanged, keyed upserts, bounded logs, monthly archives.

Each writes a new version beside the old one and gives it the folder's name once it is whole, so a
reader never sees half a table.  Between the two renames of that the name is absent for a moment; readers that may look then, and
tables that change together, belong in a ``commits.Store``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables


def content_hash(df: DataFrame) -> str:
    """A hash of the rows in any order: the number, and two sums of row hashes."""
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), of(1).alias("a"), of(2).alias("b")).first()
    return f"{row.n}:{row.a}:{row.b}"


def write_if_changed(df: DataFrame, path: str, known: str | None) -> str:
    """Write unless the content's hash is the known one; the hash."""
    now = content_hash(df)
    if now != known:
        write_version(df, path)
    return now


def _paths(spark: SparkSession, path: str):
    """The path as the file system of the session knows it, and that file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_version(df: DataFrame, path: str) -> None:
    """Write a folder beside ``path`` and give it the name once it is whole; ``df`` may read the old one."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}.{mark}")
    where, files = _paths(spark, path)
    old, _ = _paths(spark, f"{path}.{mark}-old")
    new, _ = _paths(spark, f"{path}.{mark}")
    if files.exists(where):
        files.rename(where, old)
    files.rename(new, where)
    files.delete(old, True)


def persist(first: tuple[DataFrame, str], *then: tuple[DataFrame, str]) -> list[str]:
    """Write tables one after another, each only once those before it are whole: the queue first, then its cursors."""
    written = []
    for df, path in (first, *then):
        write_version(df, path)
        written.append(path)
    return written


def registry_store(registry: DataFrame, found: DataFrame, key: str, confidence: str, least: float) -> DataFrame:
    """A registry with the findings that are sure enough in place of what it has, unless that is surer; equal ones stay."""
    sure = found.filter(F.col(confidence) >= least)
    both = registry.select("*", F.lit(0).alias("_new")).unionByName(sure.select("*", F.lit(1).alias("_new")))
    rest = [c for c in registry.columns if c != confidence]
    return tables.keep_first(both, [key], F.desc(confidence), "_new", *rest).drop("_new")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], path: str) -> None:
    """All rows, new values over old ones unless blank, as a new version."""
    write_version(tables.upsert_non_blank(old, new, key, columns).drop("merge_state"), path)


def append_semantic(old: DataFrame, new: DataFrame, key: str, ids: str, one: str, most: int = 20) -> DataFrame:
    """An inverted index with one more id for each key: distinct, the last ``most``."""
    added = new.groupBy(F.col(key).alias("_k")).agg(F.collect_set(one).alias("_new"))
    both = old.join(added, F.col(key) == F.col("_k"), "full")
    merged = F.array_distinct(F.concat(F.array_except(F.coalesce(ids, F.array()), F.coalesce("_new", F.array())), F.array_sort(F.coalesce("_new", F.array()))))
    return both.select(F.coalesce(key, "_k").alias(key), F.slice(merged, F.greatest(F.size(merged) - most + 1, F.lit(1)), most).alias(ids))


def archive_by_month(df: DataFrame, key: list[str], at: str, path: str) -> None:
    """The newest row of each key in its month's partition, with the rows that the month has already; other months stay."""
    spark = df.sparkSession
    rows = df.withColumn("month", F.date_format(at, "yyyy-MM"))
    where, files = _paths(spark, path)
    if files.exists(where):
        old = spark.read.option("basePath", path).schema(rows.schema).parquet(path)
        rows = rows.unionByName(old.join(F.broadcast(rows.select("month").distinct()), "month", "left_semi"))  # as many months as are written
    rest = sorted(c for c in df.columns if c not in (*key, at))
    kept = tables.keep_first(rows, ["month", *key], F.desc(at), *(F.to_json(F.struct(c)) for c in rest))
    # what is read and what is replaced are the same folders: the rows are written beside them first
    beside = f"{path}.{uuid.uuid4().hex}"
    kept.write.partitionBy("month").parquet(beside)
    whole = spark.read.option("basePath", beside).schema(rows.schema).parquet(beside)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    files.delete(_paths(spark, beside)[0], True)


def compacted(df: DataFrame, id_col: str, url: str, columns: list[str]) -> DataFrame:
    """Archive rows: a key of id and address, and of ``columns`` those that are not empty, as a map."""
    key = F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.coalesce(url, F.lit(""))), 256), 1, 24)
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns))
    return df.select(key.alias("archive_key"), F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != "")).alias("kept"))


def bounded_log(log: DataFrame, rows: DataFrame, most: int, at: str, tie: str) -> DataFrame:
    """A log with further rows, the newest ``most``."""
    return log.unionByName(rows).orderBy(F.desc(at), F.desc(tie)).limit(most)


def link_cache(cache: DataFrame, rows: DataFrame, key: str, at: str, now: str, days: int = 180, most: int = 500) -> DataFrame:
    """A cache with further rows in place of those of equal key, without expired ones, the newest ``most``."""
    fresh = cache.join(rows.select(key), key, "left_anti").unionByName(rows).filter(F.col(at) >= F.date_sub(F.lit(now).cast("date"), days))
    return fresh.orderBy(F.desc(at), key).limit(most)

"""How indexed payloads lie on disk, so that a search's filters prune files, and a cache of search results that knows its tenant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields with few values are folders; the source, which may have many, is hashed to buckets.
FOLDERS, BUCKETED, BUCKETS, NONE = ["language", "category"], "source", 16, "-"
_RESULT = "key string, query string, rank int, id string, score double"


def write_payloads(rows: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with source, language, category and whatever else, as a table below path. Null and empty values become NONE, which a
    folder can be named after."""
    known = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NONE)) for c in [*FOLDERS, BUCKETED]})
    # Rows of one folder meet in as many tasks as it has buckets, so a task writes few files and no folder is one task.
    dealt = known.repartition(*FOLDERS, F.pmod(F.xxhash64(BUCKETED), F.lit(buckets)))
    dealt.write.mode("overwrite").partitionBy(*FOLDERS).bucketBy(buckets, BUCKETED).sortBy(BUCKETED).option("path", path).option("compression", "zstd").saveAsTable(table)
    return rows.sparkSession.table(table)


def where_payload(rows: DataFrame, **fields: str) -> DataFrame:
    """The rows with these payload values; each is a plain equality, which folders, buckets and row groups prune."""
    unknown = set(fields) - {*FOLDERS, BUCKETED, "edition", "version"}
    if unknown:
        raise ValueError(f"no payload index on {', '.join(sorted(unknown))}")
    for name, value in fields.items():
        rows = rows.where(F.col(name) == value)
    return rows


def _key(domain: str, matter, k: int, query: Column) -> Column:
    """Which search a result answers; the matter is part of it, so one tenant's results never answer another's."""
    return F.sha2(F.to_json(F.struct(F.lit(domain).alias("d"), F.lit(None if matter is None else str(matter)).alias("m"), F.lit(k).alias("k"), query.alias("q"))), 256)


def cached_search(queries: DataFrame, path: str, domain: str, matter, k: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """queries (query: text) -> query, rank, id, score from the cache at path; what it lacks is searched (query, rank, id, score) once and
    kept. A query without hits is kept as one with a null rank. Evidence is never searched without its matter."""
    if domain == "matter" and matter is None:
        raise ValueError("a retrieval over evidence needs its matter")
    spark = queries.sparkSession
    asked = queries.select("query").distinct().withColumn("key", _key(domain, matter, k, F.col("query")))
    missing = asked.join(_cache(spark, path).select("key").distinct(), "key", "left_anti")
    if not missing.isEmpty():
        found = search(missing.select("query")).where(F.col("rank") <= k).select("query", F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
        missing.join(found, "query", "left").select("key", "query", "rank", "id", "score").write.mode("append").parquet(path)
    return asked.join(_cache(spark, path).drop("query"), "key").where("rank is not null").select("query", "rank", "id", "score")


def _cache(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _RESULT)
    # Two runs may have kept one search twice.
    return spark.read.schema(_RESULT).parquet(path).distinct()

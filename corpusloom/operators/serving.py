"""What stands between retrieval and an answer: items, reranking, citations, frames, and guarded writes of the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
EXCERPT, SUMMARY_CHARS, OCR_CHARS = 800, 1200, 20
MATTER_KEYS = ["document_id", "page", "excerpt"]
ELLIPSIS = " …"
AUTHORITY_KEYS = ["source", "version", "article", "excerpt"]


def rerank(hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None, within: str | None = None) -> DataFrame:
    """hits (query, rank, id, text) cut to k of each query (and tenant) by an injected scorer's column; without one the order stays."""
    order = [F.col("rank")] if scorer is None else [F.desc(scorer(F.col("query"), F.col("text"))), F.col("rank")]
    w = Window.partitionBy("query", *([within] if within else [])).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def citations(matter: DataFrame, authority: DataFrame) -> DataFrame:
    """query, ordinal, domain and each domain's own keys: all matter citations, then all authority ones, never mixed."""
    one = matter.select("query", "rank", F.lit(0).alias("_domain"), F.lit("matter").alias("domain"), F.to_json(F.struct("document_id", "page", F.substring("text", 1, EXCERPT).alias("excerpt"))).alias("citation"))
    two = authority.select("query", "rank", F.lit(1).alias("_domain"), F.lit("authority").alias("domain"), F.to_json(F.struct("source", "version", "article", F.substring("text", 1, EXCERPT).alias("excerpt"))).alias("citation"))
    w = Window.partitionBy("query").orderBy("_domain", "rank")
    return one.unionByName(two).select("query", F.row_number().over(w).alias("ordinal"), "domain", "citation")


def authority_dedup(rows: DataFrame) -> DataFrame:
    """rows (seq, source, version, article): without blank keys, the first of each."""
    named = rows.where((F.trim("source") != "") & (F.trim("article") != ""))
    return named.groupBy("source", "version", "article").agg(F.min("seq").alias("seq"))


def parse_frames(raw: DataFrame) -> DataFrame:
    """raw (id, line) -> id, type, text of `data:` lines that hold JSON; others vanish."""
    body = F.when(F.col("line").startswith("data:"), F.trim(F.expr("substring(line, 6)")))
    return raw.select("id", F.from_json(body, "type string, text string").alias("f")).where("f.type is not null").select("id", "f.*")


def cap_summary(c: Column, size: int = SUMMARY_CHARS) -> Column:
    """At most size characters: the first line stays, what follows is cut and ends in an ellipsis; a line that fills the size alone is
    cut without one. A size of 0 or less cuts nothing."""
    if size <= 0:
        return c
    line = F.substring_index(c, "\n", 1)
    gap = F.when(F.contains(c, F.lit("\n")), "\n").otherwise("")
    left = F.lit(size) - F.length(line) - F.length(gap) - F.length(F.lit(ELLIPSIS))
    rest = F.regexp_replace(F.substring(c, F.length(line) + 2, left), r"(?U)\s+$", "")
    return F.when(F.length(c) <= size, c).when(left <= 0, F.substring(line, 1, size)).otherwise(F.concat(line, gap, rest, F.lit(ELLIPSIS)))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def ocr_flag(chars: Column, pages: Column) -> Column:
    return F.when(chars < OCR_CHARS * pages, "yes").otherwise("no")


def preflight(config: DataFrame) -> DataFrame:
    """config (name, model, dim, expected_dim) -> name, problem for each thing that is wrong."""
    problems = F.array_compact(F.array(F.when(F.coalesce(F.trim("model"), F.lit("")) == "", "no model"), F.when(F.coalesce("dim", F.lit(0)) <= 0, "no dimension"), F.when((F.col("dim") > 0) & (F.col("dim") != F.col("expected_dim")), "dimension differs")))
    return config.select("name", F.explode(problems).alias("problem"))


def cascade_delete(parents: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """What stays of the children of deleted parents: chained anti-joins."""
    return {name: df.join(parents.select(key), key, "left_anti") for name, df in children.items()}


def write_verified(rows: DataFrame, path: str, key: str, dim: int | None = None, vector: str = "vector") -> DataFrame:
    """Check vector sizes before anything is written, write, read back: key and status (verified or missing) of every row."""
    if dim is not None and not rows.where(F.coalesce(F.size(vector), F.lit(-1)) != dim).isEmpty():
        raise ValueError(f"a vector has not {dim} dimensions; nothing was written")
    rows.write.mode("overwrite").parquet(path)
    found = rows.sparkSession.read.parquet(path).select(key).distinct().withColumn("_there", F.lit(True))
    return rows.select(key).join(found, key, "left").select(key, F.when(F.col("_there"), "verified").otherwise("missing").alias("status"))


def content_mark(rows: DataFrame) -> tuple[int, str]:
    """Rows, and an order-free checksum of all columns: the sums of two hashes of every row, so equal rows count each. Kept beside a table."""
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    high = F.conv(F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 15), 16, 10)
    r = rows.agg(F.count("*"), F.concat_ws(":", total(F.xxhash64(*rows.columns)), total(high))).first()
    return r[0], r[1]


def read_verified(spark, path: str, mark: tuple[int, str]) -> DataFrame:
    """The table at path if it still has the mark it was written with."""
    rows = spark.read.parquet(path)
    if content_mark(rows) != tuple(mark):
        raise ValueError(f"{path} is not what was written")
    return rows

"""The catalogue of a source tree as a ledger: scan with errors as rows, duplicates by content, a merge that a second run leaves as it is;
and the embedding stage that takes vectors from a cache first and goes on where it was killed."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import workflow as W
from . import catalog, embedding

FIELDS = ["sha256", "bytes", "pages", "category", "source", "version", "edition"]
LEDGER = "path string, sha256 string, bytes long, pages long, category string, source string, version string, edition string, parse_status string, quarantine_reason string"
#: Fixed values.
NO_TYPE, DUPLICATE = "no detectable law type", "duplicate-of:"


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scan_files(spark: SparkSession, folder: str, suffix: str = ".pdf", count_pages: Callable[[bytes], int] | None = None) -> DataFrame:
    """rel, sha256, bytes, pages, error of every file below folder whose name ends in suffix, whatever its case. A file that cannot be read
    has no hash; one whose pages cannot be counted keeps its hash; neither stops the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    root = _qualified(spark, folder).rstrip("/") + "/"
    rel = F.substring("path", len(root) + 1, 1 << 20)
    listed = files.load(folder).where(F.lower("path").endswith(suffix.lower())).select(rel.alias("rel"), F.col("length").alias("bytes"))

    def run(batches):
        for b in batches:
            pages, errors = [], []
            for content in b.column("content"):
                try:
                    pages.append(count_pages(content.as_py()) if count_pages else None)
                    errors.append(None)
                except Exception as x:  # a corrupt file is a row
                    pages.append(None)
                    errors.append(f"page-count: {x}")
            yield pa.RecordBatch.from_arrays([b.column("rel"), b.column("sha256"), pa.array(pages, pa.int64()), pa.array(errors, pa.string())], ["rel", "sha256", "pages", "error"])

    content = files.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder).where(F.lower("path").endswith(suffix.lower()))
    read = content.select(rel.alias("rel"), F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, "rel string, sha256 string, pages bigint, error string")
    # A file that vanishes or fails between listing and reading stays a row.
    joined = listed.join(read, "rel", "left").withColumn("error", F.when(F.col("sha256").isNull(), "unreadable").otherwise(F.col("error")))
    return joined.select("rel", "sha256", F.when(F.col("sha256").isNotNull(), F.col("bytes")).otherwise(F.lit(0)).cast("long").alias("bytes"), "pages", "error")


def planned(scan: DataFrame, limit: int | None = None) -> DataFrame:
    """The scan with winner and is_duplicate: the first path of a content wins it, a file without a hash wins itself. With a limit only the
    first winners stay, chosen after duplicates are known; duplicates always stay."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    out = scan.join(R.content_dedup(scan, "rel", "sha256"), "rel")
    if limit is None:
        return out
    first = out.where(~F.col("is_duplicate")).orderBy("rel").limit(limit)
    return first.unionByName(out.where("is_duplicate"))


def upsert(ledger: DataFrame, scan: DataFrame, limit: int | None = None) -> DataFrame:
    """The ledger after a catalogue run: a full-outer merge. Winners bring their hash, size, pages and what their name tells, and where a
    name tells nothing the old value stays; duplicates change their status and reason alone; other rows stay. conflict names a
    move that the states do not allow; such a row keeps its state."""
    rows = planned(scan, limit)
    parts = rows.select("*", F.regexp_extract("rel", r"([^/]*)$", 1).alias("filename"), F.regexp_replace(F.regexp_extract("rel", r"^(.*/)", 1), "/$", "").alias("folder"))
    told = catalog.provenance(parts.select("filename", "folder").distinct()).select("filename", "folder", "category", "source", "version", "edition", "quarantined")
    new = parts.join(told, ["filename", "folder"])
    status = F.when(F.col("is_duplicate"), "quarantined").when(F.col("error").isNotNull(), "failed").when(F.col("quarantined"), "quarantined").otherwise("parsed")
    reason = F.when(F.col("is_duplicate"), F.concat(F.lit(DUPLICATE), "winner")).when(F.col("error").isNotNull(), F.col("error")).when(F.col("quarantined"), NO_TYPE)
    new = new.select(F.col("rel").alias("path"), *[F.col(c).alias(f"new_{c}") for c in FIELDS], "is_duplicate", status.alias("_status"), reason.alias("_reason"))
    both = ledger.join(new, "path", "full_outer")
    met, winner = F.col("_status").isNotNull(), F.col("_status").isNotNull() & ~F.col("is_duplicate")
    empty = {"bytes": F.lit(0), "pages": F.lit(0)}
    before = F.coalesce("parse_status", F.lit("pending"))
    moved = W.move(F.lit("parse_status"), before, F.col("_status"), F.lit(None).cast("string"))
    legal = moved.isin("allowed", "same")

    def value(c: str):
        zero = empty.get(c, F.lit(""))
        if c in ("sha256", "bytes", "pages"):  # of a winner these are always what the scan says
            return F.when(winner, F.coalesce(f"new_{c}", zero)).otherwise(F.coalesce(c, zero)).alias(c)
        return F.when(winner, F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), c, zero)).otherwise(F.coalesce(c, zero)).alias(c)

    return both.select(
        "path", *[value(c) for c in FIELDS], F.when(met & legal, F.col("_status")).otherwise(before).alias("parse_status"),
        F.when(met & legal, F.col("_reason")).otherwise(F.col("quarantine_reason")).alias("quarantine_reason"), F.when(met & ~legal, F.concat(before, F.lit(" to "), "_status")).alias("conflict"),
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, vector of the cache, each chunk once; empty if nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    kind = "chunk_id string, vector array<float>"
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path).groupBy("chunk_id").agg(F.first("vector").alias("vector"))


def resume_embed(chunks: DataFrame, cache: str, embedder: Callable[[list[str]], list[list[float]]], dim: int, tokens: str | None = None, budget: int = 450, steps: int = 8, attempts: int = embedding.ATTEMPTS) -> DataFrame:
    """chunks (chunk_id, text, status) -> chunk_id, status, error, reused. Pending chunks whose vectors the cache holds are marked without a
    call; the others are embedded in `steps` portions, each in the cache before the next begins, so a killed run embeds nothing twice.

    A chunk over the budget (by the column `tokens`) or a vector of another size stops the run before anything is written or marked."""
    spark = chunks.sparkSession
    pending = chunks.where("status = 'pending'")
    if tokens is not None and (over := pending.where(F.col(tokens) > budget).select("chunk_id").orderBy("chunk_id").limit(3).collect()):
        raise ValueError(f"over the served budget, extract again: {', '.join(r.chunk_id for r in over)}")
    held = read_cache(spark, cache)
    if wrong := held.where(F.size("vector") != dim).limit(1).collect():
        raise ValueError(f"the cached vector of {wrong[0].chunk_id} has not {dim} dimensions")
    known = R.durable(pending.select("chunk_id").join(held.select("chunk_id"), "chunk_id", "left_semi"))
    todo = pending.join(known, "chunk_id", "left_anti").select(F.col("chunk_id").alias("id"), "text")
    failed = spark.createDataFrame([], "chunk_id string, error string")
    for step in range(steps):
        part = R.durable(embedding.embed(todo.where(F.pmod(F.xxhash64("id"), F.lit(steps)) == step), embedder, attempts))
        size = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("the vector of "), "id", F.lit(f" has not {dim} dimensions"))))
        # One committed append: the portion is in the cache as a whole or not at all.
        part.where("error is null").select(F.col("id").alias("chunk_id"), size.alias("vector")).write.mode("append").parquet(cache)
        failed = failed.unionByName(part.where("error is not null").select(F.col("id").alias("chunk_id"), "error"))
    there = read_cache(spark, cache).select("chunk_id").withColumn("_in", F.lit(True))
    marked = pending.select("chunk_id").join(there, "chunk_id", "left").join(failed, "chunk_id", "left").join(known.withColumn("_known", F.lit(True)), "chunk_id", "left")
    return marked.select("chunk_id", F.when(F.col("_in"), "embedded").when(F.col("error").isNotNull(), "failed").otherwise("pending").alias("status"), "error", F.coalesce("_known", F.lit(False)).alias("reused"))

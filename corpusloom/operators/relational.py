"""Relational reads, merges and ledger rules as functions over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder that spark.checkpoint.dir names; where none is set, beside the tables of the warehouse."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint()


def latest_per_group(rows: DataFrame, group: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row of each group that is last by `order`: one partial aggregate, no sort of a group."""
    return rows.groupBy(group).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("last")).select(group, "last.*")


def first_per_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conversation_list(messages: DataFrame, limit: int = 50, preview: int = 120) -> DataFrame:
    """Newest conversations first: message count, and the start of the first non-empty message."""
    firsts = F.min_by("text", F.when(F.col("text") != "", F.col("turn")))
    found = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.substring(firsts, 1, preview).alias("preview"))
    return found.orderBy(F.desc("conv_id")).limit(limit)


def document_list(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents with the number and the last page of their sections: 0 and null without any."""
    found = sections.groupBy("doc_id").agg(F.count("*").alias("section_count"), F.max("page_end").alias("page_count"))
    return docs.join(found, "doc_id", "left").withColumn("section_count", F.coalesce("section_count", F.lit(0).cast("long")))


def content_dedup(files: DataFrame, path: str, sha: str) -> DataFrame:
    """path, winner, is_duplicate: per content the first path wins; without a hash a file is its own content."""
    key = F.coalesce(F.col(sha), F.concat(F.lit("path:"), F.col(path).cast("string")))
    keyed = files.withColumn("_key", key)
    winners = keyed.groupBy("_key").agg(F.min(path).alias("winner"))
    return keyed.join(winners, "_key").select(path, "winner", (F.col(path) != F.col("winner")).alias("is_duplicate"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_coalesce(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per column the new value, or the old one where it is null; keys of either side."""
    cols = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols])


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, status: verified or missing."""
    there = found.select(key).distinct().withColumn("_there", F.lit(True))
    return expected.select(key).join(there, key, "left").select(key, F.when(F.col("_there"), "verified").otherwise("missing").alias("status"))


def stage_counts(ledger: DataFrame, stages: list[str]) -> DataFrame:
    """stage, status, n in one pass: the stages are unpivoted, then counted once."""
    pairs = ", ".join(f"'{s}', {s}" for s in stages)
    return ledger.select(F.expr(f"stack({len(stages)}, {pairs}) as (stage, status)")).groupBy("stage", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def extract_eligible(parse: Column, reason: Column) -> Column:
    return (parse == "parsed") | ((parse == "quarantined") & ~F.coalesce(reason, F.lit("")).startswith("duplicate-of:"))


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """For each point the value of the last start at or before it: union and one window, no range join."""
    p = points.select(key, F.col(at).alias("_at"), F.lit(None).cast(starts.schema[value].dataType).alias(value), F.lit(1).alias("_kind"))
    s = starts.select(key, F.col(start).alias("_at"), value, F.lit(0).alias("_kind"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(p).withColumn("_found", F.last(value, ignorenulls=True).over(w))
    return both.where("_kind = 1").select(key, F.col("_at").alias(at), F.col("_found").alias(value))


def overlapping(ranges: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """ranges (key, start, end) with the least confidence and any review flag of the pages that they touch."""
    hit = (F.col("p.page_start") < F.col("r.end")) & (F.col("p.page_end") > F.col("r.start"))
    joined = ranges.alias("r").join(pages.alias("p"), (F.col(f"r.{key}") == F.col(f"p.{key}")) & hit, "left")
    return joined.groupBy(F.col(f"r.{key}").alias(key), F.col("r.start").alias("start"), F.col("r.end").alias("end")).agg(F.min("p.confidence").alias("confidence"), F.coalesce(F.bool_or("p.review"), F.lit(False)).alias("needs_review"))


def headings_in_force(lines: DataFrame, doc: str, order: str, keep: list[str] | tuple = ()) -> DataFrame:
    """lines (doc, order, book, part, chapter: null but on heading lines) with the headings in force; a higher level clears lower ones."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col(order))).over(w)
    out = lines.withColumns({"_b": at("book"), "_p": at("part"), "_c": at("chapter")})
    now = {c: F.last(c, ignorenulls=True).over(w) for c in ("book", "part", "chapter")}
    zero = F.lit(-1).cast("long")
    b, p, c = (F.coalesce(x, zero) for x in ("_b", "_p", "_c"))
    return out.select(doc, order, *keep, now["book"].alias("in_book"), F.when(p >= b, now["part"]).alias("in_part"), F.when((c >= b) & (c >= p), now["chapter"]).alias("in_chapter"))


def reachable(edges: DataFrame, roots: list, skip: list | None = None) -> DataFrame:
    """node, depth by breadth-first rounds over edges (src, dst), until no node is new; skipped nodes are never entered. Each wave is
    cut by a checkpoint, so a deep graph does not grow the plan."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    seen = wave = durable(spark.createDataFrame([(r, 0) for r in roots], f"node {kind}, depth int"))
    depth = 0
    while not wave.isEmpty():
        depth += 1
        step = edges.join(wave, edges.src == wave.node).select(F.col("dst").alias("node")).distinct()
        if skip:
            step = step.where(~F.col("node").isin(skip))
        wave = durable(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = durable(seen.unionByName(wave).repartition("node"))
    return seen

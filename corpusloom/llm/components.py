"""Connected components of an edge table by alternating large and small stars; every round is cut into the shared folder.

A hub, be it a third of all edges, is no join key: its edges meet its least neighbour in a broadcast of at most `HOT_KEYS` rows, and
are then dealt by their other end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, HOT_LEAST, durable


def _least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """For each a the least of itself and its neighbours (m) and its edges (n); and the edges with the m of their a."""
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    limit = max(HOT_LEAST, total // HOT_KEYS)
    hub = least.where(F.col("n") > limit).select(F.col("a").alias("_hub"), F.col("m").alias("_of_hub"))
    other = least.where(F.col("n") <= limit).select(F.col("a").alias("_node"), F.col("m").alias("_of_node"))
    known = edges.join(F.broadcast(hub), F.col("a") == F.col("_hub"), "left")
    # No node is negative, so a hub's edges meet nothing more, in as many tasks as there are.
    dealt = known.withColumn("_at", F.when(F.col("_hub").isNull(), F.col("a")).otherwise(-1 - F.pmod(F.xxhash64("b"), F.lit(1 << 20))))
    return least, dealt.join(other, F.col("_at") == F.col("_node"), "left").select("a", "b", F.coalesce("_of_hub", "_of_node").alias("m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    return _least(both, 2 * n)[1].where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least, linked = _least(edges, n)
    linked = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs from 0 -> (node, root): the least node of its component, for every node that has an edge to another one.

    Rounds grow with the logarithm of a component's diameter."""
    now = durable(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        # The large star gives an edge for each of a node's at most: every a is greater than its b. Edges given twice go once, at the end.
        large = _large_star(now, mark[0]).where(F.col("a") != F.col("b"))
        now = durable(_small_star(large, 2 * mark[0]).where(F.col("a") != F.col("b")).distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())

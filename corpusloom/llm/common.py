"""Shared plumbing: reading tables, durable cuts of lineage, joins whose broadcast side is measured first."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; its columns are ids, hashes and short flags, under 100 bytes a row.
BROADCAST_ROWS = 200_000


#: A key with more than a HOT_KEYS-th of all rows (and than HOT_LEAST) is hot: there cannot be more of them.
HOT_KEYS, HOT_LEAST = 20_000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder the cluster names in spark.checkpoint.dir; where none is set, one beside the tables of the warehouse, which
    driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit digest of id and text: rows that share it are repeats. Nulls differ from empty values."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit("\n"), part(text))))


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: later stages survive lost executors and never recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is planned and run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_measured(big: DataFrame, small: DataFrame, on: Column, how: str, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join; small is broadcast only if its counted rows are within bound, else it is shuffled (AQE splits skewed keys)."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= bound else small.hint("merge"), on, how)


def join_hot(rows: DataFrame, small: DataFrame, key: str, times: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of small, which has each key once and in `times` how many of the `total` rows share it (or more).

    Rows of hot keys meet a broadcast of at most HOT_KEYS rows where they lie; only the others are shuffled by the key."""
    limit = max(HOT_LEAST, total // HOT_KEYS)
    hot, few = small.where(F.col(times) > limit), small.where(F.col(times) <= limit)
    # The condition uses all columns, so that both broadcasts and the join share one shuffle of an aggregate. It holds for any row;
    # if it did not, the rows would meet no row of `few`.
    names = {c: f"_hot_{c}" for c in small.columns}
    met = hot.withColumnsRenamed(names)
    same = (F.col(key) == F.col(names[key])) & (F.xxhash64(*names.values()) != F.lit(0))
    rest = rows.join(F.broadcast(met), same, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(few, key, how))

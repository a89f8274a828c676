"""Rows with labels, split by a hash of the id, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_measured


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the text of no characters."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(modulus)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """text and _label of about `rows` labelled rows at most, never of the held-out remainder; drawn by a hash of the id."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    own = own.where(remainder("_id", modulus) != held_out).groupBy("_id").agg(F.max("_label").alias("_label"))
    n = own.count()
    scale = 1_000_000
    if n > rows:
        own = own.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(scale)) < int(scale * rows / n))
    return join_measured(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), own, F.col("doc_id") == F.col("_id"), "inner", rows=min(n, rows)).select("text", "_label")

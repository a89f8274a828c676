"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes what the one before it kept. The first three drop rows, the fourth rewrites texts (each secret becomes a
mark), the last returns the pieces of packed sequences.

Defined results: a null, empty or blank text has no words, so the first stage rejects it; a null doc_id is a value like any other,
and the least of its class; rows repeated with id and text are one class, of which one row stays; of ties (equal or near texts) the
least doc_id stays; further columns, whatever their names, are kept up to the last stage; texts of any length are read whole; an
empty table gives an empty result at every stage, and so does a table of which every row is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from corpusloom.llm.common import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a quality rule rejects go."""
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are alike stays."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are masked, and n_chars follows."""
    return secret_scan.mask(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' token ids in sequences of at most 2048."""
    return packing.pack_sequences(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("secrets", secrets), ("packing", sequences)]

#: Tokenising, MinHash and differencing have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

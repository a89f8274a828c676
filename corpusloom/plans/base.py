"""The registry of queries, and the tables and shapes that they share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The types that documents stand for where types are needed.
DOC_TYPES = "case n_chars % 5 when 0 then 'contract' when 1 then 'letter' when 2 then 'payslip' when 3 then 'correspondence' else 'other' end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, fixture) -> DataFrame:
    return spark.createDataFrame(fixture.rows, fixture.schema)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline states derived from documents and labels, in the shape of an import ledger."""
    short, q, t = F.col("n_chars") < 60, F.col("quality"), F.col("toxic")
    indexed = F.coalesce((t == 0) & (q == 1), F.lit(False))
    chunks = F.floor(F.col("n_chars") / 1000) + 1
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source").alias("category"), F.col("lang").alias("edition"), F.sha2("text", 256).alias("sha"), "n_chars",
        F.when(short, "quarantined").otherwise("parsed").alias("parse_status"),
        F.when(short, "short-text").alias("reason"),
        F.when(q.isNotNull(), "extracted").when(short, "quarantined").otherwise("pending").alias("extract_status"),
        F.when(q == 1, "embedded").when(q == 0, "failed").otherwise("pending").alias("embed_status"),
        F.when(indexed, "indexed").otherwise("pending").alias("index_status"),
        F.when(q == 1, chunks).otherwise(F.lit(0)).cast("long").alias("chunk_count"),
        F.when(indexed, chunks).otherwise(F.lit(0)).cast("long").alias("indexed_count"),
    )


@dataclass(frozen=True)
class Beside:
    """A fixture's rows and those that a given table has under expressions which Spark and the SQL beside it read alike."""

    fixture: object
    table: str
    columns: tuple[str, ...]

    @property
    def sql(self) -> str:
        return f"(select * from {self.fixture.sql} union all select {', '.join(self.columns)} from {self.table})"

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = inline(spark, self.fixture)
        more = read(spark, sf_dir, self.table).selectExpr(*self.columns).toDF(*own.columns)
        return own.unionByName(more.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own.schema]))

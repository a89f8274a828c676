"""Resumable ingestion: what is available is processed once, the checkpoint is the ledger."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform=lambda df: df) -> None:
    """Append transform(new files of source) to target; a second call takes only what came since."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events through the stream, then counted by type."""
    work = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpusloom-stream-")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema.simpleString().removeprefix("struct<").removesuffix(">")
    import uuid

    at = f"{work}/{uuid.uuid4().hex}"
    ingest(spark, f"{sf_dir}/events.parque[t]", ", ".join(c.replace(":", " ", 1) for c in schema.split(",")), f"{at}/out", f"{at}/ckpt", lambda d: d.withColumn("day", F.to_date("ts")))
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))

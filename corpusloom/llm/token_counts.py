"""Token counts with the whole-token shortcut (see bpe.Vocabulary): proven pre-tokens count one, only the rest is merged.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text are handled as the tokenizer
does by default; repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, vocabulary
from .common import table
from .textkit import map_blocks

TOKEN_LIMIT = 512


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_whole (tokens that the shortcut gave)."""
    path = path or default_path()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(block, batch):
        tokens, whole = vocabulary(path).counts(block)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit), pa.array(whole)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    return map_blocks(rows, "text", f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_whole bigint", count)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

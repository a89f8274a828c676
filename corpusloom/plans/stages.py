"""Queries of the catalogue merge and of the loop between a model and retrieval; stated rules stand for files and for the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chat_loop as C
from ..operators import retrieval as H
from ..sources import ledger as L
from .base import query, read

# ---- catalogue: a document is a file; those of even ids are in the ledger already, and some files are gone

_REL = "concat(source, '/', case when doc_id % 3 = 0 then 'قانون رقم ' else 'notes ' end, doc_id, '.pdf')"
_OLD = "select {rel} as path, 'old' as sha256, {one} as bytes, {one} as pages, 'kept' as category, 'kept' as source, 'kept' as version, 'kept' as edition, 'pending' as parse_status, {null} as quarantine_reason from documents where doc_id % 2 = 0 union all select concat('gone/', doc_id), 'g', {one}, {one}, 'c', 's', 'v', 'e', 'parsed', {null} from documents where doc_id % 10 = 0"


def _scan(docs: DataFrame) -> DataFrame:
    short = F.when(F.col("n_chars") < 60, "page-count: short")
    return docs.select(F.expr(_REL).alias("rel"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.when(short.isNull(), F.floor(F.col("n_chars") / 2000) + 1).cast("long").alias("pages"), short.alias("error"))


@query(f"""with s as (select {_REL} as rel, sha256(text) as sha, strlen(text)::bigint as bytes, case when n_chars >= 60 then n_chars // 2000 + 1 end as pages, case when n_chars < 60 then 'page-count: short' end as error, doc_id % 3 = 0 as named from documents),
    w as (select *, min(rel) over (partition by sha) as winner from s), o as ({_OLD.format(rel=_REL, one="1::bigint", null="null::varchar")})
    select coalesce(o.path, rel) as path, case when rel = winner then sha else coalesce(sha256, '') end as sha256, case when rel = winner then w.bytes else coalesce(o.bytes, 0) end as bytes, case when rel = winner then coalesce(w.pages, 0) else coalesce(o.pages, 0) end as pages,
        case when rel is null then parse_status when rel <> winner then 'quarantined' when error is not null then 'failed' when not named then 'quarantined' else 'parsed' end as parse_status,
        case when rel is null then quarantine_reason when rel <> winner then 'duplicate-of:' || winner when error is not null then error when not named then '{L.NO_TYPE}' end as quarantine_reason
    from o full join w on o.path = w.rel""")
def catalog_upsert(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("_catalog_documents")
    old = spark.sql(_OLD.format(rel=_REL, one="1L", null="cast(null as string)").replace("from documents", "from _catalog_documents"))
    return L.upsert(old, _scan(docs)).select("path", "sha256", "bytes", "pages", "parse_status", "quarantine_reason")


# ---- the loop: a user's turns are queries of their conversation; the length of a text decides what the model says


def _model(prompts: DataFrame, kind: str, number: int) -> DataFrame:
    size = F.length(F.substring_index("prompt", "\nQuestion: ", -1))
    ask = lambda tool: F.to_json(F.struct(F.lit(tool).alias("tool"), F.substring_index("prompt", "\nQuestion: ", -1).alias("query")))
    if kind == "classify":
        reply = F.when(size % 8 == 0, "OUT_OF_SCOPE").otherwise("IN_SCOPE")
    elif number == 1:
        reply = F.when(size % 4 == 0, "An answer.").when(size % 4 == 1, ask("search_both")).when(size % 4 == 2, ask("search_authority")).otherwise(ask("out_of_scope"))
    else:
        reply = F.when(size % 3 == 0, ask("search_authority")).otherwise("An answer from passages.")
    return prompts.select("query", reply.alias("reply"), F.lit(None).cast("string").alias("error"))


def _privacy(prompt, evidence):
    return F.when(evidence & (F.length(F.substring_index(prompt, "\nQuestion: ", -1)) % 5 == 0), "violation").otherwise("ok")


@query("""with q as (select conv_id * 1000 + turn as query, length(text) as n from conversations where role = 'user' and trim(text) <> ''),
    r as (select *, n % 4 in (1, 2) as asks, n % 4 = 1 and n % 5 = 0 as barred from q)
    select query, case when n % 4 = 3 or n % 8 = 0 then 'out-of-scope' when n % 4 = 0 then 'direct' when barred then 'violation' when n % 3 = 0 then 'rounds' else 'direct' end as stop,
        case when not asks then 0 when barred or n % 3 > 0 then 1 else 3 end as tool_rounds from r""")
def chat_rounds(spark, sf_dir):
    """How each query's loop ends and after how many retrievals."""
    said, docs = read(spark, sf_dir, "conversations"), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = said.where("role = 'user' and trim(text) <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.col("conv_id").alias("matter"), "text")

    def matter(asks: DataFrame) -> DataFrame:
        own = said.select(F.col("conv_id").alias("matter"), F.col("turn").alias("rank"), F.col("turn").alias("id"), F.col("text").alias("said"))
        return asks.join(own, "matter").where(F.col("rank") < 3).select("query", "rank", "id", F.col("said").alias("text"))

    def authority(asks: DataFrame) -> DataFrame:
        return H.lexical_topk(asks.select("query", "text"), docs, 3).select("query", "rank", "id")

    out, _ = C.run(queries, _model, matter, authority, _privacy, lambda t: F.lit("Hello!"), stores={"authority": docs})
    return out.select("query", "stop", "tool_rounds")

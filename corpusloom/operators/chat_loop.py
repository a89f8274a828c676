"""The bounded loop between a model and retrieval, for a table of queries at once: at most three rounds, each one plan.

State is a row for each query; what a round decides is a column of it, and what it retrieves goes to a second table. The model and the searches
are injected as functions from DataFrames to DataFrames. Before every call of the model the prompt passes the privacy check; a query that
does not pass stops there, and so does one whose call fails: other queries go on. Rounds are cut by checkpoints, so a lost executor
repeats no call of a round that is done. A query's search for a text that it has searched before in that domain is not made again: its hits
are repeated.

The best passages of many queries are often the same long ones. Where a domain has a store (id, text), its search names ids alone: a hit
keeps the beginning of its passage, which is all that a prompt shows, and whole texts are joined to the returned hits only when these are read.

Defined results: a null text is an empty one; a query id must be unique, and an id in a store too; a matter search of a query without a
matter finds nothing and asks no store; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import analysis as A
from . import relational as R
from . import serving as V

MAX_ROUNDS, TOP_K = 3, 30
SHOWN, SHOWN_CHARS = 4, 250
#: (query, prompt) and whether it decides or classifies -> (query, reply, error).
Model = Callable[[DataFrame, str, int], DataFrame]
#: (query, matter, text) -> (query, rank, id, text); authorities are searched without a matter. Of a domain with a store: (query, rank, id).
Search = Callable[[DataFrame], DataFrame]
HITS = "domain string, round int, rank int, id string, text string"


def decision_prompt(text: Column, prior: Column, has_matter: Column) -> Column:
    scope = F.when(has_matter, "You may search the matter, the authorities, or both.").otherwise("You may search the authorities.")
    seen = F.when(prior.isNull(), "").otherwise(F.concat(F.lit("\nFound so far:\n"), prior))
    return F.concat(scope, F.lit(' Answer, or ask with {"tool": ..., "query": ...}.'), seen, F.lit("\nQuestion: "), text)


def classify_prompt(text: Column) -> Column:
    return F.concat(F.lit("Say IN_SCOPE if this is a legal question, else OUT_OF_SCOPE.\nQuestion: "), text)


def summaries(hits: DataFrame, size: int = V.SUMMARY_CHARS) -> DataFrame:
    """query, prior: counts of both domains, and how the first hits begin, matter before authority."""
    counts = hits.groupBy("query").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in ("matter", "authority")])
    order = Window.partitionBy("query").orderBy(F.desc(F.col("domain") == "matter"), "round", "rank")
    first = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SHOWN)
    shown = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", F.substring(F.coalesce("text", F.lit("")), 1, SHOWN_CHARS).alias("t")))).alias("x"))
    excerpts = F.concat(F.lit("\nExcerpts:\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n---\n"))
    line = F.format_string("matter passages: %d, authority passages: %d.", "matter", "authority")
    return counts.join(shown, "query").select("query", V.cap_summary(F.concat(line, excerpts), size).alias("prior"))


def _with_texts(hits: DataFrame, store: DataFrame, text: Column) -> DataFrame:
    """hits (domain, round, rank, id and query) of a store's domain with the text of their passages."""
    return hits.join(store.select(F.col("id").cast("string").alias("id"), text.alias("text")), "id")


def _asked(rows: DataFrame, prompt: Column, model: Model, kind: str, number: int, privacy: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with reply, error and barred: what the check says if it is not ok; barred prompts are never sent."""
    rows = rows.drop("error").withColumn("_prompt", prompt).withColumn("barred", F.nullif(privacy(F.col("_prompt"), F.col("evidence")), F.lit("ok")))
    rows = R.durable(rows)
    said = model(rows.where("barred is null").select("query", F.col("_prompt").alias("prompt")), kind, number)
    return R.durable(rows.drop("_prompt").join(said.select("query", "reply", "error"), "query", "left"))


def run(queries: DataFrame, model: Model, search_matter: Search, search_authority: Search, privacy: Callable[[Column, Column], Column], replies: Callable[[Column], Column], rounds: int = MAX_ROUNDS, size: int = V.SUMMARY_CHARS, stores: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """queries (query, matter, text) -> (outcomes, hits). stores: the passages of a domain, "matter" or "authority", if its search names ids alone.

    outcomes: query, stop, tool_rounds, direct_text, error, stages. stop is greeting, direct, out-of-scope, late-verdict (out of scope said
    after a retrieval), rounds (all used), provider-error, or what the privacy check says."""
    spark, stores = queries.sparkSession, stores or {}
    none = lambda kind: F.lit(None).cast(kind)
    text = F.coalesce("text", F.lit(""))
    hello = A.greeting(text)
    state = queries.select("query", "matter", text.alias("text")).select(
        "*", F.when(hello, "greeting").alias("stop"), F.lit(0).alias("tool_rounds"), F.when(hello, replies(F.col("text"))).alias("direct_text"), none("string").alias("error"), none("string").alias("prior"), F.lit(False).alias("evidence")
    )
    state = R.durable(state)
    hits = spark.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, {HITS}")
    columns = state.columns
    for number in range(1, rounds + 1):
        live = state.where("stop is null")
        if live.isEmpty():
            break
        has = F.col("matter").isNotNull()
        said = _asked(live, decision_prompt(F.col("text"), F.col("prior"), has), model, "decide", number, privacy).withColumn("call", A.tool_call(F.col("reply")))
        # Prose in the first round is checked by one more call before it may be an answer.
        prose = F.col("barred").isNull() & F.col("error").isNull() & F.col("call").isNull()
        doubt = said.where(prose & F.col("prior").isNull())
        verdicts = _asked(doubt.select(*[c for c in columns if c != "error"]), classify_prompt(F.col("text")), model, "classify", number, privacy)
        said = said.join(verdicts.select("query", F.col("reply").alias("_verdict"), F.col("error").alias("_failed"), F.col("barred").alias("_barred")), "query", "left")
        out, early = F.col("call.tool") == "out_of_scope", F.col("prior").isNull()
        stop = (
            F.when(F.coalesce("barred", "_barred").isNotNull(), F.coalesce("barred", "_barred")).when(F.coalesce("error", "_failed").isNotNull(), "provider-error")
            .when(out, F.when(early, "out-of-scope").otherwise("late-verdict")).when(F.col("call").isNotNull(), none("string"))
            .when(early & (A.intent(F.col("_verdict")) == "OUT_OF_SCOPE"), "out-of-scope").otherwise("direct")
        )
        said = R.durable(said.withColumn("stop", stop))
        asks = said.where("stop is null").select("query", "matter", F.col("call.tool").alias("tool"), F.col("call.query").alias("text"))
        found, fresh = [], []
        for domain, search, rows in (("matter", search_matter, asks.where("tool in ('search_matter', 'search_both') and matter is not null")), ("authority", search_authority, asks.where("tool in ('search_authority', 'search_both')"))):
            rows = rows.select("query", *(["matter"] if domain == "matter" else []), "text")
            if number > 1:
                # What a query has searched before is not searched again: its hits are those of then.
                known = asked.where(F.col("domain") == domain).select("query", "text", "first")
                same = rows.join(known, ["query", "text"]).select("query", F.col("first").alias("round"))
                found.append(hits.where(F.col("domain") == domain).join(same, ["query", "round"]).withColumn("round", F.lit(number)))
                rows = R.durable(rows.join(known, ["query", "text"], "left_anti"))
            fresh.append(rows.select("query", "text", F.lit(domain).alias("domain"), F.lit(number).alias("first")))
            if rows.isEmpty():
                continue
            got = search(rows)
            named = ["query", F.lit(domain).alias("domain"), F.lit(number).alias("round"), F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id")]
            found.append(_with_texts(got.select(*named), stores[domain], F.substring("text", 1, SHOWN_CHARS)) if domain in stores else got.select(*named, "text"))
        if found:
            hits = hits.unionByName(R.durable(reduce(DataFrame.unionByName, found)))
        asked = reduce(DataFrame.unionByName, fresh) if number == 1 else reduce(DataFrame.unionByName, fresh, asked)
        # A retrieval without hits is a round too: its counts are told.
        empty = F.lit("matter passages: 0, authority passages: 0.")
        seen = summaries(hits, size).select("query", F.col("prior").alias("_prior"))
        private = hits.where("domain = 'matter'").select("query").distinct().withColumn("_private", F.lit(True))
        again = said.join(seen, "query", "left").join(private, "query", "left")
        went = F.col("stop").isNull()
        again = again.select(
            "query", "matter", "text", F.when(went & F.lit(number == rounds), "rounds").otherwise(F.col("stop")).alias("stop"), (F.col("tool_rounds") + went.cast("int")).alias("tool_rounds"),
            F.when(F.col("stop") == "direct", F.col("reply")).alias("direct_text"), F.when(F.col("stop") == "provider-error", F.coalesce("error", "_failed")).alias("error"),
            F.when(went, F.coalesce("_prior", empty)).otherwise(F.col("prior")).alias("prior"), F.coalesce("_private", F.lit(False)).alias("evidence"),
        )
        state = R.durable(state.where("stop is not null").unionByName(again.select(*columns)))
    for domain, store in stores.items():
        own = F.col("domain") == domain
        hits = hits.where(~own).unionByName(_with_texts(hits.where(own).drop("text"), store, F.col("text")))
    stages = F.when(F.col("tool_rounds") > 0, F.array(F.lit("retrieving"))).otherwise(F.array().cast("array<string>"))
    return state.select("query", "stop", "tool_rounds", "direct_text", "error", stages.alias("stages")), hits

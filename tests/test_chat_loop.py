"""The loop with a scripted model: rounds, stages and reasons to stop; isolation, privacy before every call, empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analysis as A
from corpusloom.operators import chat_loop as C

ASK = lambda tool, q="q": json.dumps({"tool": tool, "query": q})
#: query, matter, text, replies by (kind, round); "!" fails.
SCRIPT = [
    (1, 7, "hello", {}),
    (2, 7, "What is notice?", {("decide", 1): "Prose answer.", ("classify", 1): "IN_SCOPE"}),
    (3, 7, "Pizza?", {("decide", 1): "Prose.", ("classify", 1): "OUT_OF_SCOPE"}),
    (4, 7, "Pizza!", {("decide", 1): ASK("out_of_scope")}),
    (5, 7, "Leave", {("decide", 1): ASK("search_both", "leave"), ("decide", 2): "Answer from hits."}),
    (6, None, "Law", {("decide", 1): ASK("search_both", "law"), ("decide", 2): ASK("search_matter", "x"), ("decide", 3): ASK("search_authority", "y")}),
    (7, 7, "Down", {("decide", 1): "!"}),
    (8, 7, "Down later", {("decide", 1): ASK("search_authority"), ("decide", 2): "!"}),
    (9, 7, "Late", {("decide", 1): ASK("search_authority"), ("decide", 2): ASK("out_of_scope")}),
    (10, 8, "Private", {("decide", 1): ASK("search_matter", "secret"), ("decide", 2): "never asked"}),
    (11, 7, "Classify down", {("decide", 1): "Prose.", ("classify", 1): "!"}),
    (12, 7, None, {("decide", 1): "Prose.", ("classify", 1): "IN_SCOPE"}),
]


@pytest.fixture(scope="module")
def ran(spark):
    sent, searched = [], []
    script = spark.createDataFrame([(q, k, n, t) for q, _, _, replies in SCRIPT for (k, n), t in replies.items()], "query long, kind string, round int, t string")

    def model(prompts, kind, number):
        sent.extend((r.query, kind, number, r.prompt) for r in prompts.collect())
        own = script.where((F.col("kind") == kind) & (F.col("round") == number))
        return prompts.join(own, "query", "left").select("query", F.when(F.col("t") != "!", F.col("t")).alias("reply"), F.when(F.col("t") == "!", "unreachable").alias("error"))

    def search(domain):
        def go(rows):
            searched.extend((domain, r.query) for r in rows.collect())
            body = F.concat(F.lit("[matter: doc 1] " if domain == "matter" else "law "), "text")
            return rows.select("query", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"), F.lit("d").alias("id"), body.alias("text"))

        return go

    queries = spark.createDataFrame([(q, m, t) for q, m, t, _ in SCRIPT], "query long, matter long, text string")
    # Query 10's matter evidence may not leave the house.
    privacy = lambda prompt, evidence: F.when(evidence & F.contains(prompt, F.lit("secret")), "violation").otherwise("ok")
    out, hits = C.run(queries, model, search("matter"), search("authority"), privacy, lambda t: F.lit("Hi."))
    return {r.query: r for r in out.collect()}, hits.collect(), sent, searched


def test_reasons_rounds_and_stages(ran):
    got = {q: (r.stop, r.tool_rounds, r.direct_text) for q, r in ran[0].items()}
    assert got == {
        1: ("greeting", 0, "Hi."), 2: ("direct", 0, "Prose answer."), 3: ("out-of-scope", 0, None), 4: ("out-of-scope", 0, None), 5: ("direct", 1, "Answer from hits."), 6: ("rounds", 3, None),
        7: ("provider-error", 0, None), 8: ("provider-error", 1, None), 9: ("late-verdict", 1, None), 10: ("violation", 1, None), 11: ("provider-error", 0, None), 12: ("direct", 0, "Prose."),
    }
    assert all(r.stages == (["retrieving"] if r.tool_rounds else []) for r in ran[0].values())
    assert ran[0][7].error == ran[0][11].error == "unreachable" and ran[0][2].error is None


def test_isolation_and_privacy(ran):
    _, hits, sent, searched = ran
    # Without a matter no store of evidence is asked, whatever the tool.
    assert ("matter", 6) not in searched and searched.count(("authority", 6)) == 2
    assert {(h.domain, h.round) for h in hits if h.query == 5} == {("matter", 1), ("authority", 1)} and {h.domain for h in hits if h.query == 6} == {"authority"}
    # The barred prompt was never sent; classification is asked of first-round prose alone.
    assert not any(q == 10 and n == 2 for q, _, n, _ in sent) and sorted(q for q, k, _, _ in sent if k == "classify") == [2, 3, 11, 12]
    assert not any(q == 1 for q, *_ in sent)


def test_prompts_carry_what_was_found(ran):
    prompt = next(p for q, k, n, p in ran[2] if (q, k, n) == (5, "decide", 2))
    assert "matter passages: 3, authority passages: 3.\nExcerpts:\n[matter: doc 1] leave\n---\n[matter: doc 1] leave\n---\n[matter: doc 1] leave\n---\nlaw leave\nQuestion: Leave" in prompt
    # A search of a matter that is not there counts as a round without hits.
    assert "matter passages: 0, authority passages: 3." in next(p for q, k, n, p in ran[2] if (q, k, n) == (6, "decide", 3))


def test_empty(spark):
    none = spark.createDataFrame([], "query long, matter long, text string")
    out, hits = C.run(none, None, None, None, None, lambda t: t)
    assert out.count() == hits.count() == 0 and A.TOOLS[-1] == "out_of_scope"


def test_a_search_is_made_once(spark):
    """A text that a query has searched before is not searched again; its hits count in the later round all the same."""
    searched = []

    def search(rows):
        searched.extend((r.query, r.text) for r in rows.collect())
        return rows.select("query", F.lit(1).alias("rank"), F.lit("d").alias("id"), "text")

    def model(prompts, kind, number):
        # Query 1 asks the same in every round, query 2 something else in the second and the first text again in the third.
        text = F.when((F.col("query") == 2) & F.lit(number == 2), "other").otherwise("same")
        return prompts.select("query", F.to_json(F.struct(F.lit("search_authority").alias("tool"), text.alias("query"))).alias("reply"), F.lit(None).cast("string").alias("error"))

    queries = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "query long, matter long, text string")
    out, hits = C.run(queries, model, search, search, lambda p, e: F.lit("ok"), lambda t: t)
    assert {(r.query, r.stop, r.tool_rounds) for r in out.collect()} == {(1, "rounds", 3), (2, "rounds", 3)}
    assert sorted(set(searched)) == [(1, "same"), (2, "other"), (2, "same")] and len(searched) == 3
    assert sorted((h.query, h.round, h.text) for h in hits.collect()) == [(1, 1, "same"), (1, 2, "same"), (1, 3, "same"), (2, 1, "same"), (2, 2, "other"), (2, 3, "same")]


def test_texts_of_a_store_are_not_written_with_hits(spark, monkeypatch):
    """Every query finds the same long passage: rounds write how it begins, the returned hits have all of it."""
    long, written = "long " * 20_000, []
    store = spark.createDataFrame([(5, long), (6, "short"), (7, None)], "id long, text string")
    durable = C.R.durable

    def watched(rows):
        rows = durable(rows)
        texts = [c for c, kind in rows.dtypes if kind == "string"]
        written.extend(len(v) for r in rows.select(*texts).collect() for v in r if v is not None)
        return rows

    def authority(rows):
        return rows.crossJoin(store.select("id")).select("query", (F.col("id") - 4).alias("rank"), "id")

    def model(prompts, kind, number):
        prompts_sent.extend(r.prompt for r in prompts.collect())
        return prompts.select("query", F.lit(ASK("search_both")).alias("reply"), F.lit(None).cast("string").alias("error"))

    prompts_sent = []
    matter = lambda rows: rows.select("query", F.lit(1).alias("rank"), F.lit("m").alias("id"), F.lit("of the matter").alias("text"))
    monkeypatch.setattr(C.R, "durable", watched)
    queries = spark.createDataFrame([(q, 1 if q == 1 else None, f"text {q}") for q in range(4)], "query long, matter long, text string")
    out, hits = C.run(queries, model, matter, authority, lambda p, e: F.lit("ok"), lambda t: t, rounds=2, stores={"authority": store})
    assert {(r.query, r.stop, r.tool_rounds) for r in out.collect()} == {(q, "rounds", 2) for q in range(4)}
    assert max(written) < 2_000
    assert any(f"authority passages: 3.\nExcerpts:\n{long[:250]}\n---\nshort\n---\n\nQuestion: text 0" in p for p in prompts_sent)
    want = [(q, "authority", n, i, str(i + 4), t) for q in range(4) for n in (1, 2) for i, t in ((1, long), (2, "short"), (3, None))] + [(1, "matter", n, 1, "m", "of the matter") for n in (1, 2)]
    key = lambda r: r[:5]
    assert sorted(((h.query, h.domain, h.round, h.rank, h.id, h.text) for h in hits.collect()), key=key) == sorted(want, key=key)

"""Operators whose order or folds SQL does not state, on small literals."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import analysis as A
from corpusloom.operators import relational as R
from corpusloom.operators import retrieval as H
from corpusloom.operators import serving as V
from corpusloom.plans.registry import SECTIONS, inline
from corpusloom.sources import catalog, embedding
from corpusloom.streaming.incremental import ingest


def test_tenant_guard(spark):
    with pytest.raises(ValueError):
        H.scoped(spark.range(1), "id", None)


def test_hash_index_and_uuid(spark):
    words = ["conge", "annuel", "المادة", "été"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.hash_index(F.col("w")).alias("i"), T.uuid5_url(F.col("w")).alias("u")).collect()
    for r in got:
        assert r.i == int.from_bytes(hashlib.sha256(r.w.encode()).digest()[:4], "big") % 2048
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.w))


def test_both_legs_surface(spark):
    docs = spark.createDataFrame([(1, "conge annuel paye"), (2, "autre chose")], "id long, text string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(0, "conge annuel paye", [1.0, 0.0])], "query long, text string, vector array<float>")
    assert {r.id for r in H.hybrid(q, docs, vectors).collect()} == {1, 2}


def _recalls(spark, chunks, queries, buckets, k):
    v = spark.createDataFrame([(i, b, list(map(float, x))) for i, (x, b) in enumerate(zip(chunks, buckets, strict=True))], "id long, bucket string, vector array<double>")
    q = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(queries)], "query long, vector array<double>")
    return {r.bucket: (r.n, r.recall) for r in H.recall_at_k(q, v, k).collect()}


def test_recall_within_the_sample_and_its_buckets(spark):
    eye = [[float(i == j) for j in range(8)] for i in range(8)]
    assert _recalls(spark, eye, eye, ["all"] * 8, 1) == {"all": (8, 1.0), None: (8, 1.0)}
    # All queries are the first chunk: only one finds its own.
    assert _recalls(spark, eye[:5], [eye[0]] * 5, ["x"] * 5, 1)[None] == (5, 0.2)
    # A chunk of another bucket is nearer: the bucket's recall does not see it, the whole one does.
    assert _recalls(spark, [[1, 0], [0, 1]], [[0.4, 1], [0.4, 1]], ["a", "b"], 1) == {"a": (1, 1.0), "b": (1, 1.0), None: (2, 0.5)}


def test_summary_cap(spark):
    head = "matter passages: 2, authority passages: 1."
    rows = [(0, None), (1, ""), (2, f"{head}\nExcerpts:\n{'M' * 250}\n---\n{'A' * 250}"), (3, "x" * 500), (4, f"{head}\n{'a ' * 300}"), (5, "short")]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", V.cap_summary(F.col("t"), 120).alias("c")).collect()}
    assert got[0] is None and got[1] == "" and got[5] == "short" and got[3] == "x" * 120
    assert len(got[2]) == 120 and got[2].startswith(f"{head}\nExcerpts:\nM") and got[2].endswith("M …")
    assert got[4].startswith(f"{head}\na a") and got[4].endswith("a …") and len(got[4]) <= 120
    assert spark.createDataFrame([("keep me",)], "t string").select(V.cap_summary(F.col("t"), 0)).first()[0] == "keep me"


def test_tool_envelopes(spark):
    ok = '{"tool": "search_both", "query": "conge annuel"}'
    cases = [
        (ok, ("search_both", "conge annuel")), (f"  {ok}\n", ("search_both", "conge annuel")), (f"Sure. {ok} One moment.", ("search_both", "conge annuel")), (f"[{ok}]", ("search_both", "conge annuel")),
        ('{"wrapper": {"tool": "search_authority", "query": "nested"}}', ("search_authority", "nested")), ('{{"tool": "search_both", "query": "braced"}}', ("search_both", "braced")),
        ('{"tool": "search_both", "query": "  spaced  "}', ("search_both", "spaced")), ('{"tool": "search_both"}', None), ('{"tool": "search_both", "query": "   "}', None), ('{"tool": "nope", "query": "x"}', None),
        ('{"query": "x"}', None), ('"just a string"', None), ("[1, 2, 3]", None), ("not json {{{", None), ('{"tool": "search_both", "query": 7}', None), ("", None), (None, None), ('{"tool": "out_of_scope", "query": "pizza"}', ("out_of_scope", "pizza")),
        ('{"tool": "search_both", "query": "a {b} c"}', ("search_both", "a {b} c")), ('{"tool": "nope", "query": "x"} {"tool": "search_matter", "query": "y"}', ("search_matter", "y")),
    ]
    got = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "i int, t string").select("i", A.tool_call(F.col("t")).alias("c")).collect()
    assert {r.i: r.c and tuple(r.c) for r in got} == dict(enumerate(w for _, w in cases))


def test_content_mark_sees_pairs(spark):
    one, two = (spark.createDataFrame([(x,), (x,), (9,)], "v int") for x in (1, 2))
    assert V.content_mark(one) != V.content_mark(two) and V.content_mark(one) == V.content_mark(one.orderBy("v")) and V.content_mark(one.limit(0))[0] == 0


def test_lexical_topk_of_every_tenant(spark, sf):
    from corpusloom.plans import registry

    sources = {r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect()}
    got = registry.QUERIES["lexical_topk_tenants"](spark, sf)
    assert {r.source for r in got.select("source").distinct().collect()} == sources
    docs = H.scoped(spark.read.parquet(f"{sf}/documents.parquet"), "source", "src1").select(F.col("doc_id").alias("id"), "text")
    one = H.lexical_topk(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query"), "text"), docs, 10)
    assert got.where("source = 'src1'").select(one.columns).exceptAll(one).isEmpty() and one.exceptAll(got.where("source = 'src1'").select(one.columns)).isEmpty()


def test_dense_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_QUERIES", 10)
    v = spark.createDataFrame([(i, [float(i % 7), 1.0 + i]) for i in range(45)], "id long, vector array<float>")
    got = H.dense_scores(v.select(F.col("id").alias("query"), "vector"), v)
    assert got.count() == got.select("query", "id").distinct().count() == 45 * 45


def test_mmr_prefers_new_words(spark):
    rows = [(0, 1, 10, "a b c"), (0, 2, 11, "a b c"), (0, 3, 12, "x y z")]
    got = H.mmr(spark.createDataFrame(rows, "query long, rank int, id long, text string"), 2).orderBy("pick").collect()
    assert [r.id for r in got] == [10, 12]
    assert H.mmr(spark.createDataFrame(rows, "query long, rank int, id long, text string"), 3).count() == 3


def test_sentences_and_pack(spark):
    text = "One. Two! Three? " * 300
    r = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s"), T.pack(T.sentences(F.col("t"))).alias("p")).first()
    assert r.s == [x for x in re.split(r"(?<=[.!?\n])\s+", text) if x.strip()]
    assert " ".join(r.p) == " ".join(r.s) and all(len(p.replace(" ", "")) >= 1500 for p in r.p[:-1])


def test_batches_match_fold(spark):
    lengths = [10, 24_000, 1, 30_000, *[700] * 70]
    plan = spark.createDataFrame([(lengths,)], "n array<int>").select(T.batch_plan(F.col("n")).alias("b")).first().b
    assert plan == [e - s for s, e in embedding.batches(["x" * n for n in lengths])] and sum(plan) == len(lengths)


def test_dates_obligations(spark):
    s = inline(spark, SECTIONS)
    assert {(r.date, r.label) for r in A.dates(s).collect()} == {("2024-03-01", "effective date"), ("12/02/2024", "notice date"), ("5.6.2023", "mentioned date")}
    assert A.obligations(s).count() == 4


def test_content_dedup_without_hash(spark):
    f = spark.createDataFrame([("a", None), ("b", None), ("c", "x"), ("d", "x")], "path string, sha string")
    assert {(r.path, r.winner) for r in R.content_dedup(f, "path", "sha").collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "c")}


def test_greeting(spark):
    rows = [("Bonjour !", True), ("hello, I have a question", False), ("السلام عليكم", True), ("", False)]
    for r in spark.createDataFrame(rows, "t string, want boolean").select("want", A.greeting(F.col("t")).alias("got")).collect():
        assert r.want == r.got


def test_embed_isolates_killers(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    got = embedding.embed(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id long, text string"), picky).collect()
    assert {r.id: (r.vector, bool(r.error)) for r in got} == {1: ([2.0], False), 2: (None, True), 3: ([0.0], False)}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"one")
    (tmp_path / "y.txt").write_bytes("é".encode())
    (tmp_path / "z.txt").write_bytes(b"\xff\xfe")
    assert catalog.scan(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"one").hexdigest()
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in catalog.read_texts(spark, str(tmp_path)).collect()}
    assert got["y.txt"] == ("é", None) and got["z.txt"] == (None, "not utf-8")


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(5).write.parquet(src)
    ingest(spark, src, "id long", out, ck)
    spark.range(5, 8).write.mode("append").parquet(src)
    ingest(spark, src, "id long", out, ck)
    assert spark.read.parquet(out).count() == 8


def test_heading_sections(spark):
    from corpusloom.operators import structure as S
    from corpusloom.plans.fixtures import PAGED

    got = {(r.doc, r.section): r for r in S.heading_sections(inline(spark, PAGED)).collect()}
    assert got[1, "s1"].title == "Préambule du texte" and got[1, "s2"].title == "Article 1" and got[1, "s3"].title == "Article 2"
    assert (got[1, "s2"].page_start, got[1, "s2"].page_end, got[1, "s2"].needs_review, got[1, "s2"].confidence) == (1, 2, True, 0.9)


def test_verified_writes(spark, tmp_path):
    from corpusloom.operators import serving as V

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, vector array<float>")
    with pytest.raises(ValueError):
        V.write_verified(rows, str(tmp_path / "bad"), "id", dim=3)
    assert not (tmp_path / "bad").exists()
    assert {r.status for r in V.write_verified(rows, str(tmp_path / "t"), "id", dim=2).collect()} == {"verified"}
    mark = V.content_mark(rows)
    assert V.read_verified(spark, str(tmp_path / "t"), mark).count() == 2
    with pytest.raises(ValueError):
        V.read_verified(spark, str(tmp_path / "t"), (2, 0))


def test_long_frame(spark):
    from corpusloom.operators import serving as V

    rows = spark.createDataFrame([(1, "a" * 1_200_000)], "id long, text string")
    raw = rows.select("id", F.concat(F.lit('data: {"type": "delta", "text": "'), "text", F.lit('"}')).alias("line"))
    assert V.parse_frames(raw).select(F.length("text")).collect()[0][0] == 1_200_000


def test_rerank_scorer(spark):
    from corpusloom.operators import serving as V

    hits = spark.createDataFrame([(0, 1, 10, "a"), (0, 2, 11, "abc")], "query long, rank int, id long, text string")
    assert V.rerank(hits, 1).first().id == 10 and V.rerank(hits, 1, lambda q, t: F.length(t)).first().id == 11


def test_lexical_topk_of_many_queries_is_bounded_by_lengths(spark, monkeypatch):
    """The same best as of all products, ties, copies and blanks included; tasks send on few rows, however many they are."""
    import random

    dice = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(dice.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    texts = [some(int(2 ** dice.uniform(0, 9))) for _ in range(500)]
    texts += [texts[0]] * 20 + [max(texts, key=len)] * 6 + [None, "", "alone", "w1 w1 w1 w1"]
    dice.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(12)
    asked = [(q, some(dice.randint(1, 12))) for q in range(60)] + [(60, "alone"), (61, "nowhere"), (62, ""), (63, None), (64, "w59")]
    queries = spark.createDataFrame(asked, "query long, text string")
    sent, top_k = [], H.top_k
    for name, value in {"PART": 16, "LONGEST": 24, "STEP": 8, "SLICE": 32}.items():
        monkeypatch.setattr(H, name, value, raising=False)
    rows = lambda df: sorted((r.query, r["rank"], r.id, r.score) for r in df.collect())
    for k in (1, 3, 40):
        want = rows(top_k(H.lexical_scores(queries, docs), k))
        with monkeypatch.context() as m:
            m.setattr(H, "top_k", lambda scores, *a: (sent.append(scores.count()), top_k(scores, *a))[1])
            got = rows(H.lexical_topk(queries, docs, k))
        assert got == want and {q for q, *_ in got} >= {60} and not {61, 62, 63} & {q for q, *_ in got}
        if k == 3:
            # The last is what was put together; every one of 12 tasks sent k rows of each query, and more, before.
            assert sent[-1] < 12 * k * len(asked) / 2

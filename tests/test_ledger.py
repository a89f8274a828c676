"""Catalogue runs and resumed embedding over small folders."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import ledger as L


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for rel, content in {"cat/aaa ظهير شريف رقم 1.pdf": b"same", "cat/zzz ظهير شريف رقم 1.pdf": b"same", "cat/sub/notes.PDF": b"other", "other/broken.pdf": b"broken", "other/notes.txt": b"x"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(content)
    return str(root)


def count_pages():
    def run(content):
        if content.startswith(b"broken"):
            raise ValueError("not a document")
        return len(content)

    return run


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_and_duplicates(spark, tree):
    scan = L.scan_files(spark, tree, count_pages=count_pages())
    got = {r.rel: r for r in scan.collect()}
    assert set(got) == {"cat/aaa ظهير شريف رقم 1.pdf", "cat/zzz ظهير شريف رقم 1.pdf", "cat/sub/notes.PDF", "other/broken.pdf"}
    broken = got["other/broken.pdf"]
    assert broken.error == "page-count: not a document" and len(broken.sha256) == 64 and broken.pages is None and broken.bytes == 6
    plan = {r.rel: (r.winner, r.is_duplicate) for r in L.planned(scan).collect()}
    assert plan["cat/zzz ظهير شريف رقم 1.pdf"] == ("cat/aaa ظهير شريف رقم 1.pdf", True) and sum(d for _, d in plan.values()) == 1
    # A limit takes the first winners and changes no duplicate.
    gated = {r.rel: r.is_duplicate for r in L.planned(scan, 1).collect()}
    assert gated == {"cat/aaa ظهير شريف رقم 1.pdf": False, "cat/zzz ظهير شريف رقم 1.pdf": True}
    with pytest.raises(ValueError):
        L.planned(scan, -1)


def test_files_without_a_hash_win_themselves(spark):
    scan = spark.createDataFrame([("a.pdf", None, 0, None, "unreadable"), ("b.pdf", None, 0, None, "unreadable")], "rel string, sha256 string, bytes long, pages long, error string")
    assert {(r.rel, r.winner, r.is_duplicate) for r in L.planned(scan).collect()} == {("a.pdf", "a.pdf", False), ("b.pdf", "b.pdf", False)}


def test_upsert_is_a_merge_and_a_second_run_changes_nothing(spark, tree):
    scan = L.scan_files(spark, tree, count_pages=count_pages())
    old = [("gone.pdf", "s", 1, 1, "c", "x", "v", "e", "parsed", None), ("cat/sub/notes.PDF", "old", 9, 9, "kept", "kept", "kept", "kept", "pending", None), ("cat/zzz ظهير شريف رقم 1.pdf", "keep", 5, 5, "c", "s", "v", "e", "pending", None)]
    once = L.upsert(spark.createDataFrame(old, L.LEDGER), scan)
    got = {r.path: r for r in once.collect()}
    assert len(got) == 5 and got["gone.pdf"].sha256 == "s" and got["gone.pdf"].parse_status == "parsed"
    first, second = got["cat/aaa ظهير شريف رقم 1.pdf"], got["cat/zzz ظهير شريف رقم 1.pdf"]
    assert (first.parse_status, first.quarantine_reason, first.bytes, first.pages) == ("parsed", None, 4, 4) and first.source == "ظهير شريف"
    # A duplicate changes its state alone.
    assert (second.parse_status, second.quarantine_reason, second.sha256, second.bytes) == ("quarantined", "duplicate-of:cat/aaa ظهير شريف رقم 1.pdf", "keep", 5)
    assert (got["other/broken.pdf"].parse_status, got["other/broken.pdf"].quarantine_reason) == ("failed", "page-count: not a document")
    notes = got["cat/sub/notes.PDF"]
    assert (notes.parse_status, notes.quarantine_reason, notes.bytes) == ("quarantined", L.NO_TYPE, 5) and not any(r.conflict for r in got.values())
    again = L.upsert(once.drop("conflict"), scan)
    assert table(again) == table(once)


def test_illegal_moves_keep_the_state(spark):
    scan = spark.createDataFrame([("a.pdf", "s", 1, 1, None), ("b.pdf", "s", 1, 1, None)], "rel string, sha256 string, bytes long, pages long, error string")
    old = spark.createDataFrame([("b.pdf", "s", 1, 1, "c", "x", "v", "e", "parsed", None)], L.LEDGER)
    got = {r.path: (r.parse_status, r.conflict) for r in L.upsert(old, scan).collect()}
    assert got["b.pdf"] == ("parsed", "parsed to quarantined")
    assert L.upsert(spark.createDataFrame([], L.LEDGER), scan.limit(0)).count() == 0


# ---- embedding


def chunks(spark, n, status="pending"):
    return spark.createDataFrame([(f"c{i}", f"text {i}", status) for i in range(n)], "chunk_id string, text string, status string")


def test_killed_run_embeds_nothing_twice(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    log.mkdir()

    def embedder(die):
        where = str(log)

        def go(texts):
            import os
            import uuid

            if die and any(t == "text 13" for t in texts):
                raise SystemError("killed")
            for t in texts:
                with open(os.path.join(where, uuid.uuid4().hex), "w") as f:
                    f.write(t)
            return [[float(len(t)), 1.0] for t in texts]

        return go

    def killer(texts):
        import os

        if any(t == "text 13" for t in texts):
            os._exit(1)
        return embedder(False)(texts)

    rows = chunks(spark, 30)
    with pytest.raises(Exception):  # noqa: B017  the worker dies with its text
        L.resume_embed(rows, cache, killer, 2, steps=5, attempts=1)
    before = {p.read_text() for p in log.iterdir()}
    held = L.read_cache(spark, cache).count()
    out = {r.chunk_id: r for r in L.resume_embed(rows, cache, embedder(False), 2, steps=5).collect()}
    assert len(out) == 30 and {r.status for r in out.values()} == {"embedded"} and sum(r.reused for r in out.values()) == held and before
    assert L.read_cache(spark, cache).count() == 30
    # What was in the cache when the run died was not sent again.
    sent = [p.read_text() for p in log.iterdir()]
    assert all(sent.count(r.text) == 1 for r in rows.collect() if out[r.chunk_id].reused)
    n = len(sent)
    again = L.resume_embed(rows, cache, embedder(False), 2, steps=5)
    assert again.where("reused").count() == 30 and len(list(log.iterdir())) == n


def test_killers_are_marked_and_wrong_sizes_refused(spark, tmp_path):
    def picky(texts):
        if any(t == "text 3" for t in texts):
            raise ConnectionError("dropped")
        return [[1.0, 2.0] for _ in texts]

    got = {r.chunk_id: (r.status, r.error) for r in L.resume_embed(chunks(spark, 6), str(tmp_path / "a"), picky, 2, steps=2, attempts=1).collect()}
    assert got["c3"][0] == "failed" and "dropped" in got["c3"][1] and sum(s == "embedded" for s, _ in got.values()) == 5
    with pytest.raises(Exception, match="has not 3 dimensions"):
        L.resume_embed(chunks(spark, 2), str(tmp_path / "b"), picky, 3, steps=1)
    assert L.read_cache(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError, match="cached vector"):
        L.resume_embed(chunks(spark, 2), str(tmp_path / "a"), picky, 4)
    with pytest.raises(ValueError, match="served budget"):
        L.resume_embed(chunks(spark, 2).withColumn("n", F.lit(451)), str(tmp_path / "c"), picky, 2, tokens="n")
    assert L.resume_embed(chunks(spark, 0), str(tmp_path / "d"), picky, 2, steps=1).count() == 0

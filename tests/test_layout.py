"""Payload filters prune folders and buckets; cached searches are asked once and know their tenant."""

import re
import uuid

import pytest

from corpusloom.sources import layout as Y


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_prune_folders_and_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 40}", ["fr", "ar", None][i % 3], f"c{i % 2}", f"text {i}") for i in range(600)], "id long, source string, language string, category string, text string")
    name = f"payload_{uuid.uuid4().hex}"
    table = Y.write_payloads(rows, name, str(tmp_path / "t"), 8)
    got = Y.where_payload(table, language="fr", category="c1", source="s9")
    want = rows.where("language = 'fr' and category = 'c1' and source = 's9'")
    assert {r.id for r in got.collect()} == {r.id for r in want.collect()} != set()
    text = plan(got)
    assert re.search(r"PartitionFilters: \[[^\]]*language[^\]]*= fr[^\]]*category", text) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(source,s9\)", text)
    # A grouping by source reads the one bucket and shuffles nothing.
    grouped = plan(got.groupBy("source").count())
    assert "SelectedBucketsCount: 1 out of 8" in grouped and "Exchange" not in grouped
    files = got.inputFiles()
    assert len(files) < len(table.inputFiles()) / 5 and all("language=fr/category=c1" in f for f in files)
    assert Y.where_payload(table, language=Y.NONE).count() == 200
    with pytest.raises(ValueError):
        Y.where_payload(table, text="x")
    spark.sql(f"drop table {name}")


def test_cached_searches(spark, tmp_path):
    asked, cache = [], str(tmp_path / "cache")

    def search(rows):
        found = [r.query for r in rows.collect()]
        asked.extend(found)
        return spark.createDataFrame([(q, r, f"{q}{r}", 1.0 / r) for q in found if q != "none" for r in range(1, 5)], "query string, rank int, id string, score double")

    ask = lambda qs, domain="authority", matter=None, k=3: sorted(tuple(r) for r in Y.cached_search(spark.createDataFrame([(q,) for q in qs], "query string"), cache, domain, matter, k, search).collect())
    one = ask(["a", "a", "none"])
    assert [r[1] for r in one] == [1, 2, 3] and sorted(asked) == ["a", "none"]
    assert ask(["a", "none"]) == one and len(asked) == 2
    # Another query, another k, another domain or matter: each is a search of its own.
    ask(["a", "b"])
    ask(["a"], k=2)
    ask(["a"], "matter", 1)
    ask(["a"], "matter", 2)
    ask(["a"], "matter", 2)
    assert asked[2:] == ["b", "a", "a", "a"]
    with pytest.raises(ValueError):
        ask(["a"], "matter")

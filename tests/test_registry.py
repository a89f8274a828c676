"""Every query of the registry against the SQL beside it, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _sorted(rows):
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert _sorted([tuple(r[c] for c in cols) for r in df.collect()]) == _sorted(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["dates", "obligations", "keyword_classify", "glossary_hits"])
def test_sections_of_documents(spark, tmp_path, name):
    text = "Mme Salma Berrada must pay from 2024-05-06."
    spark.createDataFrame([(77, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert 77 in {r.section for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}

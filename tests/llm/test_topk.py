"""Exact inner products against brute force: pruning changes nothing; ties, repeats, nulls, widths, copies, empty tables."""

import math
import os
import random

import duckdb
import numpy as np
import pytest

from corpusloom.llm import norm_topk

SCHEMA = "vec_id long, embedding array<float>, codes int, rank string"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % 50 == 0:
            all_ = [(-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0, j) for b, (j, v) in enumerate(ok) if b != a]
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(all_)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in norm_topk.top_k(df, **kw).collect()), key=str)


def vectors(n, seed, width=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, width))
    return [(i, [float(x) for x in (centre[rng.integers(5)] + 0.3 * rng.normal(size=width)) * rng.lognormal(0, 1)]) for i in range(n)]


@pytest.mark.parametrize(("size", "group"), [(16, 3), (100_000, 1000)])
def test_against_brute_force(spark, size, group):
    rows = vectors(700, 1)
    rows += [(i, rows[50][1]) for i in range(1000, 1300)]  # a third of copies
    rows += [(50, rows[50][1]), (None, rows[3][1]), (None, [1.0] * 12), (2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")] + [0.0] * 11), (2200, []), (2250, [2.0, -1.0]), (2300, [0.0] * 12)]
    random.Random(2).shuffle(rows)
    got = run(spark, rows, size=size, group=group)
    assert got == brute(rows) and {r[0] for r in got} >= {50, 2200, 2250, 2300}


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 131072)]
    assert run(spark, [(0, [-1.0, 3e30]), (7, [2.0, 3e30]), (8, [2.0, -3e30])]) == [(0, 1, 7, (1 << 52) - 131072), (0, 2, 8, -(1 << 52) - 131072)]


def test_bounds_prune():
    """Rows in the order of their length: most are never multiplied out, none that belongs to the result is missing."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 16)) * np.linspace(3, 0.01, 4000)[:, None] * np.linspace(2, 0.1, 16)).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(1), kind="stable")]
    q = x[::100].copy()
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    seen = []
    add = norm_topk.Best.add
    norm_topk.Best.add = lambda self, query, *a: (seen.append(len(query)), add(self, query, *a))
    pairs, norm_topk.PAIRS = norm_topk.PAIRS, 4000
    try:
        best = norm_topk.search(q, x, np.full(len(q), -1), np.arange(len(x)), turn, 5)
    finally:
        norm_topk.Best.add, norm_topk.PAIRS = add, pairs
    assert sum(seen) < 0.2 * q.shape[0] * x.shape[0]
    for i in range(len(q)):
        assert sorted(best.score[best.query == i])[::-1] == sorted((x @ q[i]).tolist())[: -6 : -1]


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{os.path.join(sf, 'embeddings.parquet')}'")
    got = norm_topk.op13_exact_topk(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(norm_topk.oracle_sql()).fetchall())

"""Exact top-k inner products over integer-coded vectors: norm order, rotated partial sums, Cauchy-Schwarz bounds.

A component x becomes floor(256 * x), so scores are integers. Vectors are ordered by descending length and cut into slices of bounded
size. Every query first meets the longest slice, which gives its k-th score so far; it goes on only to the slices whose longest vector
can still reach that score (|q| |x| bounds the product; since slices come by length, these are the first few). Within a slice, query
and vectors are turned by the singular vectors of the whole table, largest first: a sum over the leading components plus the product of
the two residual lengths bounds the score, and only pairs whose bound reaches the query's threshold are multiplied out, in integers.
Rotation and bounds decide how much is computed, never what is returned.

Slices of vectors and groups of queries meet by an equi-join on (slice, group); both sizes are bounded, so no task grows with the input.

Defined results: rows whose vector is null or holds null or non-finite components take no part; shorter vectors count as padded with
zeros, an empty one as zeros; codes beyond +-2^26 are held at that; a query is never its own candidate, but a repeated row is; ties go
to the smaller vec_id (null last, then equal ids one row each); a null vec_id is no query; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

K, EVERY, SCALE = 5, 50, 256
CLAMP = 1 << 26
#: Vectors of a slice (it grows only so that there are never more than SLICES of them) and queries of a group.
SLICE, SLICES, GROUP = 8192, 1_000_000, 4096
#: Leading rotated components, as a part of all, after which bounds are compared.
STEPS = (0.25, 0.5)
#: Pairs that are bounded, and multiplied out one by one, at a time.
PAIRS = 1 << 20
_FOUND = "_query bigint, query_id bigint, vec_id bigint, _row bigint, score bigint"


def coded(vectors: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, codes (array of int) and norm2 of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    code = F.transform("x", lambda v: F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), F.floor(v * scale))).cast("int"))
    norm2 = F.aggregate("codes", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return rows.where(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", code.alias("codes")).withColumn("norm2", norm2)


def _matrix(rows: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    column = rows.column("codes")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows, largest first, from second moments that the tasks sum."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch, width).astype(float)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((width, width))
    for r in rows.select("codes").mapInArrow(moments, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = r.v
    return np.linalg.eigh(out)[1][:, ::-1]


class Best:
    """The k best candidates of each of n queries so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, -np.inf) if floor is None else floor.astype(float)
        self.query, self.at, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, at: np.ndarray, score: np.ndarray, rank: np.ndarray) -> None:
        """rank: the place of each candidate when ties are ordered."""
        query, at, score = np.append(self.query, query), np.append(self.at, at), np.append(self.score, score)
        order = np.lexsort((rank[at], -score, query))
        query, at, score = query[order], at[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.query, self.at, self.score = query[keep], at[keep], score[keep]


def search(q: np.ndarray, x: np.ndarray, own: np.ndarray, rank: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best rows of x (by descending length) for each row of q; own: the row of x that is the query itself, or -1."""
    best, width = Best(len(q), k, floor), x.shape[1]
    qf, xf = q.astype(float), x.astype(float)
    qr, xr = qf @ turn, xf @ turn
    length = np.sqrt((xf * xf).sum(1)), np.sqrt((qf * qf).sum(1))
    exact = float(length[0].max(initial=0)) * float(length[1].max(initial=0)) < 2.0**52
    slack = 1e-9 * (1 + float(length[0].max(initial=0)) * float(length[1].max(initial=0)))
    heads = sorted({max(1, int(width * s)) for s in STEPS}) if width else []
    rest = {h: (np.sqrt((qr[:, h:] ** 2).sum(1)), np.sqrt((xr[:, h:] ** 2).sum(1))) for h in heads}
    wide = max(1, min(len(x), PAIRS // max(1, len(q))))
    for a in range(0, len(x), wide):
        b = min(a + wide, len(x))
        # No later vector is longer: a query whose threshold exceeds this bound is done.
        live = np.flatnonzero(length[1] * (length[0][a:b].max() if b > a else 0) + slack >= best.floor)
        if not len(live):
            break
        part, done, cols = np.zeros((len(live), b - a)), 0, np.arange(a, b)
        for h in heads:
            part += qr[live, done:h] @ xr[cols, done:h].T
            done = h
            may = part + np.outer(rest[h][0][live], rest[h][1][cols]) + slack >= best.floor[live, None]
            rows_, cols_ = may.any(1), may.any(0)
            live, cols, part, may = live[rows_], cols[cols_], part[rows_][:, cols_], may[rows_][:, cols_]
        if not heads:
            may = np.ones((len(live), len(cols)), bool)
        i, j = np.nonzero(may)
        if not len(i):
            continue
        if exact and len(i) * 8 > may.size:
            score = np.rint(qf[live] @ xf[cols].T).astype(np.int64)[i, j]
        else:
            score = np.concatenate([(q[live[i[s : s + PAIRS // 16]]] * x[cols[j[s : s + PAIRS // 16]]]).sum(1) for s in range(0, len(i), PAIRS // 16)])
        i, j = live[i], cols[j]
        take = (own[i] != j) & (score >= best.floor[i])
        best.add(i[take], j[take], score[take], rank)
    return best


def _answer(queries: pa.Table, cands: pa.Table, width: int, turn: np.ndarray, k: int, floor: np.ndarray | None) -> tuple[Best, pa.Table]:
    """Search of one slice by one group, and the result as rows."""
    cands = cands.take(pa.array(np.lexsort((cands.column("_row").to_numpy(), -cands.column("norm2").to_numpy()))))
    rows, query = cands.column("_row").to_numpy(), queries.column("_query").to_numpy()
    ids, null = cands.column("vec_id").fill_null(0).to_numpy(), np.array(cands.column("vec_id").is_null())
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((rows, ids, null))] = np.arange(len(rows))
    sort = np.argsort(rows)
    place = np.minimum(np.searchsorted(rows, query, sorter=sort), len(rows) - 1)
    own = np.where(rows[sort[place]] == query, sort[place], -1)
    best = search(_matrix(queries, width), _matrix(cands, width), own, rank, turn, k, floor)
    q, c = pa.array(best.query), pa.array(best.at)
    return best, pa.table({"_query": queries.column("_query").take(q), "query_id": queries.column("query_id").take(q), "vec_id": cands.column("vec_id").take(c), "_row": cands.column("_row").take(c), "score": pa.array(best.score)})


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, size: int = SLICE, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = coded(vectors, scale)
    n, width, asked = rows.agg(F.count("*"), F.max(F.size("codes")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not n or not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(width, 1)
    rows = rows.withColumn("codes", F.concat("codes", F.array_repeat(F.lit(0), F.lit(width) - F.size("codes"))))
    # By descending length over all partitions; equal lengths, however many, are dealt by their place.
    parts = max(1, min(-(-n // size), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, F.desc("norm2"), "_tie").sortWithinPartitions(F.desc("norm2"))
    ordered = durable(ordered.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "codes", "norm2"))
    turn = rotation(ordered, width)
    size = max(size, -(-n // SLICES))
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    ordered = ordered.withColumn("_cut", part * (1 << 33) + F.floor(place / size))
    longest = [(r[0], r[1]) for r in ordered.groupBy("_cut").agg(F.max("norm2").alias("m")).orderBy("_cut").toLocalIterator()]
    cuts, reach = np.array([c for c, _ in longest]), np.array([m for _, m in longest], float)
    groups = -(-asked // group)
    queries = ordered.where(F.col("vec_id") % every == 0).select(F.col("_row").alias("_query"), F.col("vec_id").alias("query_id"), "codes", "norm2", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    hits = pa.list_(pa.struct([("vec_id", pa.int64()), ("_row", pa.int64()), ("score", pa.int64())]))
    kinds = pa.schema([("_query", pa.int64()), ("query_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("_group", pa.int64()), ("_floor", pa.float64()), ("_slices", pa.int32()), ("_found", hits)])

    def first(q: pa.Table, c: pa.Table) -> pa.Table:
        """Queries with the score to reach and the number of slices that can, and what the longest slice gives."""
        if not q.num_rows:
            return kinds.empty_table()
        best, found = _answer(q, c, width, turn, k, None)
        length = np.sqrt(q.column("norm2").to_numpy())
        slices = [int((np.sqrt(reach) * m * (1 + 1e-9) >= t).sum()) if np.isfinite(t) else len(reach) for m, t in zip(length, best.floor, strict=True)]
        of = [[] for _ in range(q.num_rows)]
        for i, x in zip(best.query, found.select(["vec_id", "_row", "score"]).to_pylist(), strict=True):
            of[i].append(x)
        own = [q.column(x).cast(kinds.field(x).type) for x in ("_query", "query_id", "codes", "_group")]
        return pa.Table.from_arrays([*own, pa.array(best.floor), pa.array(slices, pa.int32()), pa.array(of, hits)], schema=kinds)

    schema = "_query bigint, query_id bigint, codes array<int>, _group bigint, _floor double, _slices int, _found array<struct<vec_id bigint, _row bigint, score bigint>>"
    head = dealt(ordered.where(F.col("_cut") == int(cuts[0])))
    begun = durable(queries.groupBy("_group").cogroup(head.groupBy("_group")).applyInArrow(first, schema))
    found = begun.select("_query", "query_id", F.explode("_found").alias("f")).select("_query", "query_id", "f.*")
    if len(cuts) > 1:

        def later(q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                return pa.table({x: pa.array([], pa.int64()) for x in ("_query", "query_id", "vec_id", "_row", "score")})
            return _answer(q, c, width, turn, k, q.column("_floor").to_numpy())[1]

        numbers = F.array(*[F.lit(int(c)) for c in cuts]) if len(cuts) <= 64 else None
        more = begun.where(F.col("_slices") > 1)
        if numbers is not None:
            more = more.withColumn("_cut", F.explode(F.slice(numbers, 2, F.col("_slices") - 1)))
        else:  # many slices: their numbers are a small table, met by place
            place_of = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cuts)], "_place int, _cut long")
            more = more.withColumn("_place", F.explode(F.sequence(F.lit(1), F.col("_slices") - 1))).join(place_of, "_place")
        more = more.select("_query", "query_id", "codes", "_floor", "_group", "_cut")
        rest = dealt(ordered.where(F.col("_cut") != int(cuts[0])))
        found = found.unionByName(more.groupBy("_cut", "_group").cogroup(rest.groupBy("_cut", "_group")).applyInArrow(later, _FOUND))
    w = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """The same by multiplying every query with every row."""
    return f"""
with e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as c from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.r as q, e.vec_id, e.r, list_inner_product(q.c, e.c)::bigint as score from e q join e on q.r <> e.r where q.vec_id % {EVERY} = 0),
t as (select *, row_number() over (partition by q order by score desc, vec_id, r) as rank from s)
select query_id, rank::int as rank, vec_id, score from t where rank <= {K}"""

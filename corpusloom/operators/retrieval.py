"""Dense, lexical and hybrid retrieval for a set of queries, with the tenant filter below both legs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import relational as R

RRF_K = 60
#: Queries of one block: their vectors, at most 4,096 numbers each, travel with the tasks; the documents never do.
MAX_QUERIES = 2_000
#: Queries of a lexical block are lists of indices, many times smaller than counts: so many times more of them go in one.
LEXICAL_BLOCKS = 4
#: Rows and queries of one product in a task.
SLICE, PART = 1024, 1024
#: The longest rows, which give every query of a lexical search its first bound, and the queries that are bounded together.
LONGEST, STEP = 1024, 256
BUCKETS = 2048


def tenants(rows: DataFrame, tenant: str) -> DataFrame:
    """The rows that have a tenant; a search `within` it ranks every tenant's rows apart."""
    return rows.where(F.col(tenant) != "")


def scoped(rows: DataFrame, tenant: str, value) -> DataFrame:
    """Evidence is never read without its tenant."""
    if value is None or value == "":
        raise ValueError(f"a retrieval over evidence needs {tenant}")
    return rows.where(F.col(tenant) == value)


def tf_vectors(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, idx, tf: hashed term frequencies in long form."""
    return rows.select(key, F.explode(T.tokens(F.col(text))).alias("token")).groupBy(key, T.hash_index(F.col("token")).alias("idx")).agg(F.count("*").alias("tf"))


def lexical_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query, id, score: inner products over the inverted index. Postings of unasked indices fall out in the join."""
    q = tf_vectors(queries, "query").select("query", "idx", F.col("tf").alias("q_tf"))
    return tf_vectors(docs, "id").join(F.broadcast(q) if _few(queries) else q, "idx").groupBy("query", "id").agg(F.sum(F.col("q_tf") * F.col("tf")).cast("double").alias("score"))


def _few(queries: DataFrame) -> bool:
    return queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def dense_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query, id, score: exact cosine of all queries with all vectors; queries are taken in blocks, norms are computed once a row and block."""
    q = queries.select("query", F.col("vector").alias("q"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("q_norm"))
    d = vectors.select("id", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("norm"))
    norm = F.col("q_norm") * F.col("norm")
    scores = [d.join(F.broadcast(part)).select("query", "id", F.round(F.when(norm == 0, F.lit(0.0)).otherwise(dot(F.col("q"), F.col("vector")) / norm), 6).alias("score")) for part in _blocks(q)]
    return reduce(DataFrame.unionByName, scores)


def _blocks(queries: DataFrame, size: int | None = None) -> list[DataFrame]:
    """The queries in parts of at most `size` rows (MAX_QUERIES) by a hash of the id; one id is never split."""
    size = size or MAX_QUERIES
    if queries.limit(size + 1).count() <= size:
        return [queries]
    n, ids = queries.count(), queries.groupBy("query").count()
    parts = -(-n // size)
    most = ids.agg(F.max("count")).first()[0]
    while True:
        part = F.pmod(F.xxhash64("query"), F.lit(parts))
        fullest = ids.groupBy(part.alias("part")).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if fullest <= max(size, most):
            return [queries.where(part == i) for i in range(parts)]
        parts += max(1, parts // 4)


def _parts(column: pa.Array) -> list[np.ndarray]:
    """The places of each value's rows."""
    codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)


def _block_topk(rows: DataFrame, queries: list, score, k: int, slack: float, within: str | None = None) -> DataFrame:
    """rows (id, x, and the tenant they are ranked within) against one block of queries: what may be among the best k of a query and
    tenant, none of score null.

    score(lists) gives, for one part of the queries after another, its first place and a number for each (row, query), -inf where there is
    none. Rows are taken SLICE at a time and queries PART at a time, so a task holds one such product, whatever its batches and the block
    are. The best k so far are remembered, so a row leaves the task only if it may still come among them; of rows with one score
    the k of least id. No pair of a query and a document is shuffled but those."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    own = _own(within)

    def run(batches):
        best: dict = {}
        for b in batches:
            # Without tenants the best are remembered over all batches of the task; of tenants there may be too many for that.
            best = best if within is None else {}
            for whole in _parts(b.column(within)) if within and len(b) else [np.arange(len(b))]:
                name = b.column(within)[int(whole[0])].as_py() if within and len(b) else None
                top = best.setdefault(name, np.full((k, len(queries)), -np.inf))
                for s in range(0, len(whole), SLICE):
                    part = b.take(pa.array(whole[s : s + SLICE]))
                    order = pc.rank(part.column("id"), tiebreaker="first").to_numpy()
                    for first, found in score(part.column("x")):
                        r, q = _may_lead(found, top[:, first : first + found.shape[1]], order, slack)
                        if len(r):
                            kept = [part.column(c).take(pa.array(r)) for c in [*own, "id"]]
                            asked = pa.array([queries[first + i] for i in q]).cast(pa.int64())
                            yield pa.RecordBatch.from_arrays([asked, *kept, pa.array(found[r, q].astype(np.float64))], ["query", *own, "id", "score"])
                if within:
                    del best[name]

    return rows.mapInArrow(run, ", ".join(["query bigint", *(f"{c} {kind[c]}" for c in [*own, "id"]), "score double"]))


def _may_lead(found: np.ndarray, top: np.ndarray, order: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries of the scores that may be among the best len(top), which are brought up to date."""
    k = len(top)
    better = np.flatnonzero((found > top.min(0)).any(0))
    if len(better):
        now = found[:, better]
        now = np.partition(now, len(now) - k, axis=0)[len(now) - k :] if len(now) > k else now
        both = np.concatenate([top[:, better], now])
        top[:, better] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
    r, q = np.nonzero((found >= top.min(0) - slack) & (found > -np.inf))
    if len(r) > k:
        # Of equal scores of a query only the k of least id can be among its best.
        value = found[r, q]
        by = np.lexsort((order[r], value, q))
        r, q, value = r[by], q[by], value[by]
        fresh = np.append(True, (np.diff(q) != 0) | (np.diff(value) != 0))
        begins = np.flatnonzero(fresh)
        few = np.arange(len(r)) - begins[np.cumsum(fresh) - 1] < k
        r, q = r[few], q[few]
    return r, q


def _own(within: str | None) -> list[str]:
    return [within] if within else []


def _counts(lists: pa.Array) -> np.ndarray:
    n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(n)), n) * BUCKETS + lists.flatten().to_numpy()
    return np.bincount(at, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS).astype(np.float32)


def _lexical(asked: pa.Array):
    """Inner products of term counts; counts are whole numbers, exact in single precision up to 2 ** 24. No common term: no score.
    The queries travel as lists of indices and are counted PART at a time."""

    def score(lists: pa.Array):
        own = _counts(lists)
        for s in range(0, len(asked), PART):
            found = own @ _counts(asked.slice(s, PART)).T
            found[found <= 0] = -np.inf
            yield s, found

    return score


def _cosines(matrix: np.ndarray, lists: pa.Array) -> np.ndarray:
    """matrix: unit vectors, zero for a query without length. A vector that is null or of another length has no score."""
    n = lists.value_lengths().fill_null(0).to_numpy()
    good = n == matrix.shape[1]
    x = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
    size = np.sqrt((x * x).sum(1))
    out = np.full((len(n), len(matrix)), np.nan)
    out[good] = (x / np.where(size > 0, size, 1.0)[:, None]) @ matrix.T
    return out


def _dense(matrix: np.ndarray):
    def score(lists: pa.Array):
        for s in range(0, len(matrix), PART):
            found = _cosines(matrix[s : s + PART], lists)
            found[np.isnan(found)] = -np.inf
            yield s, found

    return score


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1.0)[:, None]


def term_indices(rows: DataFrame, key: str, text: str = "text", within: str | None = None) -> DataFrame:
    """id, x: the hash index of every token of a text."""
    return rows.select(F.col(key).alias("id"), *_own(within), F.transform(T.tokens(F.col(text)), lambda t: T.hash_index(t)).cast("array<smallint>").alias("x"))


def _lengths(lists: pa.Array) -> np.ndarray:
    """The lengths of vectors of term counts."""
    return np.concatenate([np.zeros(0), *(np.sqrt(np.square(_counts(lists.slice(s, SLICE)), dtype=np.float64).sum(1)) for s in range(0, len(lists), SLICE))])


def _with_lengths(rows: DataFrame) -> DataFrame:
    """rows (id, x) and the length of each, in the shared folder."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(_lengths(b.column("x")))], ["id", "x", "length"])

    return R.durable(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<smallint>, length double"))


def _longest(rows: DataFrame) -> DataFrame:
    """The LONGEST rows of greatest length; only lengths are sorted."""
    last = rows.select("length", "id").orderBy(F.desc("length"), F.desc("id")).limit(LONGEST).agg(F.min(F.struct("length", "id")).alias("x")).first()["x"]
    if last is None:
        return rows.limit(0)
    same = (F.col("length") == last["length"]) & (F.col("id") >= F.lit(last["id"]))
    return R.durable(rows.where((F.col("length") > last["length"]) | same)).coalesce(2)


def _bounded_topk(rows: DataFrame, longest: DataFrame, queries: list, asked: pa.Array, k: int) -> DataFrame:
    """As _block_topk of rows (id, x, length), multiplying only what may lead.

    The k-th score of a query among the longest rows is a floor under its k-th of all. No inner product exceeds the product of both lengths:
    a row meets only the queries whose floor it can reach. Queries are sorted by the length that they need, rows of a batch by the length
    that they have. Only rows that reach a floor leave the task, so their number does not grow with that of the tasks."""
    found = top_k(_block_topk(longest, queries, _lexical(asked), k, 0.0), k).where(F.col("rank") == k).select("query", "score").toArrow()
    reached = dict(zip(found["query"].to_pylist(), found["score"].to_pylist(), strict=True))
    floor, size = np.array([reached.get(q, -np.inf) for q in queries]), _lengths(asked)
    # A little less than the quotient, as lengths are rounded; a query without terms needs more than there is.
    need = np.where(size > 0, floor / np.where(size > 0, size, 1.0) * (1 - 1e-9), np.inf)
    by = np.argsort(need, kind="stable")
    queries, asked, floor, need = [queries[i] for i in by], asked.take(pa.array(by)), floor[by], need[by]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        top = np.tile(floor, (k, 1))
        for b in batches:
            length = b.column("length").to_numpy()
            down = np.argsort(-length, kind="stable")
            reach = np.searchsorted(-length[down], -need, side="right")
            first = None
            for s in range(0, len(need), STEP):
                if not reach[s]:
                    break
                q = _counts(asked.slice(s, STEP)).T
                for at in range(0, int(reach[s]), SLICE):
                    if at or first is None:
                        part = b.take(pa.array(down[at : at + SLICE]))
                        own = part, _counts(part.column("x")), pc.rank(part.column("id"), tiebreaker="first").to_numpy()
                        first = own if not at else first
                    part, counts, order = own if at else first
                    n = min(len(counts), int(reach[s]) - at)
                    scores = counts[:n] @ q
                    scores[scores <= 0] = -np.inf
                    r, c = _may_lead(scores, top[:, s : s + STEP], order[:n], 0.0)
                    if len(r):
                        names = pa.array([queries[s + i] for i in c]).cast(pa.int64())
                        yield pa.RecordBatch.from_arrays([names, part.column("id").take(pa.array(r)), pa.array(scores[r, c].astype(np.float64))], ["query", "id", "score"])

    return rows.mapInArrow(run, f"query bigint, id {kind}, score double")


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """query, id, score, rank: the best k of each query (query, text) among docs (id, text); with `within` among those of each tenant.
    More than PART queries without tenants are worth a first look at the longest rows."""
    rows, parts = term_indices(docs, "id", within=within), []
    blocks = _blocks(queries, LEXICAL_BLOCKS * MAX_QUERIES)
    bounded = within is None and queries.limit(PART + 1).count() > PART
    if bounded:
        rows = _with_lengths(rows)
        longest = _longest(rows)
    elif len(blocks) > 1:
        rows = R.durable(rows)  # every block reads the indices; the texts are hashed once
    for block in blocks:
        q = term_indices(block, "query").toArrow().combine_chunks()
        if len(q):
            names, lists = q["id"].to_pylist(), q["x"].combine_chunks()
            parts.append(_bounded_topk(rows, longest, names, lists, k) if bounded else _block_topk(rows, names, _lexical(lists), k, 0.0, within))
    if not parts:
        return top_k(queries.select("query").join(docs.select("id", *_own(within))).limit(0).withColumn("score", F.lit(0.0)), k, within)
    return top_k(reduce(DataFrame.unionByName, parts), k, within)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """query, id, score, rank: the best k of each query (query, vector) among vectors (id, vector), by exact cosine to six places;
    with `within` among those of each tenant."""
    rows, parts = vectors.select("id", *_own(within), F.col("vector").alias("x")), []
    for block in _blocks(queries.where("vector is not null")):
        q = block.select("query", "vector").toArrow()
        if len(q):
            parts.append(_block_topk(rows, q["query"].to_pylist(), _dense(_units(q["vector"].to_pylist())), k, 2e-6, within))
    if not parts:
        return top_k(queries.select("query").join(vectors.select("id", *_own(within))).limit(0).withColumn("score", F.lit(0.0)), k, within)
    return top_k(reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6)), k, within)


def top_k(scores: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """rank 1..k of each query (and tenant); ties go to the lower id."""
    w = Window.partitionBy("query", *_own(within)).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(legs: list[DataFrame], k: int, constant: int = RRF_K, within: str | None = None) -> DataFrame:
    """Reciprocal rank fusion; a document of one leg keeps that leg's share."""
    names = ["query", *_own(within), "id"]
    both = legs[0].select(*names, "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select(*names, "rank"))
    fused = both.groupBy(*names).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"), F.count("*").alias("legs"))
    return top_k(fused, k, within)


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, depth: int = 30, k: int = 10, within: str | None = None) -> DataFrame:
    """queries (query, text, vector), docs (id, text), vectors (id, vector) of one scope, or of every tenant that docs name."""
    held = docs.select("id", within).distinct() if within else docs.select("id")
    lexical = lexical_topk(queries.select("query", "text"), docs, depth, within)
    dense = dense_topk(queries.select("query", "vector"), vectors.join(held, "id", "inner" if within else "left_semi"), depth, within)
    return fuse([dense, lexical], k, within=within)


def mmr(candidates: DataFrame, k: int, weight: float = 0.5, within: str | None = None) -> DataFrame:
    """candidates (query, rank, id, text) -> picked (query, pick, id): relevance 1/rank against the largest token overlap."""
    import pandas as pd

    own = ["query", *_own(within)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        if len(pdf) <= k:
            return pdf[[*own, "id"]].assign(pick=range(1, len(pdf) + 1))
        words = [set(str(t).lower().split()) for t in pdf["text"]]
        left, chosen, again = list(range(len(pdf))), [], [0.0] * len(pdf)
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (weight / (i + 1) - (1 - weight) * again[i], -i))
            chosen.append(best)
            left.remove(best)
            for i in left if len(chosen) < k else []:
                both = len(words[i] & words[best])
                again[i] = max(again[i], both / (len(words[i]) + len(words[best]) - both) if both else 0.0)
        return pdf.loc[chosen, [*own, "id"]].assign(pick=range(1, len(chosen) + 1))

    kind = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(*own).applyInPandas(run, ", ".join([*(f"{c} {kind[c]}" for c in [*own, "id"]), "pick int"]))


def recall_at_k(queries: DataFrame, vectors: DataFrame, k: int, by_query: bool = False) -> DataFrame:
    """queries (query = gold id, vector), vectors (id, bucket, vector): the sample -> recall of each bucket, ranked within it, and, with bucket
    null, overall, ranked within the whole sample. Ties favour the gold row. by_query: bucket, query, rank_in, rank instead.

    A batch of vectors gives for each query how many are closer than its gold row, all and of its bucket: nothing else is shuffled."""
    parts = []
    for block in _blocks(queries):
        q = block.select("query", "vector").toArrow()
        names, unit = q["query"].to_pylist(), _units(q["vector"].to_pylist())
        own = vectors.join(F.broadcast(block.select(F.col("query").alias("id"))), "id", "left_semi").select("id", F.col("bucket").cast("string").alias("bucket"), "vector").toArrow()
        held = dict(zip(own["id"].to_pylist(), zip(own["bucket"].to_pylist(), _units(own["vector"].to_pylist()), strict=True), strict=True)) if len(own) else {}
        gold = np.round([float(held[n][1] @ u) if n in held else np.inf for n, u in zip(names, unit, strict=True)], 6)
        bucket = np.array([str(held[n][0]) if n in held else "" for n in names], object)

        def run(batches, names=names, unit=unit, gold=gold, bucket=bucket):
            closer, within = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for b in batches:
                found = np.round(_cosines(unit, b.column("x")), 6) > gold[None, :]
                closer += found.sum(0)
                within += (found & (np.array([str(x) for x in b.column("bucket").to_pylist()], object)[:, None] == bucket[None, :])).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(names).cast(pa.int64()), pa.array(closer), pa.array(within), pa.array(np.isfinite(gold))], ["query", "closer", "within", "there"])

        parts.append(vectors.select(F.col("vector").alias("x"), F.col("bucket").cast("string").alias("bucket")).mapInArrow(run, "query bigint, closer bigint, within bigint, there boolean"))
    ranks = reduce(DataFrame.unionByName, parts).where("there").groupBy("query").agg((1 + F.sum("closer")).alias("rank"), (1 + F.sum("within")).alias("rank_in"))
    rows = ranks.join(vectors.select(F.col("id").alias("query"), "bucket"), "query").select("bucket", "query", "rank_in", "rank")
    if by_query:
        return rows
    share = lambda c: F.round(F.avg((F.col(c) <= k).cast("int")), 6).alias("recall")
    none = F.lit(None).cast(rows.schema["bucket"].dataType).alias("bucket")
    overall = rows.groupBy().agg(F.count("*").alias("n"), share("rank")).where("n > 0").select(none, "n", "recall")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), share("rank_in")).unionByName(overall)

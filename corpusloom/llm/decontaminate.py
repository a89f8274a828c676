"""Benchmark decontamination over a distributed positional inverted index.

1. `term_counts` counts, over all documents, the occurrences of every benchmark term.
2. `order_terms` orders each window's terms by rarity; only its rarest terms are asked of the index: MEETING more than a proximity
   match may lack, so that any match, whichever words were replaced, holds MEETING of them.
3. `build_index` stores the postings of the terms that any window asks for (term -> rows and positions), one shard for each block
   of documents, with the number of words of every document. Shards are local to the task that reads the texts: postings are not
   shuffled. There is one index for all windows.
4. `search` shifts, within a shard, the posting lists by the terms' offsets and keeps the starts at which MEETING of a window's asked
   terms meet. A tolerance keeps starts that nearly agree, for proximity matches.
5. `verify` compares whole windows of words with the texts of the rows found, which are fetched once.

Benchmark items are taken in blocks of at most BLOCK_WORDS words, so what tasks hold of them is bounded; a block reads the index
and the texts found, never all documents. Terms are counted in slices of at most TERMS.

Defined results: a null text has no words; an item without words (null, empty) has no window and never occurs; an item of
fewer than ten words is one window; items with the same text all count; repeated documents are answered each; a null item_id
is written as an empty string; empty tables give no documents or no hits; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, join_measured, row_key, table
from .textkit import ALNUM, Block, Hasher, hash_words, lower_ascii, map_blocks, words

WINDOW = 10
#: Terms of a window that must meet at a candidate; so many more than a match may lack are asked for, rarest first.
MEETING = 2
#: Words by which a proximity match may be displaced, and the share of its words that must be there.
SLOP, NEAR_SHARE = 4, 0.8
BLOCK_WORDS, TERMS = 250_000, 4_000_000
#: Item ids in results that may be broadcast, about 20 bytes each.
BROADCAST_IDS = 1_000_000
SHARD_BYTES = 2_000_000
#: Fixed value: a word of the contract, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


@dataclass
class Windows:
    """words[i]: the words of window i; items[i]: positions of the items that hold it; asked[i]: (term, offset), rarest first, every offset of a term."""

    words: list[tuple[str, ...]]
    items: list[list[int]]
    asked: list[list[tuple[int, int]]]


def block_words(low: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = words(low, ALNUM)
    return (Hasher(low.cp).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)), rows


def _lowered(block: Block) -> Block:
    return Block(block.first, lower_ascii(block.cp), block.offsets)


def benchmark_terms(benchmark: DataFrame) -> np.ndarray:
    """Hashes of all words of the benchmark, sorted: 8 bytes each."""

    def run(block, batch):
        return pa.RecordBatch.from_arrays([pa.array(np.unique(block_words(_lowered(block))[0]).view(np.int64))], ["term"])

    found = map_blocks(benchmark.select("text"), "text", "term bigint", run).distinct().toArrow()
    return np.sort(found["term"].to_numpy().view(np.uint64))


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences over all documents of the given terms (sorted hashes); a task sends at most one row a term and block."""
    out = np.zeros(len(terms), np.int64)
    for first in range(0, len(terms), TERMS):
        part = terms[first : first + TERMS]

        def run(block, batch, part=part):
            word, _ = block_words(_lowered(block))
            if not len(word):
                return None
            at = np.minimum(np.searchsorted(part, word), len(part) - 1)
            seen, n = np.unique(at[part[at] == word], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], ["term", "n"])

        counted = map_blocks(docs.select("text"), "text", "term bigint, n bigint", run, SHARD_BYTES).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out[first + counted["term"].to_numpy()] = counted["n"].to_numpy()
    return out


def plan_windows(items: list[list[str]], size: int = WINDOW) -> dict[tuple[str, ...], list[int]]:
    found: dict[tuple[str, ...], list[int]] = {}
    for i, item in enumerate(items):
        if item:
            for w in {tuple(item[k : k + size]) for k in range(max(1, len(item) - size + 1))}:
                found.setdefault(w, []).append(i)
    return found


def least_words(window: tuple[str, ...]) -> int:
    """Different words of the window that a proximity match holds."""
    return math.ceil(NEAR_SHARE * len(set(window)) - 1e-9)


def order_terms(found: dict[tuple[str, ...], list[int]], terms: np.ndarray, counted: np.ndarray, meeting: int = MEETING) -> Windows:
    """terms: sorted hashes; counted: their occurrences over all documents."""
    keys, asked = sorted(found), []
    vocabulary = sorted({t for w in keys for t in w})
    hashes = hash_words(vocabulary)
    code = dict(zip(vocabulary, hashes.tolist(), strict=True))
    counts = dict(zip(hashes.tolist(), counted[np.searchsorted(terms, hashes)].tolist(), strict=True))
    for w in keys:
        terms = sorted({code[t] for t in w}, key=lambda t: (counts[t], t))[: len(set(w)) - least_words(w) + meeting]
        asked.append([(t, o) for t in terms for o, x in enumerate(w) if code[x] == t])
    return Windows(keys, [found[w] for w in keys], asked)


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Durable rows of two kinds: documents (doc_id, _row, n_words; term null) and postings (term, rows, positions) of a shard."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    number = [0]  # within a task

    def run(block, batch):
        word, rows = block_words(_lowered(block))
        count = np.bincount(rows, minlength=block.rows).astype(np.int64)
        position = np.arange(len(word)) - (np.cumsum(count) - count)[rows] if len(word) else np.zeros(0, np.int64)
        hit = np.zeros(len(word), bool)
        if len(terms) and len(word):
            at = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
            hit = terms[at] == word
        w, r, p = word[hit], rows[hit], position[hit]  # rows by their place in the shard
        order = np.argsort(w, kind="stable")
        w, r, p = w[order], r[order], p[order]
        distinct, first = np.unique(w, return_index=True)
        cuts = pa.array(np.append(first, len(w)).astype(np.int32))
        k = len(distinct)
        shard, number[0] = number[0], number[0] + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(block.rows + k, shard)),
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(k, batch.column("doc_id").type)]),
                pa.concat_arrays([batch.column("_row"), pa.nulls(k, pa.binary())]),
                pa.array(np.concatenate([count, np.zeros(k, np.int64)])),
                pa.concat_arrays([pa.nulls(block.rows, pa.int64()), pa.array(distinct.view(np.int64))]),
                pa.concat_arrays([pa.nulls(block.rows, pa.list_(pa.int64())), pa.ListArray.from_arrays(cuts, pa.array(r))]),
                pa.concat_arrays([pa.nulls(block.rows, pa.list_(pa.int64())), pa.ListArray.from_arrays(cuts, pa.array(p))]),
            ],
            ["shard", "doc_id", "_row", "n_words", "term", "rows", "positions"],
        )

    schema = f"shard bigint, doc_id {doc_type}, _row binary, n_words bigint, term bigint, rows array<bigint>, positions array<bigint>"
    return durable(map_blocks(docs.select("doc_id", "_row", F.coalesce("text", F.lit("")).alias("text")), "text", schema, run, SHARD_BYTES))


def _meeting(window: np.ndarray, term: np.ndarray, starts: np.ndarray, alone: np.ndarray, slop: int) -> np.ndarray:
    """Order and mask of the starts that nearly agree with one of another term of the same window; alone: windows of one term."""
    order = np.lexsort((starts, window))
    w, t, s = window[order], term[order], starts[order]
    change = np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1]), [True]])
    cuts, run = np.flatnonzero(change), np.cumsum(change[:-1])
    after, before = cuts[run], cuts[run - 1] - 1  # the nearest entries of another term
    keep = alone[w]
    for other, inside in ((np.minimum(after, len(w) - 1), after < len(w)), (np.maximum(before, 0), before >= 0)):
        keep = keep | (inside & (w[other] == w) & (np.abs(s[other] - s) <= 2 * slop))
    return order[keep]


def search(index: DataFrame, windows: Windows, slop: int = SLOP) -> DataFrame:
    """(_row, window, start): starts at which the posting lists of a window's asked terms meet, each within slop of its place."""
    by_term = defaultdict(list)
    for i, asked in enumerate(windows.asked):
        for term, offset in asked:
            by_term[term].append((i, offset))
    asks = {t: (np.array([i for i, _ in x]), np.array([o for _, o in x])) for t, x in by_term.items()}
    alone = np.array([len({t for t, _ in asked}) < MEETING for asked in windows.asked], bool)

    def intersect(lists: dict[int, np.ndarray]):
        found = []
        for at, (term, places) in enumerate(lists.items()):
            if term in asks:
                i, offset = asks[term]
                found.append((np.repeat(i, len(places)), np.full(len(i) * len(places), at), (places[None, :] - offset[:, None]).ravel()))
        out = []
        if found:
            window, term, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            kept = _meeting(window, term, starts, alone, slop)
            if len(kept):
                out.append((window[kept], starts[kept]))
        if out:
            at = np.concatenate([s for _, s in out])
            # Places are row * 2^32 + position + 2^16, so that a start before the text stays with its row.
            yield pa.RecordBatch.from_arrays([pa.array(at >> 32), pa.array(np.concatenate([w for w, _ in out])), pa.array((at & 0xFFFFFFFF) - 65536)], ["_row", "window", "start"])

    def run(batches):
        shard, lists, names = None, {}, []
        for batch in batches:
            shards, keys = batch.column("shard").to_numpy(), batch.column("_row")
            posting = batch.column("term").is_valid().to_numpy(zero_copy_only=False)
            terms = batch.column("term").fill_null(0).to_numpy().view(np.uint64)
            at = batch.column("rows").offsets.to_numpy()
            rows, positions = batch.column("rows").values.to_numpy(), batch.column("positions").values.to_numpy()
            for i in range(len(shards)):
                if shards[i] != shard:
                    yield from named(lists, names)
                    shard, lists, names = shards[i], {}, []
                if posting[i]:
                    lists[int(terms[i])] = (rows[at[i] : at[i + 1]] << 32) + positions[at[i] : at[i + 1]] + 65536
                else:
                    names.append(keys[i].as_py())
        yield from named(lists, names)

    def named(lists, names):
        for batch in intersect(lists):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in batch.column(0).to_pylist()], pa.binary()), batch.column(1), batch.column(2)], ["_row", "window", "start"])

    return index.select("shard", "_row", "term", "rows", "positions").mapInArrow(run, "_row binary, window bigint, start bigint")


def _origins(doc: list[str], w: tuple[str, ...], s: int, slop: int):
    """Where a window may start of which a word, displaced by slop at most, says s; none where too few of its words are around."""
    around = set(doc[max(0, s - 2 * slop) : max(0, s + len(w) + 2 * slop)])
    return range(s - slop, s + slop + 1) if len(around.intersection(w)) >= least_words(w) else ()


def verify(texts: DataFrame, found: DataFrame, windows: Windows, slop: int = SLOP) -> DataFrame:
    """(_row, spans, items, near_items): hit word ranges and item positions, by whole windows; near items have no exact window."""
    starts = found.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("window", "start"))).alias("_found"))
    rows = texts.join(starts.withColumnRenamed("_row", "_at").hint("merge"), F.col("_row") == F.col("_at"))

    def run(batches):
        for batch in batches:
            out = []
            for row, text, places in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), batch.column("_found").to_pylist(), strict=True):
                doc, spans, items, near = text_words(text), set(), set(), set()
                for place in places:
                    w, s = windows.words[place["window"]], place["start"]
                    if s >= 0 and tuple(doc[s : s + len(w)]) == w:
                        spans.add((s, s + len(w)))
                        items.update(windows.items[place["window"]])
                    elif any(len(set(w) & set(doc[max(0, x - slop) : max(0, x + len(w) + slop)])) >= least_words(w) for x in _origins(doc, w, s, slop)):
                        near.update(windows.items[place["window"]])
                out.append({"_row": row, "spans": [{"s": a, "e": b} for a, b in sorted(spans)], "items": sorted(items), "near_items": sorted(near - items)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_row", pa.binary()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))]))

    return rows.select("_row", "text", "_found").mapInArrow(run, "_row binary, spans array<struct<s: bigint, e: bigint>>, items array<bigint>, near_items array<bigint>")


def contamination(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_ROWS, window: int = WINDOW) -> DataFrame:
    """doc_id, _row, n_words, n_hit, items (ids as strings, sorted), near_items, for every row of docs."""
    keyed = docs.select("doc_id", "text", row_key().alias("_row"))
    terms = benchmark_terms(benchmark)
    counted = term_counts(docs, terms)
    plan = lambda items: order_terms(plan_windows(items, window), terms, counted)
    asked = np.zeros(0, np.uint64)
    for _, items in _item_blocks(benchmark):
        asked = np.union1d(asked, np.array(sorted({t for a in plan(items).asked for t, _ in a}), np.uint64))
    index = build_index(keyed, asked)
    # A block's windows are planned when they are needed, so the driver holds those of one block.
    found = [durable(search(index, plan(items))) for _, items in _item_blocks(benchmark)]
    hits = docs.sparkSession.createDataFrame([], "_row binary, spans array<struct<s: bigint, e: bigint>>, items array<string>, near_items array<string>")
    if found:
        rows = found[0].select("_row")
        for f in found[1:]:
            rows = rows.unionByName(f.select("_row"))
        rows = durable(rows.distinct().withColumnRenamed("_row", "_at"))
        texts = join_measured(keyed.select("_row", "text"), rows, F.col("_row") == F.col("_at"), "left_semi", bound=bound)
        texts = texts if len(found) == 1 else durable(texts)  # more blocks read them again
        # Repeats of a row are verified each and answered once.
        parts = [durable(_with_names(verify(texts, f, plan(items)), ids).dropDuplicates(["_row"])) for (ids, items), f in zip(_item_blocks(benchmark), found, strict=True)]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        if len(parts) > 1:
            hits = hits.groupBy("_row").agg(*[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near_items")])
    merged = """aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0L),
        (a, x) -> named_struct('n', a.n + greatest(0L, x.e - greatest(a.to, x.s)), 'to', greatest(a.to, x.e)), a -> a.n)"""
    hits = durable(hits.withColumn("n_hit", F.expr(merged)).drop("spans").withColumnRenamed("_row", "_hit_row"))
    rows, listed = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("items") + F.size("near_items")), F.lit(0))).first()
    words_of = index.where("term is null").select("doc_id", "_row", "n_words")
    out = join_measured(words_of, hits, F.col("_row") == F.col("_hit_row"), "left", rows=rows, bound=bound if listed <= BROADCAST_IDS else -1).drop("_hit_row")
    none = F.array().cast("array<string>")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)})


def _with_names(hits: DataFrame, ids: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            lists = [pa.array([sorted(ids[i] for i in x) for x in b.column(c).to_pylist()], pa.list_(pa.string())) for c in ("items", "near_items")]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("spans"), *lists], ["_row", "spans", "items", "near_items"])

    return hits.mapInArrow(run, "_row binary, spans array<struct<s: bigint, e: bigint>>, items array<string>, near_items array<string>")


def _item_blocks(benchmark: DataFrame):
    """(ids as strings, words) of the items, in blocks of at most BLOCK_WORDS words; items come to the driver one partition at a time."""
    ids, items, n = [], [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        w = text_words(r.text)
        if n + len(w) > BLOCK_WORDS and items:
            yield ids, items
            ids, items, n = [], [], 0
        if w:
            ids.append(r.i)
            items.append(w)
            n += len(w)
    if items:
        yield ids, items


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs."""
    keyed = docs.select(F.struct("*").alias("doc"), row_key().alias("_row"))
    hit = durable(contamination(docs.select("doc_id", "text"), benchmark, bound).where("n_hit > 0").select(F.col("_row").alias("_hit")).distinct())
    return join_measured(keyed, hit, F.col("_row") == F.col("_hit"), "left_anti", bound=bound).select("doc.*")


def report(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items for every row of docs."""
    out = contamination(docs.select("doc_id", "text"), benchmark, bound)
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near_items")

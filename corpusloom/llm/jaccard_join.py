"""Similarity join of documents on word n-grams by MinHash banding.

1. `signatures` reads every whole text once: a 128-bit digest of its word sequence, and one hash for each band of MinHash rows.
   Documents with one digest are copies; only one node, a number, stands for them from here on.
2. Nodes that share a band hash are tied to the least node of that bucket, so a bucket of m nodes gives m - 1 ties. The
   components of the ties hold every candidate pair.
3. Each component's full n-gram sets are fetched once, by a key of the row, and its pairs that share a band are verified exactly, in
   one task. A larger component is verified bucket by bucket, a pair in the first band it shares, or, where buckets hold more pairs
   than the component, dealt into blocks, one task for two blocks. The pairs are the same whichever way is taken, so a pair's link
   never depends on other rows. A task returns a row for each node (links counted, least linked node), never the pairs.
4. The components of the verified links are the classes.

Hot keys (a bucket, a hub, a class, a text with a third of all rows) meet broadcasts of bounded size, see `common.join_hot`.

A word is a maximal run of characters other than ASCII white space, with A-Z in lower case. A document of fewer than five words,
but not none, has one n-gram of all its words. Defined results: a document without words (null, empty, blank) is alone in its
class and has no links; repeated rows are copies; a null doc_id stays null and its class takes the least id of its members; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, join_hot, join_measured, row_key, table
from .components import connected_components
from .textkit import NOT_SPACE, Block, Hasher, blocks, fold, lower_ascii, map_blocks, mix, ragged, trim, words

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9985
#: MinHash values at most; more rows a band make buckets purer, more bands raise recall.
HASHES = 90
#: Nodes and n-grams of a block in verification.
BLOCK_NODES, BLOCK_GRAMS = 1536, 1_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which few enough bands reach the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("the recall needs more hashes")


def grams(block: Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes of all n-grams by row, and n-grams of each row; names: a 128-bit digest of each row's words, null without any."""
    low = Block(block.first, lower_ascii(block.cp), block.offsets)
    starts, ends, rows = words(low, NOT_SPACE)
    word = Hasher(low.cp).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    count = np.bincount(rows, minlength=block.rows).astype(np.int64)
    to = np.cumsum(count)
    at = to - count
    each = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    first = ragged(at, each)
    out = fold(word, first, np.minimum(first + n, np.repeat(to, each)))
    # The words of all rows with a space after each, as bytes.
    size = ends - starts + 1
    spaced = np.append(low.cp, np.uint32(32))[ragged(starts, size)].astype("<u4")
    spaced[np.cumsum(size) - 1] = 32
    cuts = 4 * np.concatenate([[0], np.cumsum(size)])
    view, ends_at, begins_at = memoryview(spaced).cast("B"), cuts[to].tolist(), cuts[at].tolist()
    names = [hashlib.blake2b(view[a:b], digest_size=16).digest() if b > a else None for a, b in zip(begins_at, ends_at, strict=True)]
    return out, each, pa.array(names, pa.binary())


def signatures(docs: DataFrame, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """doc_id, _row (a key of the row), node (null without words), n_grams, bands: one hash for each band."""
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, bands * rows, np.uint32)
    kept = ["doc_id", "_row"]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _row binary"

    def run(block, batch):
        gram, each, node = grams(block, n)
        full = np.flatnonzero(each)
        small = (gram >> np.uint64(32)).astype(np.uint32)
        cuts = (np.cumsum(each) - each)[full]
        found = np.zeros((len(full), bands), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(bands):
                acc = np.full(len(full), b + 1, np.uint64)
                for j in range(b * rows, b * rows + rows):
                    least = np.minimum.reduceat((small ^ flip[j]) * odd[j], cuts) if len(full) else np.zeros(0, np.uint32)
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + least)
                found[:, b] = acc
        offsets = np.concatenate([[0], np.cumsum(np.where(each > 0, bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], node, pa.array(each), lists], [*kept, "node", "n_grams", "bands"])

    rows_in = docs.select("doc_id", row_key().alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    return map_blocks(rows_in, "text", f"{kinds}, node binary, n_grams bigint, bands array<bigint>", run)


def gram_sets(rows: DataFrame, carry: list[str], n: int = WORDS) -> DataFrame:
    """The carried columns and grams: the distinct n-gram hashes of each text, in order; rows (node, text) of which the node is not
    the text's are left out, and so is what a task has given before."""
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        seen: set[bytes] = set()
        for part in batches:
            for block in blocks(part.column("text")):
                batch = part.slice(block.first, block.rows)
                gram, each, node = grams(block, n)
                to = np.cumsum(each)
                keep = []
                for i, (found, asked) in enumerate(zip(node.to_pylist(), batch.column("node").to_pylist(), strict=True)):
                    if found == asked and found not in seen:
                        seen.add(found)
                        keep.append(i)
                if keep:
                    sets = [np.unique(gram[to[i] - each[i] : to[i]]).view(np.int64) for i in keep]
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep)) for c in carry], lists], [*carry, "grams"])
        trim()

    return rows.mapInArrow(run, f"{fields}, grams array<bigint>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], heavy: int = 64) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b: frequent n-grams by dense products, others by postings."""
    na, nb = len(a), len(b)
    out = np.zeros((na, nb), np.float32)
    ra, rb = np.repeat(np.arange(na), [len(x) for x in a]), np.repeat(np.arange(nb), [len(x) for x in b])
    ids, back = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ca, cb = back[: len(ra)], back[len(ra) :]
    fa, fb = np.bincount(ca, minlength=len(ids)), np.bincount(cb, minlength=len(ids))
    dense = np.minimum(fa, fb) > heavy
    column = np.cumsum(dense) - 1
    da, db = dense[ca], dense[cb]
    for first in range(0, int(dense.sum()), 1024):
        x, y = np.zeros((na, 1024), np.float32), np.zeros((nb, 1024), np.float32)
        for m, r, c, d in ((x, ra, ca, da), (y, rb, cb, db)):
            k = column[c] - first
            pick = d & (k >= 0) & (k < 1024)
            m[r[pick], k[pick]] = 1
        out += x @ y.T
    order = np.argsort(cb, kind="stable")
    begin = np.cumsum(fb) - fb
    light = np.flatnonzero(~da & (fb[ca] > 0))
    step, total = 0, np.cumsum(fb[ca[light]])
    while step < len(light):
        to = max(step + 1, int(np.searchsorted(total, (total[step - 1] if step else 0) + 4_000_000, "right")))
        part = light[step:to]
        n = fb[ca[part]]
        partner = rb[order[ragged(begin[ca[part]], n)]]
        out += np.bincount(np.repeat(ra[part], n) * nb + partner, minlength=na * nb).reshape(na, nb)
        step = to
    return out


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        same = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        left = pdf[pdf["_block"] == pdf["_i"]]
        right = left if same else pdf[pdf["_block"] == pdf["_j"]]
        if not len(right) or not len(left) or (same and len(left) < 2):
            return pd.DataFrame({"id": [], "links": [], "tie": []})
        a, b = [np.asarray(x, np.int64) for x in left["grams"]], [np.asarray(x, np.int64) for x in right["grams"]]
        both = overlaps(a, b)
        size = np.array([len(x) for x in a], np.float32)[:, None] + np.array([len(x) for x in b], np.float32)[None, :]
        linked = both >= threshold * (size - both) - 1e-4
        if (index := int(pdf["index"].iloc[0])) > 0:  # a bucket: pairs that share an earlier band are verified there
            x, y = np.stack(left["bands"].to_numpy()), np.stack(right["bands"].to_numpy())
            for e in range(index):
                linked &= x[:, e][:, None] != y[:, e][None, :]
        if same:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if index < 0:  # a component: the same pairs as its buckets would give, those that share a band
            x, y = np.stack(left["bands"].to_numpy()), np.stack(right["bands"].to_numpy())
            shared = np.zeros(len(i), bool)
            for e in range(x.shape[1]):
                shared |= x[i, e] == y[j, e]
            i, j = i[shared], j[shared]
        names = np.concatenate([left["id"], [] if same else right["id"]]).astype(np.int64)
        least = names.copy()
        other = j + (0 if same else len(left))
        while True:  # least names spread until nothing changes
            low, before = np.minimum(least[i], least[other]), least.copy()
            np.minimum.at(least, i, low)
            np.minimum.at(least, other, low)
            if (before == least).all():
                break
        links = np.bincount(i, minlength=len(names)) + (0 if same else np.bincount(other, minlength=len(names)))
        keep = np.flatnonzero(links)
        return pd.DataFrame({"id": names[keep], "links": links[keep], "tie": least[keep]})

    return run


def _groups(near: DataFrame, nodes: DataFrame, entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """id, bands, groups: for each node what it is verified in, (key, index, blocks); index is a bucket's band, -1 for a component."""
    held = near.withColumnRenamed("node", "id").join(nodes.select("id", "n_grams"), "id")
    blocks_of = lambda n, g: F.greatest(F.ceil(F.col(n) / BLOCK_NODES), F.ceil(F.col(g) / BLOCK_GRAMS)).cast("int")
    sizes = durable(held.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g")).withColumn("blocks", blocks_of("n", "g")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        large = large.select("root", F.lit(0).cast("long").alias("n"))
    else:
        pairs = buckets.join(near, buckets.low == near.node).groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
        large = durable(large.join(pairs, "root").where("pairs < cast(n as double) * n").select("root", "n"))
    whole = sizes.join(large.select("root"), "root", "left_anti")
    one = join_hot(near, whole, "root", "n", total).join(nodes.select(F.col("id").alias("node"), "bands"), "node")
    one = one.select(F.col("node").alias("id"), "bands", F.array(F.struct(F.col("root").alias("key"), F.lit(-1).alias("index"), "blocks")).alias("groups"))
    dealt = join_hot(near, large, "root", "n", total).select(F.col("node").alias("id"))
    if large.isEmpty():
        return one
    shared = entries.join(dealt, "id")
    shared = join_hot(shared, buckets, "band", "n", nodes.count() * entries.select("index").distinct().count())
    made = F.collect_list(F.struct(F.col("band").alias("key"), F.col("index"), F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("blocks")))
    by_bucket = shared.groupBy("id").agg(made.alias("groups")).join(nodes.select("id", "bands"), "id")
    return one.unionByName(by_bucket)


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, bound: int) -> DataFrame:
    """doc_id, _row, class_id, n_links, n_copies, keep: the _row that stands for the class (null for a document alone in it)."""
    bands, rows = choose_bands(threshold, recall)
    signed = durable(signatures(docs, bands, rows, n))
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "_row")).alias("rank"), F.min("_row").alias("_one"),
        F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
    )
    nodes = durable(nodes).withColumn("id", F.monotonically_increasing_id())  # numbers fixed rows
    entries = nodes.select("id", F.posexplode("bands").alias("index", "band"))
    buckets = durable(entries.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"))
    ties = join_hot(entries.select("id", "band"), buckets, "band", "n", nodes.count() * bands)
    near = durable(connected_components(ties.where("id != low").select(F.col("id").alias("a"), F.col("low").alias("b"))))

    wanted = durable(_groups(near, nodes, entries, buckets).join(nodes.select("id", "node", F.col("_one").alias("_wanted")), "id"))
    texts = docs.select(row_key().alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    texts = join_measured(texts, wanted, F.col("_row") == F.col("_wanted"), "inner", bound=bound)
    sets = gram_sets(texts.select("text", "node", "id", "bands", "groups"), ["id", "bands", "groups"], n)
    sets = sets.withColumn("_g", F.explode("groups")).select("id", "bands", "grams", "_g.*")
    sets = sets.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = sets.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("id", "bands", "grams", "key", "index", "_block", F.least("_block", "_k").alias("_i"), F.greatest("_block", "_k").alias("_j"))
    verified = durable(pairs.groupBy("key", "index", "_i", "_j").applyInPandas(_verify(threshold), "id bigint, links bigint, tie bigint"))

    classes = connected_components(verified.select(F.col("id").alias("a"), F.col("tie").alias("b"))).withColumnRenamed("node", "id")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    linked = durable(classes.join(links, "id", "left").join(nodes.select("id", "node", "doc", "rank", "copies"), "id"))
    first = linked.groupBy("root").agg(F.min("doc").alias("class_id"), F.min("rank").alias("least"), F.count("*").alias("n"))
    known = join_hot(linked, first, "root", "n", linked.count()).select("node", "class_id", "links", "copies", F.col("least._row").alias("keep"))
    alone = nodes.where("copies > 1").join(linked.select("id"), "id", "left_anti")
    known = durable(known.unionByName(alone.select("node", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("links"), "copies", F.col("rank._row").alias("keep"))))
    out = join_hot(signed.select("doc_id", "_row", "node"), known, "node", "copies", signed.count(), "left")
    return out.select("doc_id", "_row", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"), "keep")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL, bound: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (different texts at or above the threshold), n_copies (rows with this
    word sequence)."""
    return _classes(docs, threshold, n, recall, bound).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs without all but one row of each class: the one with the least doc_id (nulls first) stays."""
    keyed = docs.select(F.struct("*").alias("doc"), row_key().alias("_row"))
    grouped = durable(_classes(docs.select("doc_id", "text"), THRESHOLD, WORDS, RECALL, bound).where("keep is not null").select("_row", "keep"))
    gone = durable(grouped.where("_row != keep").select(F.col("_row").alias("_gone")).distinct())
    out = join_measured(keyed, gone, F.col("_row") == F.col("_gone"), "left_anti", bound=bound)
    # Rows repeated with id and text have one key; of those that stay, one is kept.
    again = durable(grouped.where("_row = keep").groupBy("_row").count().where("count > 1").select(F.col("_row").alias("_again")))
    k = again.count()
    if k:
        once = join_measured(out, again, F.col("_row") == F.col("_again"), "left_semi", rows=k, bound=bound).dropDuplicates(["_row"])
        out = join_measured(out, again, F.col("_row") == F.col("_again"), "left_anti", rows=k, bound=bound).unionByName(once)
    return out.select("doc.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))

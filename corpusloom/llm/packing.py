"""Sequence packing by Karmarkar-Karp multiway differencing.

Every text is tokenised once. A document's ids (and its end id) are cut: whole sequences of `capacity` first, then units of
`capacity // SHARE`, then what is left, so that differencing has enough pieces a window to level them. All but whole sequences are
dealt at random into groups of about GROUP pieces, each packed on its own: partial partitions, tuples of `k` window sums, are
merged two at a time, largest imbalance first, the larger sums of one with the smaller ones of the other. If the fullest window
exceeds the capacity the group is packed again with more windows. A group is bounded, so no task grows with the input.

Defined results: a null or empty text has only its end id; repeated rows are packed each; an empty table gives an empty
result; other columns are ignored. A sequence whose length is a power of two needs no padding; others are padded by the reader.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, vocabulary
from .common import durable, setting, table
from .textkit import map_blocks

CAPACITY = 2048
END = 1
#: What no whole sequence takes is cut into units of capacity // SHARE ids and a smaller last piece.
SHARE = 4
#: Pieces that are packed together; it bounds a task's work and memory.
GROUP = 4096
#: Rows of whole texts that a task hands to Python at a time; its Arrow buffers lie in the executor and in the worker.
BATCH = 1000
#: Bits of a piece's place in its group.
PLACE = 32
FIRST = (1 << PLACE) - 1
_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut(n: int, capacity: int = CAPACITY, share: int = SHARE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole sequences, whole units, and what is left."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    unit = max(1, capacity // share)
    out += [(s, unit) for s in range(len(out) * capacity, n - unit + 1, unit)]
    at = out[-1][0] + out[-1][1] if out else 0
    if at < n:
        out.append((at, n - at))
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(block, batch):
        ids, offsets = vocabulary(path).encode(block)
        ids = np.insert(ids.astype("<u4"), offsets[1:], END)
        offsets = offsets + np.arange(len(offsets))
        view, where, made = memoryview(ids).cast("B"), [], []
        for r in range(block.rows):
            a, n = int(offsets[r]), int(offsets[r + 1] - offsets[r])
            for start, length in cut(n, capacity):
                where.append(r)
                made.append((start, length, zlib.crc32(view[4 * (a + start) : 4 * (a + start + length)]), n))
        numbers = np.array(made, np.int64).reshape(-1, 4)
        doc = batch.column("doc_id").take(pa.array(where, pa.int64()))
        return pa.RecordBatch.from_arrays([doc, *[pa.array(numbers[:, i]) for i in range(4)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_blocks(rows, "text", f"doc_id {kind}, {_PIECES}", run)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each size, of k, by multiway differencing.

    A partial partition is the ascending list of its windows that hold anything, each the number `sum << PLACE | first piece`;
    most merges put one piece to many, and then change one place of a list that stays sorted."""
    n = len(sizes)
    following, last = [-1] * n, list(range(n))
    heap: list = [(-s, i) for i, s in enumerate(sizes.tolist())]
    single = [-s << PLACE | i for s, i in heap]
    heapq.heapify(heap)
    made: dict[int, list[int]] = {}

    def joined(v: int, w: int) -> int:
        head, more = v & FIRST, w & FIRST
        following[last[head]], last[head] = more, last[more]
        return v + (w - more)

    for name in range(n, 2 * n - 1):
        a = heapq.heappop(heap)[1]
        b = heap[0][1]
        x, y = made.pop(a, None) or [single[a]], made.pop(b, None) or [single[b]]
        if len(x) < len(y):
            x, y = y, x
        both = len(x) + len(y) - k
        if len(y) == 1:
            insort(x, joined(x.pop(0), y[0]) if both > 0 else y[0])
        else:
            # The larger sums of one meet the smaller ones of the other, of k places on either side.
            met = [joined(v, w) for v, w in zip(x[:both], y[both - 1 :: -1], strict=False)] if both > 0 else []
            both = max(both, 0)
            x = met + x[both:] + y[both:]
            x.sort()
        made[name] = x
        heapq.heapreplace(heap, (-(x[-1] >> PLACE) + (x[0] >> PLACE if len(x) == k else 0), name))
    window = np.zeros(n, np.int64)
    if n:
        for w, at in enumerate(reversed(made.get(heap[0][1]) or single)):
            at &= FIRST
            while at >= 0:
                window[at] = w
                at = following[at]
    return window


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size; the number of windows rises until none exceeds the capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        over = int(np.bincount(window, sizes, k).max()) - capacity
        if over <= 0:
            return window
        k += max(1, k * over // capacity // 8)


def pack_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with the sequence and offset at which each lies. Sequence ids are unique, not consecutive."""
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        made = durable(pieces(docs, path or default_path(), capacity))
    whole, rest = made.where(F.col("length") == capacity), made.where(F.col("length") < capacity)
    whole = whole.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    groups = max(1, -(-rest.count() // group))
    # The checkpointed rows and their order are fixed, so a task that runs again deals the same numbers.
    rest = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        pdf["_window"] = pack(sizes, capacity)
        pdf["offset"] = pdf.groupby("_window")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = pdf["_group"] * (1 << 20) + pdf["_window"]
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = made.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("_group").applyInPandas(run, f"doc_id {kind}, {_PIECES}, sequence_id bigint, offset bigint")
    return whole.select(*packed.columns).unionByName(packed)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))

"""Groups of spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

A word of l code points, padded, has l + Q - 1 grams with positions; one edit destroys at most Q of them and moves the others by one place
at most. So near words share at least max(l, l') - 1 grams (the overlap bound), and one of the Q + 1 rarest of each. The index is dealt
by (gram, length, position) of those rarest grams; a word asks the places where a near word of its own length, or one longer, may
have the gram. In a place, postings of a word's grams, under the same limits of length and position, are merged by a heap, and words that
share as many grams as the bound asks are verified. The order of grams and the places decide the work, never the pairs.

A place with more words than a block takes is cut into blocks, each of which every word that asks there meets.

Defined results: a null text has no words, a null doc_id counts as the text of no characters in the hash; repeated rows count each;
of near words with equal n the first in code-point order is the form; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, durable, table
from .textkit import trim

#: Fixed values of the contract: runs, the divisor of the hash, the least length and count of a word, and how much more frequent a form is.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DIVISOR, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
Q = 3
#: Distinct words that a task counts before it hands them on; words of a place that are indexed together.
HELD, BLOCK = 300_000, 4096
#: Up to so many words of a place are compared without a look at the postings.
FEW = 3


def mutated(run: str, seed: int) -> str:
    """run without the code point that the hash names, where DIVISOR divides the hash; seed is the CRC of '<doc_id>:'."""
    h = zlib.crc32(run.encode(), seed)
    if h % DIVISOR:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def words(docs: DataFrame, least: int = MIN_COUNT, length: int = MIN_LENGTH) -> DataFrame:
    """word, n of the words that are long and frequent enough; counted in the tasks first."""

    def flush(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                # Bytes lower-case A-Z alone.
                found = Counter(RUN.findall(text.as_py().encode().lower().decode()))
                for w, n in found.items():
                    w = mutated(w, seed)
                    if len(w) >= length:
                        counts[w] += n
                if len(counts) > HELD:
                    yield flush(counts)
        if counts:
            yield flush(counts)
        trim()

    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def grams(word: str) -> list[str]:
    padded = "\x00" * (Q - 1) + word + "\x01" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def gram_order(found: DataFrame) -> dict[str, int]:
    """Place of each gram by how many words hold it. The letters of a run bound the grams (90 letters and two pads)."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                counts.update(set(grams(w)))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

    rows = found.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram")
    return {r.gram: i for i, r in enumerate(rows.select("gram").toLocalIterator())}


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(place in the order, position) of the Q + 1 rarest grams, one of which a near word has among its own."""
    return sorted((order[g], p) for p, g in enumerate(grams(word)))[: Q + 1]


def place(gram: int, length: int, position: int) -> int:
    """A place of the index as one number. Places that fall together cost a look, no more."""
    return (gram * 1_000_003 + length) * 1_000_003 + position & (1 << 63) - 1


def one_edit(s: str, t: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes s into t; t is not shorter."""
    if len(s) == len(t):
        return sum(a != b for a, b in zip(s, t, strict=True)) == 1
    if len(t) != len(s) + 1:
        return False
    i = next((i for i, (a, b) in enumerate(zip(s, t, strict=False)) if a != b), len(s))
    return s[i:] == t[i + 1 :]


class Postings:
    """Words of one place: for each (gram, position) the numbers of the words that have it, ascending."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.grams: list[list[str]] = []
        self.lists: dict[tuple[str, int], list[int]] = {}

    def add(self, word: str, n: int) -> None:
        own = grams(word)
        for key in zip(own, range(len(own)), strict=True):
            if key in self.lists:
                self.lists[key].append(len(self.words))
            else:
                self.lists[key] = [len(self.words)]
        self.words.append((word, n))
        self.grams.append(own)

    def near(self, word: str, longer: bool) -> Iterator[tuple[str, int]]:
        """Indexed words of the same length, or one longer, one edit from word.

        Who misses at most Q grams is in a posting of any Q + 1 of them: the shortest are merged by a heap, and the overlap over all
        postings is counted only for who comes up there."""
        own, length = grams(word), len(word) + longer
        bound = length - 1
        if len(self.words) <= FEW:
            found = range(len(self.words))
        else:
            get, spare, short = self.lists.get, len(own) - bound, []
            for p, g in enumerate(own):
                at = [x for x in (get((g, p)), get((g, p + 1)) if longer else None) if x]
                if at:
                    short.append((sum(map(len, at)), at))
                else:
                    spare -= 1
                    if spare < 0:
                        return
            short.sort(key=_first)
            found = heapq.merge(*[x for _, at in short[: spare + 1] for x in at])
        last = -1
        for i in found:
            if i != last:
                last, other = i, self.grams[i]
                if len(self.words[i][0]) == length and sum(map(eq, own, other)) + (sum(map(eq, own, other[1:])) if longer else 0) >= bound and one_edit(word, self.words[i][0]):
                    yield self.words[i]


_first = itemgetter(0)


#: What a row does in a place: it is indexed (and asks for its own length), or asks for its own length or one longer.
INDEXED, SAME, LONGER = 0, 1, 2


def near_pairs(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, other, other_n of every two words one edit apart, both ways."""
    spark = found.sparkSession
    order = spark.sparkContext.broadcast(gram_order(found))
    total = found.count() * (Q + 1)
    size = max(block, total // HOT_KEYS)

    def places(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [place(g, len(w), p) for w in batch.column("word").to_pylist() for g, p in prefix(w, order.value)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["place"])

    # No more than HOT_KEYS places can hold more words than a block.
    many = found.select("word").mapInArrow(places, "place bigint").groupBy("place").count().where(F.col("count") > size).collect()
    blocks = {r.place: -(-r["count"] // size) for r in many}

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, part, role, who = [], [], [], []
            for k, w in enumerate(batch.column("word").to_pylist()):
                n = len(w)
                for g, p in prefix(w, order.value):
                    here = place(g, n, p)
                    own = zlib.crc32(w.encode()) % blocks.get(here, 1)
                    asks = [(here, b, SAME) for b in range(blocks.get(here, 1)) if b != own]
                    asks += [(x, b, LONGER) for x in (place(g, n + 1, p), place(g, n + 1, p + 1)) for b in range(blocks.get(x, 1))]
                    for x, b, r in [(here, own, INDEXED), *asks]:
                        at.append(x)
                        part.append(b)
                        role.append(r)
                        who.append(k)
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(part, pa.int32()), pa.array(role, pa.int8()), batch.column("word").take(take), batch.column("n").take(take)], ["place", "block", "role", "word", "n"])

    def meet(batches: Iterator[pa.RecordBatch]):
        """Rows come sorted by place and block, indexed words first."""
        now, index = None, Postings()
        for batch in batches:
            out = []
            for x, b, role, w, n in zip(*(batch.column(c).to_pylist() for c in ("place", "block", "role", "word", "n")), strict=True):
                if (x, b) != now:
                    now, index = (x, b), Postings()
                if role == INDEXED:
                    out += [(w, n, *o) for o in index.near(w, False)]
                    index.add(w, n)
                else:
                    out += [(w, n, *o) for o in index.near(w, role == LONGER)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "n", "other", "other_n"])
        trim()

    dealt = found.mapInArrow(deal, "place bigint, block int, role byte, word string, n bigint").repartition("place", "block")
    once = dealt.sortWithinPartitions("place", "block", "role").mapInArrow(meet, "word string, n bigint, other string, other_n bigint")
    both = once.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p"))
    # A pair may meet in several places.
    return both.select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: every chain is followed by doubling; n at least doubles along it, so rounds are few."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = now.join(step, now["root"] == step["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        after = durable(after)
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now


def variants(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    found = durable(words(docs))
    near = near_pairs(found, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("o"))).alias("best"))
    out = found.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    out = durable(out.select("word", "n", "n_near", F.col("best.o").alias("form"), (-F.col("best.m")).alias("form_n")))
    root = roots(out.where(F.col("form").isNotNull()))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))

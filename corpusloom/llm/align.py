"""Alignment of two tokenizers' tokens as relations: positions, running lengths, an equi-join of ends, running counts of cuts.

Tokens are exploded with their positions and a window adds up their lengths to byte ends. Both sides are joined on (unit, end): an end of
both is a cut. Over the joined ends a running count of cuts numbers the groups. The tokens of either side tile the bytes, so the range
join of overlapping tokens has one row for each joined end: the tokens that cover the bytes before it, filled in by the same window. A
group without inner cuts, however long, therefore costs its tokens, not their product.

A unit is what follows a space up to the next space that stands behind a visible character. Both tokenizers are proven to end a token
there (the byte-level pattern always does; no piece holds a space behind another character, or texts are not split), so equal units
align equally and are aligned once: a text's groups and links are those of its units, one after another. Counts of id pairs weigh each
unit by its occurrences. The most frequent units, HOT of them at most, are known to all tasks; the others go by join to the bucket
of texts that hold them, once for each bucket and task that asks.

Defined results: texts that are null, empty, or that either tokenizer does not give back byte for byte, have no tokens, zeros and '';
repeated rows count each; ties for the highest count are all best; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _bytes_of_symbols, default_path
from .common import HOT_KEYS, durable, ensure_checkpoint_dir, table
from .common import setting as _setting
from .textkit import ragged, trim

SPACE = "▁"
#: A space behind a character that is white space to neither tokenizer; the space belongs to the unit that it opens.
SPLIT = re.compile(r"(?<=[^\s▁]) ")
BLANK = [c for c in map(chr, range(0x10000)) if c.isspace() or c == SPACE]
#: The same for Arrow: texts with a space that does not split, or with a character that asks for a look at the tokenizers.
ODD = "^ |[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANK) + "] "
CLOSED, JOINED = re.compile(r"[^\s▁]\Z"), 256
#: Units known to all tasks (about 200 bytes each in a worker), bytes of texts whose units are counted or asked for at a time, bytes of texts in
#: a bucket, and id pairs that may be broadcast (32 bytes each).
HOT, HELD_BYTES, BUCKET_BYTES, PAIRS = 400_000, 6_000_000, 8_000_000, 2_000_000
#: Bytes of a bucket's texts whose groups are put together at a time.
SLICE_BYTES = 1_000_000
BUCKETS = 3
_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Side:
    """One tokenizer in a worker: ids of strings that begin with a space, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            byte = re.compile("<0x([0-9A-F]{2})>")
            self.bytes = [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
            self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
            lone = [model.piece_to_id(SPACE)]
            # The library adds the space itself, but gives nothing for the empty string.
            self.encode = lambda texts: [x or lone for x in model.encode([t[1:] for t in texts], num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            byte = _bytes_of_symbols()
            symbols = {i: s for s, i in tokenizer.get_vocab(with_added_tokens=True).items()}
            self.bytes = [bytes(byte.get(c, 63) for c in symbols.get(i, "")) for i in range(max(symbols) + 1)]
            self.splits = True
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.length = np.array([len(b) for b in self.bytes], np.int32)

    def gives_back(self, text: str) -> bool:
        return b"".join(self.bytes[i] for i in self.encode([" " + text])[0]) == (" " + text).encode()

    def tokens(self, units: pa.Array) -> pa.Array:
        """The ids and byte lengths of the tokens of each unit."""
        texts = units.to_pylist()
        # Units after which a space ends a token are encoded many at a time.
        joins = self.splits
        order, runs, alone = [], [[]], []
        for i, u in enumerate(texts):
            if joins and CLOSED.search(u):
                if len(runs[-1]) == JOINED:
                    runs.append([])
                runs[-1].append(i)
            else:
                alone.append(i)
        strings = []
        for run in [*filter(None, runs), *([i] for i in alone)]:
            order += run
            strings.append(" " + " ".join([texts[i] for i in run]))
        ids = np.fromiter((i for x in self.encode(strings) for i in x), np.int32)
        ends = np.cumsum(self.length[ids], dtype=np.int64)
        bounds = np.cumsum([len(texts[i].encode()) + 1 for i in order], dtype=np.int64)
        last = np.searchsorted(ends, bounds)
        if len(bounds) and (last[-1] != len(ids) - 1 or (ends[last] != bounds).any()):
            raise ValueError("a unit is not given back although its text is")
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        # Back to the order of the units.
        back = np.argsort(order) if order else np.zeros(0, np.int64)
        size = (last - first + 1)[back]
        ids = ids[ragged(first[back], size)]
        lengths, offsets = self.length[ids], np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (ids, lengths)], ["id", "len"])


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


@lru_cache(maxsize=4)
def unsafe(paths: tuple[str, str]) -> str:
    """The code points that a tokenizer does not give back, tried in strings that are halved where they fail."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    todo, out = [points[i : i + 1024] for i in range(0, len(points), 1024)], []
    while todo:
        some = todo.pop()
        if all(side(p).gives_back("".join(map(chr, some))) for p in paths):
            continue
        if len(some) == 1:
            out.append(chr(some[0]))
        else:
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
    return "".join(sorted(out))


class Texts:
    """How texts become units, in a worker."""

    def __init__(self, paths: tuple[str, str], doubtful: str):
        self.paths, self.doubtful = paths, re.compile(f"[{re.escape(doubtful)}]") if doubtful else None
        self.split = all(side(p).splits for p in paths)
        self.odd = ODD + "".join(f"|\\x{{{ord(c):x}}}" for c in doubtful)

    def units(self, text: str | None) -> list[str]:
        """None of a text that has no tokens. Only texts with a doubtful code point need a look at the tokenizers."""
        if not text or self.doubtful and self.doubtful.search(text) and not all(side(p).gives_back(text) for p in self.paths):
            return []
        if not self.split:
            return [text]
        # Where every space stands behind a visible character, the pattern splits at each.
        return SPLIT.split(text) if text[0] == " " or any(c in text and f"{c} " in text for c in BLANK) else text.split(" ")

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """Some rows of texts, all their units one after another, and how many each row has. Arrow splits the rows that are split at each space."""
        rows = np.arange(len(texts))
        odd = np.array(pc.match_substring_regex(texts, self.odd).fill_null(True), bool) | (np.array(pc.binary_length(texts).fill_null(0)) == 0)
        if not self.split:
            odd[:] = True
        if not odd.all():
            found = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            yield rows[~odd], found.flatten(), np.array(pc.list_value_length(found), np.int64)
        if odd.any():
            lists = [self.units(t.as_py()) for t in texts.filter(pa.array(odd))]
            yield rows[odd], pa.array([u for x in lists for u in x], pa.string()), np.array([len(x) for x in lists], np.int64)


def _buckets(spark: SparkSession) -> int:
    """Some buckets for each shuffle partition, so that the sorts within a bucket are small."""
    return BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared checkpoint folder, compressed, unlike a checkpoint; bucketed by a column if asked."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"align_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.format("parquet").bucketBy(_buckets(spark), by).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"drop table {name}")
    return out


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of about `limit` bytes of texts at a time."""
    ends = np.cumsum(np.array(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
    for a, b in pairwise([0, *(1 + np.flatnonzero(np.diff(ends // limit))).tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def unit_counts(docs: DataFrame, texts) -> DataFrame:
    """unit, n: in how many places of all texts each unit stands; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]):
        of = texts()
        for batch in batches:
            for some in _slices(batch, HELD_BYTES):
                for _, units, _ in of.parts(some.column("text")):
                    counts = units.value_counts()
                    yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["unit", "n"])
        trim()

    return docs.select("text").mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def tokenized(units: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """unit, n, and of either side the ids and byte lengths of the unit's tokens."""
    for path, name in zip(paths, "ab", strict=True):
        tokens = F.arrow_udf(lambda u, path=path: side(path).tokens(u), "id array<int>, len array<int>")
        units = units.withColumn(f"_{name}", tokens("unit"))
    return units.select("unit", "n", F.col("_a.id").alias("ids_a"), F.col("_a.len").alias("lens_a"), F.col("_b.id").alias("ids_b"), F.col("_b.len").alias("lens_b"))


def linked(tokens: DataFrame) -> DataFrame:
    """unit, n, end, a, b, link, g for each byte end of a token of either side, last ends first: the tokens that end there, the id pair that
    overlaps before it (a * 2^32 + b), and the number of its group from the end."""

    def ends(name: str) -> DataFrame:
        up_to = Window.partitionBy("unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = tokens.select("unit", "n", F.posexplode(F.arrays_zip(F.col(f"ids_{name}").alias("id"), F.col(f"lens_{name}").alias("len"))).alias("pos", "t"))
        return rows.select("unit", "n", F.sum("t.len").over(up_to).alias("end"), F.col("t.id").alias(name))

    a, b = ends("a"), ends("b")
    both = a.join(b.drop("n"), ["unit", "end"], "left").select(F.col("unit").alias("of"), "n", "end", "a", "b")
    b_alone = b.join(a.select("unit", "end"), ["unit", "end"], "left_anti").select(F.col("unit").alias("of"), "n", "end", F.lit(None).cast("int").alias("a"), "b")
    # From the last end to the first: the token that covers the bytes before an end is the one that ends there or next.
    down = Window.partitionBy("of").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    link = F.last("a", True).over(down).cast("long") * (1 << 32) + F.last("b", True).over(down)
    rows = both.unionByName(b_alone).select("of", "n", "end", "a", "b", link.alias("link"), F.sum(cut).over(down).alias("g"))
    return rows.sortWithinPartitions("of", F.desc("end")).withColumnRenamed("of", "unit")


def aligned(tokens: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """unit, n, groups, links (id pairs), n_a, n_b, n_groups, n_links: the rows of each unit, which lie together, written down."""

    size = max(len(side(p).bytes) for p in paths)

    def run(batches: Iterator[pa.RecordBatch]):
        words, rest = _words(size), None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            unit = rows.column("unit").combine_chunks()
            new = np.array(pc.not_equal(unit[1:], unit[:-1]))
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            # The last unit may go on in the next batch.
            if len(starts) > 1:
                yield _written(rows.slice(0, starts[-1]), starts[:-1], words, size)
            rest = rows.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield _written(rest, np.zeros(1, np.int64), words, size)
        trim()

    return linked(tokens).mapInArrow(run, "unit string, n bigint, groups string, links array<bigint>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint")


@lru_cache(maxsize=1)
def _words(size: int) -> pa.Array:
    """Every id behind nothing, a comma, a bar and a semicolon."""
    return pa.array([f"{sep}{i}" for sep in ("", ",", "|", ";") for i in range(size)])


def _written(rows: pa.Table, starts: np.ndarray, words: pa.Array, size: int) -> pa.RecordBatch:
    """Rows of whole units, each from its last end to its first, as one row a unit."""
    n = rows.num_rows
    a, b = (rows.column(c).fill_null(-1).to_numpy() for c in "ab")
    g, link = rows.column("g").to_numpy(), rows.column("link").to_numpy()
    ends = np.append(starts[1:], n)
    of = np.repeat(np.arange(len(starts)), ends - starts)
    # Reading backwards: units last to first, in each the first end first. A group is a unit and its number.
    group = np.cumsum(np.concatenate([[True], (of[::-1][1:] != of[::-1][:-1]) | (g[::-1][1:] != g[::-1][:-1])])) - 1
    sides = [(x[::-1], group * 2 + k) for k, x in enumerate((a, b))]
    ids, key = (np.concatenate(x) for x in zip(*((x[x >= 0], k[x >= 0]) for x, k in sides), strict=True))
    order = np.argsort(key, kind="stable")
    ids, key = ids[order], key[order]
    unit = of[::-1][np.searchsorted(group, key >> 1)]
    first = np.concatenate([[True], unit[1:] != unit[:-1]])
    sep = np.where(first, 0, np.where(np.concatenate([[False], key[1:] == key[:-1]]), 1, np.where(key & 1, 2, 3)))
    tokens = words.take(pa.array(sep * size + ids))
    # Units come out last to first; turned round again at the end.
    offsets = np.append(np.flatnonzero(first), len(ids)).astype(np.int32)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), "").take(pa.array(np.arange(len(starts))[::-1]))
    links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((ends - starts)[::-1])).astype(np.int32)), pa.array(link[::-1])).take(pa.array(np.arange(len(starts))[::-1]))
    sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (a >= 0, b >= 0, (a >= 0) & (b >= 0))]
    at = pa.array(starts)
    columns = [rows.column("unit").combine_chunks().take(at), rows.column("n").combine_chunks().take(at), groups, links, *map(pa.array, sums), pa.array((ends - starts).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["unit", "n", "groups", "links", "n_a", "n_b", "n_groups", "n_links"])


def pair_counts(table_: DataFrame) -> DataFrame:
    """link, count, best (1 if no other pair of the same B id counts more) of all id pairs."""
    counts = table_.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("link").bitwiseAND((1 << 32) - 1))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(of_b)).cast("long"))


def scored(table_: DataFrame, pairs: DataFrame, few_pairs: bool) -> DataFrame:
    """unit, groups and the sums of a unit; hot id pairs, or all if they are few, are broadcast."""
    links = table_.select("unit", F.explode("links").alias("link"))
    if few_pairs:
        met = links.join(F.broadcast(pairs), "link")
    else:
        limit = pairs.agg(F.sum("count")).first()[0] // HOT_KEYS
        hot, few = pairs.where(F.col("count") > limit), pairs.where(F.col("count") <= limit)
        known = F.broadcast(hot.withColumnsRenamed({c: f"_{c}" for c in hot.columns}))
        all_ = links.join(known, F.col("link") == F.col("_link"), "left")
        is_hot = F.col("_link").isNotNull()
        met = all_.where(is_hot).select("unit", F.col("_count").alias("count"), F.col("_best").alias("best")).unionByName(all_.where(~is_hot).select("unit", "link").join(few, "link").select("unit", "count", "best"))
    sums = met.groupBy("unit").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return table_.drop("links", "n").join(sums, "unit").select("unit", "groups", *_SUMS)


_PLACES: dict[str, dict[str, int]] = {}


def _places(token: str, hot: pa.Table) -> dict[str, int]:
    """Places of the hot units, made once for each worker and call."""
    if token not in _PLACES:
        _PLACES.clear()
        _PLACES[token] = {u.as_py(): i for i, u in enumerate(hot.column("unit"))}
    return _PLACES[token]


def _threshold(units: DataFrame, most: int) -> int:
    """A count that no more than `most` units reach, by classes of counts (eight for each doubling)."""
    rows = units.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("k"), F.max("n").alias("m")).orderBy(F.desc("c")).collect()
    total = 0
    for r in rows:
        total += r.k
        if total > most:
            return r.m + 1
    return 0


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, pairs_bound: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`)."""
    spark = docs.sparkSession
    paths = (path_a or default_path(), path_b or default_path("piece_bpe_32k.model"))
    doubtful = unsafe(paths)

    def texts() -> Texts:
        return Texts(paths, doubtful)

    units = _stored(tokenized(unit_counts(docs, texts), paths), "unit")
    # Buckets of units stay together through windows and joins: nothing is shuffled until id pairs are counted.
    with _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        known = _stored(aligned(units, paths), "unit")
    pairs = durable(pair_counts(known))
    few_pairs = pairs.count() <= pairs_bound
    least = _threshold(units, hot)
    total = units.agg(F.sum(F.col("n") * (F.octet_length("unit") + 1))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    columns = ["groups", *_SUMS]
    target = pa.schema([("groups", pa.large_string()), *[(c, pa.int64()) for c in _SUMS]])
    few = scored(known.where(F.col("n") >= least), pairs, few_pairs).toArrow().combine_chunks()
    shared, token = spark.sparkContext.broadcast(few), uuid.uuid4().hex

    def hot_units() -> dict[str, int]:
        return _places(token, shared.value)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    def wanted(batches: Iterator[pa.RecordBatch]):
        of, held = texts(), shared.value.column("unit")
        for batch in batches:
            for some in _slices(batch, HELD_BYTES):
                for at, units, sizes in of.parts(some.column("text")):
                    bucket = pa.array(np.repeat(np.array(some.column("_bucket"))[at], sizes), pa.int32())
                    cold = pc.invert(pc.is_in(units, held))
                    asked = pa.table({"_bucket": bucket, "unit": units}).filter(cold).group_by(["_bucket", "unit"]).aggregate([])
                    yield from asked.select(["_bucket", "unit"]).to_batches()
        trim()

    asked = rows.select("_bucket", "text").mapInArrow(wanted, "_bucket int, unit string")
    # As many partitions as the stored units have buckets, so that one shuffle is enough. What several tasks ask for comes more than once, never
    # more often than it stands in the texts.
    cold = asked.repartition(_buckets(spark), "unit").join(scored(known.where(F.col("n") < least), pairs, few_pairs), "unit").select("_bucket", "unit", *columns)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def assemble(texts_: pa.Table, rest: pa.Table) -> pa.Table:
        of, place, hot_ = texts(), hot_units(), shared.value
        own = {u: hot_.num_rows + i for i, u in enumerate(rest.column("unit").to_pylist())}
        all_ = pa.concat_tables([hot_.select(columns).cast(target), rest.select(columns).cast(target)])
        names, values = all_.column("groups").combine_chunks(), [all_.column(c).to_numpy() for c in _SUMS]
        # Places and strings of units are held for SLICE_BYTES of texts at a time.
        ends, out = np.cumsum(pc.binary_length(texts_.column("text")).to_numpy(), dtype=np.int64), []
        cuts = [0, *(1 + np.flatnonzero(np.diff(ends // SLICE_BYTES))).tolist(), texts_.num_rows]
        for some in (texts_.slice(a, b - a) for a, b in pairwise(cuts)):
            at, sizes = [], []
            for text in some.column("text"):
                found = of.units(text.as_py())
                at += map(place.get, found, map(own.get, found))
                sizes.append(len(found))
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            at = np.array(at, np.int64)
            groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts), names.take(pa.array(at))), pa.scalar(";", pa.large_string()))
            sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in values]
            out.append(pa.table({"doc_id": some.column("doc_id"), **{c: pa.array(x[starts[1:]] - x[starts[:-1]]) for c, x in zip(_SUMS, sums, strict=True)}, "groups": groups.cast(pa.string())}))
        trim()
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in _SUMS)}, groups string"
    return rows.groupBy("_bucket").cogroup(cold.groupBy("_bucket")).applyInArrow(assemble, schema)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *_SUMS, digest.alias("groups_sha256"))

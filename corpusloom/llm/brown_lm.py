"""Language-model scores from a Brown class bigram model.

1. `word_counts` counts every word of the training documents (summed in the tasks before the shuffle).
2. The most frequent TOP words are clustered into CLASSES by the exchange algorithm on their bigram counts, which come from all
   training documents: each word in turn moves to the class that raises the class bigram likelihood most. The next MIDDLE words
   join the class that raises it most against these, by their counts with the classes before and after them. Then the class
   bigrams are counted anew, and every training word but the first TOP is exchanged against them, in parallel: it leaves its class,
   if it has one, and joins the best one. Only words unseen in training fall in classes by their form (length, last character),
   which also stand for neighbours that have no class yet. A document starts and ends in the end class.
3. p(word | history) = p(class | class before) * p(word | class): additive smoothing of the transitions, half a count for every
   word and for the unseen of a class. Both factors are sums of logarithms, so a document needs its transitions and the logs of
   its words' counts.
4. Words of the bounded head table (at most HEAD words) are looked up in the task; the others meet counts and classes in a join.
   Documents become strings of classes, from which transitions are counted and scores summed.

A word's identity is a 64-bit hash of its letters (v different words share one with odds of v * v / 2 ** 65). Defined results: a null, empty or blank text is the end token alone; a null id counts as
training text of remainder 0; repeated rows count and score each; without training rows every probability is that of an unseen
word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .labelled import remainder
from .textkit import NOT_SPACE, Block, Hasher, blocks, lower_ascii, map_blocks, words

MODULUS, HELD_OUT = 5, 1
TOP, MIDDLE, CLASSES = 1000, 20_000, 48
#: Words at most in the table that tasks hold: 24 bytes each.
HEAD = 1_000_000
LENGTHS = (4, 7, 10)
FORMS = 3 * (len(LENGTHS) + 1)
ALPHA = 0.1
#: Distinct words that a task gathers before it passes their counts on.
GATHER = 600_000
#: Neighbours of words that a task gathers before it passes them on; counts up to LISTED have their gains in a table.
NEIGHBOURS, LISTED = 3_000_000, 16


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, form and row of every word."""
    low = Block(block.first, lower_ascii(block.cp), block.offsets)
    starts, ends, rows = words(low, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), rows
    last = np.minimum(low.cp[ends - 1], 255)
    tail = np.where(np.isin(last, [ord(c) for c in ".,;:!?"]), 1, np.where(((last >= 97) & (last <= 122)) | (last >= 128), 0, 2))
    return Hasher(low.cp).of(starts, ends), np.searchsorted(LENGTHS, ends - starts, "left") * 3 + tail, rows


def word_counts(train: DataFrame) -> DataFrame:
    """word (hash), form, n over all texts."""

    def run(batches):
        held: list = []
        size = 0

        def merged():
            w, f, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(w, kind="stable")
            w, f, n = w[order], f[order], n[order]
            cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            return w[cuts], f[cuts], np.add.reduceat(n, cuts)

        def out(w, f, n):
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(f), pa.array(n)], ["word", "form", "n"])

        for batch in batches:
            for block in blocks(batch.column("text")):
                word, form, _ = tokens(block)
                if len(word):
                    w, first, n = np.unique(word, return_index=True, return_counts=True)
                    held.append((w, form[first], n))
                    size += len(w)
            if size > 2 * GATHER:
                held = [merged()]
                size = len(held[0][0])
                if size > GATHER:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*merged())

    return train.select("text").mapInArrow(run, "word bigint, form bigint, n bigint").groupBy("word").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


def _find(sorted_words: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_words):
        return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    at = np.minimum(np.searchsorted(sorted_words, word), len(sorted_words) - 1)
    return at, sorted_words[at] == word


def symbols(word, form, rows, n_rows: int, top: np.ndarray, top_class: np.ndarray, first_form: int, end: int):
    """The symbol of every token, ends included, row after row; the symbol before each; the row of each."""
    unique, back = np.unique(word, return_inverse=True)
    at, known = _find(top, unique)
    of = top_class[at] if len(top) else np.zeros(len(unique), np.int64)
    own = np.where(known[back], of[back], first_form + form) if len(word) else np.zeros(0, np.int64)
    count = np.bincount(rows, minlength=n_rows)
    to = np.cumsum(count) + np.arange(n_rows)
    out = np.full(len(word) + n_rows, end, np.int64)
    keep = np.ones(len(out), bool)
    keep[to] = False
    out[keep] = own
    before = np.concatenate([[end], out[:-1]])  # the symbol before a row's first token is the end of the row before it
    return out, before, np.repeat(np.arange(n_rows), count + 1)


def bigram_counts(train: DataFrame, known: np.ndarray, index: np.ndarray, first_form: int) -> np.ndarray:
    """Matrix of counts over symbols: the index of known words, forms, end. Bounded by its size, whatever the corpus."""
    size = first_form + FORMS + 1

    def run(batches):
        n = np.zeros(size * size, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                word, form, rows = tokens(block)
                now, before, _ = symbols(word, form, rows, block.rows, known, index, first_form, size - 1)
                n += np.bincount(before * size + now, minlength=size * size)
        seen = np.flatnonzero(n)
        for s in range(0, len(seen), 200_000):
            part = seen[s : s + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["pair", "n"])

    found = train.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gain(m: np.ndarray, out: np.ndarray, into: np.ndarray, own: float, classes: int) -> np.ndarray:
    """What a symbol adds to the likelihood in each class; m is without it; out, into: its counts after and before, without itself."""
    rows, cols = (m.sum(1) + into)[:classes], (m.sum(0) + out)[:classes]  # totals, whichever class the word joins
    gain = (_f(m[:classes] + out) - _f(m[:classes])).sum(1)
    col = m[:, :classes].T
    gain += (_f(col + into) - _f(col)).sum(1)
    d = np.arange(classes)
    diag = m[d, d]
    gain -= _f(diag + out[d]) - _f(diag) + _f(diag + into[d]) - _f(diag)
    gain += _f(diag + out[d] + into[d] + own) - _f(diag)
    r, c = out.sum() + own, into.sum() + own
    return gain - (_f(rows + r) - _f(rows) + _f(cols + c) - _f(cols))


def _without(m: np.ndarray, a: int, out: np.ndarray, into: np.ndarray, own: float) -> np.ndarray:
    m = m.copy()
    m[a] -= out
    m[:, a] -= into
    m[a, a] -= own
    return m


def exchange(n: np.ndarray, movable: int, classes: int = CLASSES) -> np.ndarray:
    """Class of each symbol: the first `movable` ones (most frequent first by their counts) are clustered, the others fixed.

    It ends where no single move helps: every move raises the likelihood, which has finitely many values."""
    size = len(n)
    fixed = size - movable
    order = np.argsort(-n[:movable].sum(1), kind="stable")
    of = np.zeros(size, np.int64)
    of[order] = np.arange(movable) % classes
    of[movable:] = classes + np.arange(fixed)
    k = classes + fixed
    z = np.zeros((size, k))
    z[np.arange(size), of] = 1
    right, left = n @ z, n.T @ z  # counts of each symbol with the classes after and before it
    m = z.T @ right
    moved = True
    while moved:
        moved = False
        for w in order:
            a, own = of[w], n[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[a] -= own
            into[a] -= own
            less = _without(m, a, out, into, own)
            gain = _gain(less, out, into, own, classes)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6 * max(1.0, abs(gain[a])):
                continue
            m = _without(less, b, -out, -into, -own)
            moved = True
            of[w] = b
            right[:, a] -= n[:, w]
            right[:, b] += n[:, w]
            left[:, a] -= n[w]
            left[:, b] += n[w]
    return of


def _strings(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values between the cuts, as binary strings."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(strings: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What _strings was made from; no string is empty."""
    if not len(strings):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    cuts = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(strings.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].copy().view(kind), (cuts - cuts[0]) // kind.itemsize


def neighbours(train: DataFrame, known: np.ndarray, of: np.ndarray, first_form: int, end: int, words: np.ndarray, inside: bool) -> DataFrame:
    """word, codes: of every word that is (or, unless inside, is not) in words, the classes after it (c), before it (k + c) and
    itself after itself (2 k). Known words are in the classes `of`."""
    k = end + 1
    kind = np.min_scalar_type(2 * k)

    def out(found):
        word, code = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        word, code = word[order], code[order]
        cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
        for i in range(0, len(cuts) - 1, 100_000):
            part = cuts[i : i + 100_001]
            yield pa.RecordBatch.from_arrays([pa.array(word[part[:-1]].view(np.int64)), _strings(code[part[0] : part[-1]], part - part[0])], ["word", "codes"])

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                word, form, rows = tokens(block)
                if not len(word):
                    continue
                now, before, _ = symbols(word, form, rows, block.rows, known, of, first_form, end)
                inner = now != end
                before, after, other = before[inner], np.append(now[1:], end)[inner], _find(words, word)[1] == inside
                again = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
                first = other & ~np.concatenate([[False], again])  # a repetition is counted once, at the word before
                code = np.where(np.append(again, False), 2 * k, after)
                found.append((np.concatenate([word[other], word[first]]), np.concatenate([code[other], before[first] + k]).astype(kind)))
                size += len(found[-1][0])
                if size > NEIGHBOURS:
                    yield from out(found)
                    found, size = [], 0
        if size:
            yield from out(found)

    return train.select("text").mapInArrow(run, "word bigint, codes binary")


def gains(n: np.ndarray, m: np.ndarray, classes: int, listed: np.ndarray) -> np.ndarray:
    """What each word (row of n: counts by code) adds to the likelihood in each class, the class bigrams m being fixed."""
    k = len(m)
    word, code = np.nonzero(n[:, : 2 * k])
    times = n[word, code]
    part = listed[np.minimum(times, LISTED), code]
    for i in np.flatnonzero(times > LISTED):
        base = m[:classes, code[i]] if code[i] < k else m[code[i] - k, :classes]
        part[i] = _f(base + times[i]) - _f(base)
    out = np.zeros((len(n), classes))
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    if len(word):
        out[word[starts]] = np.add.reduceat(part, starts, axis=0)
    # The cell of a class with itself takes what comes before, after and between at once.
    after, before, own = n[:, :classes].astype(float), n[:, k : k + classes].astype(float), n[:, 2 * k :].astype(float)
    diag = np.diag(m)[:classes]
    out += _f(diag + after + before + own) + _f(diag) - _f(diag + after) - _f(diag + before)
    r, c = n[:, :k].sum(1, keepdims=True) + own, n[:, k : 2 * k].sum(1, keepdims=True) + own
    rows, cols = m.sum(1)[:classes], m.sum(0)[:classes]
    return out - (_f(rows + r) - _f(rows) + _f(cols + c) - _f(cols))


def assign(found: DataFrame, m: np.ndarray, classes: int, known: np.ndarray | None = None, of: np.ndarray | None = None) -> DataFrame:
    """word, n, class of every word of `neighbours`; m: class bigrams, in which the words of known are counted in the classes `of`."""
    k = len(m)
    known, of = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if known is None else (known, of)
    kind = np.min_scalar_type(2 * k)

    def run(batches):
        base = np.concatenate([m[:classes].T, m[:, :classes]])  # by code: the cells that a neighbour adds to
        listed = np.stack([_f(base + x) - _f(base) for x in range(LISTED + 1)])

        def out(word, code, cuts):
            unique, at = np.unique(word, return_inverse=True)
            for s in range(0, len(unique), 4096):  # words are in order, so are their rows
                e = min(s + 4096, len(unique))
                a, b = np.searchsorted(at, s), np.searchsorted(at, e)
                index = np.repeat(at[a:b] - s, np.diff(cuts[a : b + 1]))
                n = np.bincount(index * (2 * k + 1) + code[cuts[a] : cuts[b]], minlength=(e - s) * (2 * k + 1)).reshape(e - s, 2 * k + 1)
                best = np.argmax(gains(n, m, classes, listed), 1)
                place, held = _find(known, unique[s:e].view(np.uint64))
                for i in np.flatnonzero(held):  # it leaves its class first, and returns unless another is better
                    x, a = n[i].astype(float), of[place[i]]
                    gain = _gain(_without(m, a, x[:k], x[k : 2 * k], x[2 * k]), x[:k], x[k : 2 * k], x[2 * k], classes)
                    best[i] = a if gain.max() <= gain[a] + 1e-6 * max(1.0, abs(gain[a])) else np.argmax(gain)
                yield pa.RecordBatch.from_arrays([pa.array(unique[s:e]), pa.array(n[:, k:].sum(1)), pa.array(best)], ["word", "n", "class"])

        held = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(1, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            code, cuts = _numbers(batch.column("codes"), kind)
            word = np.concatenate([held[0], batch.column("word").to_numpy()])
            code, cuts = np.concatenate([held[1], code]), np.concatenate([held[2], cuts[1:] + held[2][-1]])
            last = int(np.searchsorted(word, word[-1]))  # the last word may go on in the next batch
            if last:
                yield from out(word[:last], code[: cuts[last]], cuts[: last + 1])
            held = (word[last:], code[cuts[last] :], cuts[last:] - cuts[last])
        if len(held[0]):
            yield from out(*held)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word bigint, n bigint, class bigint")


def transitions(strings: DataFrame, k: int) -> np.ndarray:
    """Counts of the pairs of classes in the strings; k * k cells whatever the corpus."""
    kind = np.min_scalar_type(k)

    def run(batches):
        n = np.zeros(k * k, np.int64)
        for batch in batches:
            now, _ = _numbers(batch.column("classes"), kind)
            now = now.astype(np.int64)
            n += np.bincount(np.concatenate([[k - 1], now[:-1]])[: len(now)] * k + now, minlength=k * k)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["pair", "n"])

    found = strings.select("classes").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(k, k)


def score_documents(docs: DataFrame, top: int = TOP, classes: int = CLASSES, head: int = HEAD, middle: int = MIDDLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = durable(word_counts(train))
    ends = train.count()
    total, vocabulary = counts.agg(F.sum("n"), F.count("*")).first()
    total, vocabulary = (total or 0) + ends, vocabulary + bool(ends)
    # The head: all words at or above the least count for which they are few enough.
    cut, so_far = 1 << 62, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(100_000).collect():
        so_far += r.words
        if so_far > head:
            break
        cut = r.n
    often = counts.orderBy(F.desc("n"), "word").limit(top + middle).toArrow()
    o_word, o_n = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(o_word[:top])
    t_word, t_n, m_word = o_word[:top][order], o_n[:top][order], np.sort(o_word[top:])

    n = bigram_counts(train, t_word, np.arange(len(t_word)), len(t_word))
    classes = max(1, min(classes, len(t_word)))
    of = exchange(n, len(t_word), classes)
    k = classes + FORMS + 1
    z = np.zeros((len(n), k))
    z[np.arange(len(n)), of] = 1
    m, known, known_of = z.T @ n @ z, t_word, of[: len(t_word)]
    m_of = np.zeros(0, np.int64)
    if len(m_word):
        joined = assign(neighbours(train, known, known_of, classes, k - 1, m_word, True), m, classes).select("word", "class").toArrow()
        word, m_of = joined["word"].to_numpy().view(np.uint64), joined["class"].to_numpy()
        order = np.argsort(word)
        m_word, m_of = word[order], m_of[order]
        known = np.concatenate([t_word, m_word])
        order = np.argsort(known)
        known, known_of = known[order], np.concatenate([known_of, m_of])[order]
        m = bigram_counts(train, known, known_of, classes)
    others = durable(assign(neighbours(train, known, known_of, classes, k - 1, t_word, False), m, classes, m_word, m_of))
    distinct = np.bincount(of[: len(t_word)], minlength=k).astype(float)
    for r in others.groupBy("class").count().collect():
        distinct[r["class"]] += r["count"]
    held = others.where(F.col("n") >= cut).toArrow()
    h_word = np.concatenate([t_word, held["word"].to_numpy().view(np.uint64)])
    order = np.argsort(h_word)
    h_word, h_class = h_word[order], np.concatenate([of[: len(t_word)], held["class"].to_numpy()])[order]
    h_log = np.log10(np.concatenate([t_n, held["n"].to_numpy()])[order] + 0.5)
    kind, letter = rows.schema["doc_id"].dataType.simpleString(), np.min_scalar_type(k)

    def run(block, batch):
        word, form, at = tokens(block)
        now, _, row = symbols(word, form, at, block.rows, h_word, h_class, classes, k - 1)
        unique, back = np.unique(word, return_inverse=True)
        place, known = _find(h_word, unique)
        logs = np.where(known, h_log[place] if len(h_log) else 0.0, math.log10(0.5))
        known_at = known[back] if len(word) else np.zeros(0, bool)
        log = np.bincount(at, logs[back], block.rows) if len(word) else np.zeros(block.rows)
        count = np.bincount(at, minlength=block.rows)
        inside = np.bincount(at[known_at], minlength=block.rows)
        rest = np.flatnonzero(~known_at)
        first = np.cumsum(count) - count
        cuts = np.concatenate([[0], np.cumsum(count + 1)])
        offsets = pa.array(np.concatenate([[0], np.cumsum(count - inside)]).astype(np.int32))
        places = pa.ListArray.from_arrays(offsets, pa.array((rest - first[at[rest]] if len(rest) else rest).astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array((count + 1).astype(np.int64)), pa.array(inside.astype(np.int64)), pa.array(log),
                _strings(now.astype(letter), cuts), pa.ListArray.from_arrays(offsets, pa.array(word[rest].view(np.int64))), places,
            ],
            ["doc_id", "held_out", "n_tokens", "known", "log", "classes", "rest", "places"],
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, log double, classes binary, rest array<bigint>, places array<bigint>"
    spelt = durable(map_blocks(rows, "text", schema, run))
    if vocabulary - bool(ends) > len(h_word):
        spelt = durable(_filled(spelt.withColumn("_row", F.monotonically_increasing_id()), others.where(F.col("n") < cut), schema, letter))  # numbers fixed rows
    m = transitions(spelt.where(~F.col("held_out")), k)
    step = np.log10((m + ALPHA) / (m.sum(1, keepdims=True) + ALPHA * k))
    emit = -np.log10(m.sum(0) + 0.5 * (distinct + 1))
    emit[k - 1] = 0.0

    def score(batches):
        for batch in batches:
            now, cuts = _numbers(batch.column("classes"), letter)
            now = now.astype(np.int64)
            before = np.concatenate([[k - 1], now[:-1]])[: len(now)]  # every string ends in the end class
            model = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(cuts)), step[before, now] + emit[now], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "known", "log")], pa.array(model)], ["doc_id", "held_out", "n_tokens", "known", "log", "model"])

    out = spelt.select("doc_id", "held_out", "n_tokens", "known", "log", "classes").mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, log double, model double")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log") + F.lit(math.log10(ends + 0.5)) - F.col("n_tokens") * F.lit(math.log10(total + 0.5 * (vocabulary + 1)))).alias("base_score"),
        (F.col("model") + F.col("log")).alias("score"),
    )


def _filled(spelt: DataFrame, tail: DataFrame, schema: str, letter: np.dtype) -> DataFrame:
    """The strings with the classes and logs of words beyond the head table; words of neither stay in their forms."""
    asked = spelt.select("_row", F.explode(F.arrays_zip("rest", "places")).alias("x")).select("_row", F.col("x.rest").alias("word"), F.col("x.places").alias("at"))
    met = asked.join(tail.hint("merge"), "word").groupBy("_row").agg(F.collect_list("at").alias("_at"), F.collect_list("class").alias("_class"), F.sum(F.log10(F.col("n") + F.lit(0.5)) - F.lit(math.log10(0.5))).alias("_log"))
    joined = spelt.join(met, "_row", "left")

    def run(batches):
        for batch in batches:
            now, cuts = _numbers(batch.column("classes"), letter)
            at, of = batch.column("_at"), batch.column("_class")
            n = at.value_lengths().fill_null(0).to_numpy()
            now[np.repeat(cuts[:-1], n) + at.flatten().to_numpy()] = of.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array(batch.column("known").to_numpy() + n), pa.array(batch.column("log").to_numpy() + batch.column("_log").fill_null(0.0).to_numpy()), _strings(now, cuts)], names)

    kept = schema.split(", rest ")[0]
    names = [c.split()[0] for c in kept.split(", ")]
    return joined.select(*names, "_at", "_class", "_log").mapInArrow(run, kept)


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (a lexicon of words and word stems with weights, learned from labelled rows), and fixed lists of
negations, reporting verbs, second-person targets, threats and their auxiliaries. Transducers over these symbols are composed:
`negation` marks what a negation directly governs, `reported` marks what follows a reporting verb in its clause, `target` marks
what stands near a target, `threat` turns auxiliary + threat + target into a threat. Each passes on what the one before it
wrote. A clause's weight is the sum of what the last one writes; a document's score is the logistic of the prior and of its
clauses' weights. A lone insult makes its clause a matched one; the marks around it only change its weight.

The lexicon is learned from a sample of at most LABEL_ROWS labelled rows, equal texts of one label counted once: features (words,
and stems of STEMS characters) are kept if they are in toxic texts more often than chance explains, and in many different
contexts, so that the words of one text that was written anew with few changes do not count as insults.

Defined results: a null, empty or blank text has no clause and scores the least; repeated rows score the same; without labels
of both kinds only the fixed lists work; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .common import durable, table
from .labelled import labelled_sample, remainder
from .textkit import Block, Hasher, blocks, fold, hash_words, map_blocks, words

MODULUS, HELD_OUT = 3, 1
LABEL_ROWS = 40_000
STEMS = (4, 5, 6, 7, 8)
CUT = 0.7
#: A feature needs so many toxic texts, so many different contexts (also for each toxic text), and a share of toxic texts.
MIN_ROWS, MIN_CONTEXTS, MIN_VARIED, MIN_SHARE = 4, 4, 0.5, 0.95

#: Closed word lists of the grammar (English, German, French, Spanish).
NEGATIONS = "not never no isn aren wasn nicht kein keine niemals jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says saying called calls quoted quotes wrote writes reported sagte sagt nannte schrieb écrit disait appelé dijo dice llamó escribió".split()
TARGETS = "you your yours yourself du dich dir dein deine ihr euch tu toi vous votre tú ti usted ustedes vosotros".split()
THREATS = "kill hurt murder destroy burn stab shoot töten umbringen verletzen tuer frapper brûler matar golpear quemar".split()
AUXILIARIES = "will shall going gonna werde werden vais allons voy vamos".split()
CLAUSE_END = re.compile(r"[.!?;\n]+")
WORD = regex.compile(r"\p{L}+")

OTHER, INSULT, NEGATION, REPORT, TARGET, THREAT, AUX, THREATENING = range(8)
#: What a mark leaves of an insult's weight, and the weights of a target nearby and of a full threat.
NEGATED, REPORTED, AIMED, THREAT_WEIGHT = 0.3, 0.3, 1.2, 6.0


@dataclass
class Transducer:
    """Reads (symbol, weight) pairs and writes such pairs; step(state, symbol, weight) -> (state, symbol, weight)."""

    start: int
    step: callable

    def __call__(self, pairs):
        state = self.start
        for symbol, weight in pairs:
            state, symbol, weight = self.step(state, symbol, weight)
            yield symbol, weight


def compose(*machines: Transducer):
    """The composition reads what the first one reads and writes what the last one writes."""

    def run(pairs):
        for m in machines:
            pairs = m(pairs)
        return pairs

    return run


def _negation(state, symbol, weight):
    """States: words since a negation, up to 2; it governs an insult or threat directly or over one word."""
    if symbol == NEGATION:
        return 2, symbol, weight
    if state and symbol in (INSULT, THREAT):
        return 0, symbol, weight * NEGATED
    return max(state - 1, 0), symbol, weight


def _reported(state, symbol, weight):
    """State 1: within six words of a reporting verb."""
    if symbol == REPORT:
        return 6, symbol, weight
    if state and symbol in (INSULT, THREAT):
        return state - 1, symbol, weight * REPORTED
    return max(state - 1, 0), symbol, weight


def _target(state, symbol, weight):
    if symbol == TARGET:
        return 5, symbol, weight
    if state and symbol == INSULT:
        return state - 1, symbol, weight * AIMED
    return max(state - 1, 0), symbol, weight


def _threat(state, symbol, weight):
    """States 0..4: words left after an auxiliary; 10 + words left after auxiliary and threat."""
    if symbol == AUX:
        return 4, symbol, weight
    if 0 < state < 10 and symbol == THREAT:
        return 10 + round(weight * 100) * 10 + 3, OTHER, 0.0
    if state >= 10:
        left = state % 10
        if symbol == TARGET:
            return 0, THREATENING, THREAT_WEIGHT * (state // 10 - 1) / 100
        return (state - 1 if left > 1 else 0), symbol, weight
    return max(state - 1, 0), symbol, weight


GRAMMAR = compose(Transducer(0, _negation), Transducer(0, _reported), Transducer(0, _target), Transducer(0, _threat))
_FIXED = {w: s for s, group in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (THREAT, THREATS), (AUX, AUXILIARIES)) for w in group}


@dataclass
class Lexicon:
    """weight by feature hash; prior: log odds of a toxic text."""

    weights: dict[int, float] = field(default_factory=dict)
    prior: float = -3.0

    def weight(self, word: str) -> float:
        forms = [word, *(word[:n] for n in STEMS if len(word) > n)]
        return max(self.weights.get(h, 0.0) for h in hash_words(forms).tolist())

    def clauses(self, text: str, weigh=None) -> list[tuple[str, float]]:
        """Matched clauses with their weights. weigh: weights of words if they are known already."""
        weigh = weigh or self.weight

        def symbol(word: str) -> tuple[int, float]:
            if word in _FIXED:
                return _FIXED[word], 1.0
            w = weigh(word)
            return (INSULT, w) if w else (OTHER, 0.0)

        out = []
        for clause in CLAUSE_END.split(text.lower()):
            weight = sum(w for s, w in GRAMMAR(map(symbol, WORD.findall(clause))) if s in (INSULT, THREATENING))
            if weight > 0:
                out.append((clause.strip(), weight))
        return out

    def score(self, clauses: list[tuple[str, float]]) -> float:
        odds = self.prior + (sum(w for _, w in clauses) if clauses else -1.5)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case of each code point where it is one character."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in (*range(0xD800), *range(0xE000, 0x20000)):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def _letters(block: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """The block in lower case, and bounds and rows of its words of letters."""
    low = Block(block.first, _lower()[block.cp], block.offsets)
    kind = (classes()[low.cp] == LETTER).astype(np.uint32)
    starts, ends, rows = words(Block(block.first, kind, block.offsets), np.arange(256) == 1)
    return low, starts, ends, rows


def _features(h: Hasher, starts: np.ndarray, ends: np.ndarray):
    """(hashes, which words) of whole words and of each stem length."""
    yield h.of(starts, ends), np.arange(len(starts))
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        yield h.of(starts[long], starts[long] + n), long


def _count(sample: DataFrame, only: np.ndarray | None) -> DataFrame:
    """feature, n: rows of the sample that hold each feature (of `only`, sorted, if given); summed up within a task first."""

    def run(batches):
        keys, counts, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        known = np.zeros(0 if only is None else len(only), np.int64)
        fresh: list[np.ndarray] = []

        def merged():
            x, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *fresh]), return_counts=True)
            x, n = np.concatenate([keys, x]), np.concatenate([counts, n])
            order = np.argsort(x, kind="stable")
            x, n = x[order], n[order]
            cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            return x[cuts], (np.add.reduceat(n, cuts) if len(x) else n)

        for batch in batches:
            for block in blocks(batch.column("text")):
                low, starts, ends, rows = _letters(block)
                if not len(starts):
                    continue
                h = Hasher(low.cp)
                for hashes, which in _features(h, starts, ends):
                    r = rows[which]
                    if only is not None:
                        at = np.minimum(np.searchsorted(only, hashes), len(only) - 1)
                        hit = only[at] == hashes
                        pair = np.unique(at[hit] * np.int64(block.rows) + r[hit])
                        known += np.bincount(pair // block.rows, minlength=len(only))
                        continue
                    order = np.lexsort((r, hashes))
                    x, y = hashes[order], r[order]
                    one = np.ones(len(x), bool)
                    one[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    fresh.append(x[one])
                    held += len(fresh[-1])
            if held > 4_000_000:
                keys, counts = merged()
                fresh, held = [], 0
                if len(keys) > 1_000_000:
                    yield _pairs(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        if only is not None:
            seen = np.flatnonzero(known)
            yield _pairs(only[seen], known[seen])
        else:
            yield _pairs(*merged())

    return sample.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["feature", "n"])


def _contexts(sample: DataFrame, only: np.ndarray) -> DataFrame:
    """feature, n: distinct pairs of neighbouring words around each feature's occurrences."""

    def run(block, batch):
        low, starts, ends, rows = _letters(block)
        if not len(starts) or not len(only):
            return None
        h = Hasher(low.cp)
        whole = h.of(starts, ends)
        left, right = np.zeros(len(whole), np.uint64), np.zeros(len(whole), np.uint64)
        same = rows[1:] == rows[:-1]
        left[1:] = np.where(same, whole[:-1], np.uint64(0))
        right[:-1] = np.where(same, whole[1:], np.uint64(0))
        around = fold(np.stack([left, right], 1).ravel(), 2 * np.arange(len(left)), 2 * np.arange(len(left)) + 2)
        found = []
        for hashes, which in _features(h, starts, ends):
            at = np.minimum(np.searchsorted(only, hashes), len(only) - 1)
            hit = only[at] == hashes
            found.append(np.stack([hashes[hit], around[which][hit]], 1))
        pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["feature", "around"])

    return map_blocks(sample.select("text"), "text", "feature bigint, around bigint", run).groupBy("feature").agg(F.count_distinct("around").alias("n"))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features in order and their counts."""
    got = counts.select("feature", "n").toArrow()
    keys, n = got["feature"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _looked_up(counts: DataFrame, only: np.ndarray) -> np.ndarray:
    """The count of each feature of `only`, 0 where it has none."""
    keys, n = _collected(counts)
    out = np.zeros(len(only), np.int64)
    out[np.searchsorted(only, keys)] = n
    return out


def learn(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = LABEL_ROWS) -> Lexicon:
    # Copies of a text say nothing new about its words: they are counted once.
    sample = durable(labelled_sample(docs, labels, "toxic", modulus, held_out, rows).dropDuplicates(["text", "_label"]))
    n = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    toxic, clean = sample.where("_label = 1"), sample.where("_label = 0")
    often = durable(_count(toxic, None).where(F.col("n") >= MIN_ROWS))
    share = n[1] / (n[1] + n[0])
    need = math.log(200 * max(often.count(), 1))  # so that chance alone passes about one feature in two hundred fits
    # Clean texts only lower what a feature reaches: one that misses `need` without any is out before they are counted.
    only, t = _collected(often.where(F.col("n") * -math.log(share) >= need * (1 - 1e-9)))
    c = _looked_up(_count(clean, only), only) if len(only) else t
    q = t / (t + c)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (t + c) * (q * np.log(q / share) + np.where(c > 0, (1 - q) * np.log((1 - q) / (1 - share)), 0.0))
    fits = (q >= MIN_SHARE) & (gain >= need)
    only, t, c = only[fits], t[fits], c[fits]
    contexts = _looked_up(_contexts(toxic, only), only) if len(only) else t
    varied = contexts >= np.maximum(MIN_CONTEXTS, MIN_VARIED * t)
    weights = np.clip(np.log((t / n[1]) / ((c + 0.5) / n[0])), 4.0, 9.0)
    return Lexicon(dict(zip(only[varied].tolist(), weights[varied].tolist())), max(-3.0, math.log(n[1] / n[0])))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses of every row."""
    lexicon = learn(docs, labels)
    known = np.array(sorted({*lexicon.weights, *hash_words(THREATS).tolist()}), np.uint64)
    rows = docs.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    least = lexicon.score([])

    def run(block, batch):
        low, starts, ends, at = _letters(block)
        score, matched = np.full(block.rows, least), np.zeros(block.rows, np.int64)
        if len(starts):
            h = Hasher(low.cp)
            _, first, back = np.unique(h.of(starts, ends), return_index=True, return_inverse=True)
            hit = np.zeros(len(first), bool)
            for hashes, which in _features(h, starts[first], ends[first]):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit[which] |= known[place] == hashes
            own = {}
            for i in np.flatnonzero(hit):
                word = low.cp[starts[first[i]] : ends[first[i]]].astype("<u4").tobytes().decode("utf-32-le")
                own[word] = lexicon.weight(word)
            for r in np.unique(at[hit[back]]):
                found = lexicon.clauses(batch.column("text")[int(r)].as_py(), lambda w, own=own: own.get(w, 0.0))
                matched[r], score[r] = len(found), lexicon.score(found)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(matched)], ["doc_id", "held_out", "score", "predicted", "n_clauses"])

    return map_blocks(rows, "text", f"doc_id {kind}, held_out boolean, score double, predicted int, n_clauses bigint", run)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

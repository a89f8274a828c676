"""Document quality by gated attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text is encoded by statistics of its characters
and words, and by the share of its 3-word windows that the document repeats; no figure of the whole document is pasted into them.
Gated attention, softmax over w.(tanh(V h) * sigmoid(U h)), weighs the passages of a bag, and a logistic layer scores
the weighted sum. Attention and scorer are learned together from document labels, on the driver, from a sample of at most
LABEL_ROWS labelled rows, with every passage; scoring takes every passage of every row.

Defined results: a null, empty or blank text is a bag of one passage of zeros and gets a score like any other; repeated rows get
the same score; without labels of both kinds the score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .labelled import labelled_sample, remainder
from .textkit import NOT_SPACE, Block, Hasher, fold, map_blocks, words

PASSAGE = 64
LABEL_ROWS = 6000
HIDDEN, EPOCHS, RATE, BATCH = 16, 60, 0.01, 256
CUT = 0.7
MODULUS, HELD_OUT = 4, 2


def _shape() -> np.ndarray:
    """Rows: kinds of characters; columns: code points below 256."""
    c = np.arange(256)
    s = [chr(i) for i in c]
    return np.array([
        [x.isupper() for x in s], [x.islower() for x in s], [x.isdigit() for x in s], [x in "#*$%&<>" for x in s], [x == "|" for x in s],
        [x == "!" for x in s], [x in ".,;:?" for x in s], [x in "@/\\=_+-()[]{}\"'" for x in s], [x in "\n\r" for x in s], c >= 128,
    ], np.float64)


SHAPE = _shape()
FEATURES = len(SHAPE) + 8


def encode(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (row after row), and the number of passages of each row, one at least."""
    starts, ends, rows = words(block, NOT_SPACE)
    count = np.bincount(rows, minlength=block.rows).astype(np.int64)
    bags = np.maximum(-(-count // PASSAGE), 1)
    first = np.cumsum(bags) - bags
    out = np.zeros((int(bags.sum()), FEATURES))
    if not len(starts):
        return out, bags
    at = np.arange(len(starts)) - (np.cumsum(count) - count)[rows]
    passage = first[rows] + at // PASSAGE
    n = np.maximum(np.bincount(passage, minlength=len(out)), 1).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    chars = np.maximum(np.bincount(passage, length, len(out)), 1)
    # Characters belong to the passage of the word before them.
    lead = np.searchsorted(starts, np.arange(len(block.cp)), "right") - 1
    owner = passage[np.maximum(lead, 0)]
    low = np.minimum(block.cp, 255)
    for i, kind in enumerate(SHAPE):
        inside = np.flatnonzero(kind[low])
        out[:, i] = np.bincount(owner[inside], minlength=len(out)) / chars
    hashes = Hasher(block.cp).of(starts, ends)
    k = len(SHAPE)
    out[:, k] = np.log1p(n) / 4
    out[:, k + 1] = chars / n / 10
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(passage, length**2, len(out)) / n - (chars / n) ** 2, 0)) / 10
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (passage[order][1:] != passage[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    out[:, k + 3] = np.bincount(passage[order], fresh, len(out)) / n
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out[:, k + 4] = np.bincount(passage, again, len(out)) / n
    # Three-word windows that occur twice or more in the row.
    if len(starts) > 2:
        i = np.flatnonzero(rows[2:] == rows[:-2])
        window = fold(hashes, i, i + 3)
        order = np.lexsort((window, rows[i]))
        w, r = window[order], rows[i][order]
        same = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(i), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out[:, k + 5] = np.bincount(passage[i], twice, len(out)) / n
    upper = SHAPE[0][np.minimum(block.cp[starts], 255)]
    out[:, k + 6] = np.bincount(passage, upper, len(out)) / n
    out[:, k + 7] = np.bincount(passage, length > 20, len(out)) / n
    return out, bags


class GatedAttention:
    """One scorer: numpy arrays, small enough to travel with a task."""

    def __init__(self, d: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.p = {"V": rng.normal(0, 0.3, (d, hidden)), "U": rng.normal(0, 0.3, (d, hidden)), "w": rng.normal(0, 0.3, hidden), "c": np.zeros(d), "b": np.zeros(1)}
        self.trained = False

    def _forward(self, x: np.ndarray, bags: np.ndarray):
        p, cuts = self.p, np.cumsum(bags) - bags
        t, g = np.tanh(x @ p["V"]), 1 / (1 + np.exp(-np.clip(x @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, cuts), bags))
        a = e / np.repeat(np.add.reduceat(e, cuts), bags)
        z = np.add.reduceat(a[:, None] * x, cuts, axis=0)
        return t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(bags), 0.5)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), bags)[-1]

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> GatedAttention:
        if len(set(y.tolist())) < 2:
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        # Both labels weigh alike, so that 0.5 is where they balance.
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        first, rng = np.cumsum(bags) - bags, np.random.default_rng(3)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                b = bags[pick]
                index = np.concatenate([np.arange(first[i], first[i] + bags[i]) for i in pick])
                grad = self._gradient(x[index], b, y[pick], weight[pick])
                step += 1
                for k, g in grad.items():
                    g = g + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True
        return self

    def _gradient(self, x, bags, y, weight):
        p, cuts = self.p, np.cumsum(bags) - bags
        t, g, a, z, s = self._forward(x, bags)
        d = weight * (s - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], bags, axis=0)
        da = (dz * x).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, cuts), bags))
        dtg = de[:, None] * p["w"]
        return {"c": z.T @ d, "b": np.array([d.sum()]), "w": (t * g).T @ de, "V": x.T @ (dtg * g * (1 - t * t)), "U": x.T @ (dtg * t * g * (1 - g))}


def train(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, rows: int = LABEL_ROWS) -> GatedAttention:
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, rows)

    def run(block, batch):
        x, bags = encode(block)
        to = np.cumsum(bags)
        packed = [x[t - n : t].astype("<f4").tobytes() for t, n in zip(to, bags, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(packed, pa.binary())], ["_label", "x"])

    found = map_blocks(sample, "text", "_label int, x binary", run).toPandas()
    found = found.sort_values(["_label", "x"], kind="stable")  # the fit does not depend on the order of tasks
    parts = [np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(np.float64) for x in found["x"]]
    model = GatedAttention(FEATURES)
    return model.fit(np.concatenate(parts), np.array([len(p) for p in parts]), found["_label"].to_numpy().astype(float)) if parts else model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every row."""
    model = train(docs, labels)
    rows = docs.select("doc_id", (remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(block, batch):
        x, bags = encode(block)
        s = np.clip(model.score(x, bags), 0, 1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(bags)], ["doc_id", "held_out", "score", "predicted", "n_passages"])

    return map_blocks(rows, "text", f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages bigint", run)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""The embedding stage around an injected embedder: bounded batches, retries, isolation of texts that fail."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_TEXTS, BATCH_CHARS, ATTEMPTS, BACKOFF = 32, 24_000, 4, 0.05


def batches(texts: list[str], size: int = BATCH_TEXTS, chars: int = BATCH_CHARS):
    """(start, end) of consecutive batches; a longer text is a batch of its own."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= size or n + len(t) > chars):
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


def hash_embedder(texts: list[str], dim: int = 16) -> list[list[float]]:
    """Deterministic vectors for tests; a real model is injected in its place."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], attempts: int = ATTEMPTS) -> DataFrame:
    """rows (id, text) -> id, vector, error. A batch that keeps failing is tried text by text; only the killers get an error."""
    kind = rows.schema["id"].dataType.simpleString()

    def call(texts):
        for i in range(attempts):
            try:
                return embedder(texts)
            except (ConnectionError, TimeoutError):
                if i + 1 == attempts:
                    raise
                time.sleep(BACKOFF * 2**i)

    def run(parts):
        for b in parts:
            texts = [(t or "").replace('"', "'").replace("]", ")") for t in b.column("text").to_pylist()]
            vectors, errors = [None] * len(texts), [None] * len(texts)
            for s, e in batches(texts):
                try:
                    vectors[s:e] = call(texts[s:e])
                except Exception:
                    for i in range(s, e):
                        try:
                            vectors[i] = call([texts[i]])[0]
                        except Exception as x:
                            errors[i] = f"{type(x).__name__}: {x}"[:200]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["id", "vector", "error"])

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, vector array<float>, error string")

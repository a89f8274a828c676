"""Packing and the encoder it stands on: differencing against tuples of all windows, words encoded together against the tokenizer."""

import heapq
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import packing
from corpusloom.llm.bpe import Vocabulary, default_path
from corpusloom.llm.textkit import blocks


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def plain_sums(sizes, k):
    """Window sums of differencing over tuples that hold all k windows."""
    heap = [(-int(x), i, [int(x)] + [0] * (k - 1)) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], len(sizes) * 2 - len(heap), both))
    return heap[0][2]


def test_differencing_holds_only_windows_in_use():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes, k = np.sort(rng.integers(1, rng.choice([3, 40, 2048]), rng.integers(1, 60)))[::-1], int(rng.integers(1, 20))
        assert sorted(np.bincount(packing.difference(sizes, k), sizes, k), reverse=True) == plain_sums(sizes, k)
    tracemalloc.start()
    assert len(set(packing.pack(np.full(4096, 512)))) == 1024
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000, peak


def test_new_words_are_encoded_together(tokenizer):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiouthnsr") for _ in range(11)) for _ in range(3000)]
    signs = [" 's", " 're", "'ll", "\x1c", "\x85", "\n ", "   ", " \u200b", " é", " 😀", " <|endoftext|>", " =", ",", " ½Ⅷ"]
    texts_ = [" ".join(words[i : i + 50]) + "".join(rng.choice(signs) for _ in range(30)) for i in range(0, 3000, 50)]
    vocab, strings = Vocabulary(default_path()), []

    class Counting:
        def encode_batch_fast(self, batch, **kw):
            strings.extend(batch)
            return tokenizer.encode_batch_fast(batch, **kw)

        def encode(self, *args, **kw):
            return tokenizer.encode(*args, **kw)

    vocab.tokenizer = Counting()
    for block in blocks(pa.array(texts_)):
        ids, offsets = vocab.encode(block)
        for r in range(block.rows):
            assert ids[offsets[r] : offsets[r + 1]].tolist() == tokenizer.encode(texts_[block.first + r], add_special_tokens=False).ids
    assert len(vocab.known) - len(vocab.whole) > 2900 and len(strings) < 200
    # Where bytes do not tell whose an id is, every word is encoded alone.
    vocab._forget()
    vocab.bytes = vocab.bytes * 0
    (block,) = blocks(pa.array([" alphathble betathble"]))
    assert vocab.encode(block)[0].tolist() == tokenizer.encode(" alphathble betathble", add_special_tokens=False).ids


def test_a_worker_holds_little_at_a_time(spark, tokenizer, monkeypatch):
    """Results of the tokenizer, Python strings of a block and Arrow batches are taken in slices; ids stay the same."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("bcdaeiou") for _ in range(9)) for _ in range(30_000)) + "\n" * 3000 + "\n".join(map(str, range(3000)))
    vocab, most = Vocabulary(default_path()), []

    class Counting:
        def encode_batch_fast(self, batch, **kw):
            most.append(len(batch))
            return tokenizer.encode_batch_fast(batch, **kw)

    vocab.tokenizer = Counting()
    (block,) = blocks(pa.array([text]))
    assert vocab.encode(block)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert max(most) <= 64 < sum(most)

    seen, plain = [], packing.pieces

    def watched(docs, *args):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return plain(docs, *args)

    monkeypatch.setattr(packing, "pieces", watched)
    docs = spark.range(25).selectExpr("id doc_id", "repeat('a', 10) text")
    assert packing.pack_sequences(docs).count() == 25 and seen == ["1000"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"

"""Byte-level BPE over Arrow batches, by pre-tokens.

The pre-tokenizer's pattern is evaluated on arrays: runs of letters, numbers, white space and the rest, one preceding space
joined, contractions and the white-space look-ahead as the pattern orders them. Arrow's dictionary encoding then finds the distinct
pre-tokens of a block, comparing strings, never hashes alone. `Vocabulary.whole` is the shortcut: the vocabulary strings that were
proven, by encoding each alone with the tokenizer itself, to be one token; only other pre-tokens are merged, each distinct one once
per worker until the bounded memory of merges is full. Texts that hold the string of an added token go to the tokenizer as they are.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import Block, ragged

#: Distinct merged pre-tokens kept by a worker before it starts anew, about 150 bytes each, and their letters.
MEMORY, MEMORY_LETTERS = 400_000, 8_000_000
#: New pre-tokens that are encoded as one string, where they may be, and strings that the tokenizer gets at a time: what it gives back
#: holds each token's string, about 100 bytes a token, until its ids are taken.
JOINED, AT_ONCE = 64, 64
#: Pre-tokens of a block that are Python strings at a time.
LOOKED_UP = 50_000
#: Code points that are classified at a time.
POINTS = 1 << 14
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point as the tokenizer's pattern sees it. White space is Unicode's White_Space."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for first in range(0, 0x110000, POINTS):
        some = "".join(chr(c) for c in range(first, first + POINTS) if not 0xD800 <= c < 0xE000)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
            found = regex.findall(f"{pattern}+", some)
            out[np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)] = kind
    return out


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens (each ends where the next one starts) and the row of each."""
    cp, offsets = block.cp, block.offsets
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    start = change.copy()
    # White space before a visible character of the same row: its last character starts a token of its own or, if it is a
    # plain space, leads the next run.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
    start |= last
    at = np.flatnonzero(last & (cp == 32)) + 1
    start[at] = False
    # A lone apostrophe that starts a token, with the letters of a contraction after it.
    quote = np.flatnonzero((cp[:-1] == 39) & start[:-1] & start[1:] & (kind[1:] == LETTER) & ~edge[1:-1]) if n > 1 else []
    for q in quote:
        row_end = int(offsets[np.searchsorted(offsets, q, "right")])
        two = "".join(map(chr, cp[q + 1 : min(q + 3, row_end)]))
        size = 1 if two[:1] in ("s", "t", "m", "d") else 2 if two in ("re", "ve", "ll") else 0
        if size:
            start[q + 1 : q + 1 + size] = False
            rest = q + 1 + size
            if rest < row_end and kind[rest] == LETTER:
                start[rest] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(offsets, starts, "right") - 1


class Vocabulary:
    """One tokenizer in a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each id: byte-level vocabularies write one symbol for each.
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(1 + max([*vocab.values(), *self.tokenizer.get_added_tokens_decoder()]), np.int64)
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        self.whole = self._prove()
        self._forget()

    def _prove(self) -> dict[str, int]:
        """The vocabulary strings that encode alone as exactly their one token, and its id."""
        byte = _bytes_of_symbols()
        texts, ids = [], []
        for symbol, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes(byte[c] for c in symbol).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            texts.append(text)
            ids.append(i)
        found, size = self._encode_apart(texts)
        one = (size == 1) & (found[np.minimum(np.cumsum(size) - size, len(found) - 1)] == ids)
        return {texts[k]: ids[k] for k in np.flatnonzero(one)}

    def _forget(self) -> None:
        """Places of pre-tokens, the proven ones first; by place, where the ids lie and how many they are."""
        self.known = dict(zip(self.whole, range(len(self.whole)), strict=True))
        self.at, self.size = np.arange(len(self.whole)), np.ones(len(self.whole), np.int64)
        self.ids, self.used = np.fromiter(self.whole.values(), np.uint32, len(self.whole)), len(self.whole)
        self.letters = 0

    def _encode_apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size[-1].sum())))
        return np.concatenate(ids), np.concatenate(size)

    def _encode_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pre-tokens that are each a space and a visible run, many at a time: the pattern splits before such a space. Bytes tell
        whose the ids are; if they do not add up, each is encoded alone."""
        ids, _ = self._encode_apart(["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])
        ends = np.cumsum(self.bytes[ids])
        bounds = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        last = np.searchsorted(ends, bounds)
        if len(last) and (last[-1] != len(ids) - 1 or (ends[last] != bounds).any()):
            return self._encode_apart(texts)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Encodes new pre-tokens and gives their places."""
        texts, led, others = new.to_pylist(), [], []
        for i, t in enumerate(texts):
            (led if t[0] == " " and len(t) > 1 and not t[1].isspace() else others).append(i)
        flat, size = map(np.concatenate, zip(self._encode_joined([texts[i] for i in led]), self._encode_apart([texts[i] for i in others]), strict=True))
        at = self.used + np.cumsum(size) - size
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        order, place = np.array(led + others, np.int64), np.empty(len(texts), np.int64)
        place[order] = np.arange(len(self.known), len(self.known) + len(texts))
        self.known.update(zip(texts, place.tolist(), strict=True))
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        self.letters += sum(map(len, texts))
        return place

    def lookup(self, block: Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pre-token: where its ids lie in self.ids, how many they are, and whether the shortcut gave them."""
        raw, begin = block.utf8()
        offsets = np.append(begin[starts], len(raw))
        wide = len(raw) >= 1 << 31
        kind = (pa.LargeStringArray if wide else pa.StringArray).from_buffers
        encoded = kind(len(starts), pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(raw)).dictionary_encode()
        distinct = encoded.dictionary.cast(pa.large_string())
        known = self._places(distinct)
        new = distinct.filter(pa.array(known < 0))
        if len(new) and (len(self.known) + len(new) > MEMORY + len(self.whole) or self.letters + pc.sum(pc.utf8_length(new)).as_py() > MEMORY_LETTERS):
            self._forget()
            known = self._places(distinct)
            new = distinct.filter(pa.array(known < 0))
        if len(new):
            known[known < 0] = np.concatenate([self._learn(new.slice(i, LOOKED_UP)) for i in range(0, len(new), LOOKED_UP)])
        place = known[encoded.indices.to_numpy()]
        return self.at[place], self.size[place], place < len(self.whole)

    def _places(self, texts: pa.Array) -> np.ndarray:
        """The place of each text that is known, -1 of the others."""
        out = np.empty(len(texts), np.int64)
        for i in range(0, len(texts), LOOKED_UP):
            some = texts.slice(i, LOOKED_UP).to_pylist()
            out[i : i + len(some)] = list(map(self.known.get, some, repeat(-1)))
        return out

    def special_rows(self, block: Block) -> list[int]:
        """Rows whose text holds an added token's string."""
        if not self.added:
            return []
        text = block.cp.astype("<u4").tobytes().decode("utf-32-le")
        out = set()
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                row = int(np.searchsorted(block.offsets, at, "right")) - 1
                if at + len(token) <= block.offsets[row + 1]:
                    out.add(row)
                at = text.find(token, at + 1)
        return sorted(out)

    def row_text(self, block: Block, row: int) -> str:
        return block.cp[block.offsets[row] : block.offsets[row + 1]].astype("<u4").tobytes().decode("utf-32-le")

    def counts(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each row, and how many of them the shortcut gave."""
        starts, rows = pretokens(block)
        by_shortcut = np.zeros(block.rows, np.int64)
        if len(starts):
            _, size, whole = self.lookup(block, starts)
            out = np.bincount(rows, size, block.rows).astype(np.int64)
            by_shortcut = np.bincount(rows, whole, block.rows).astype(np.int64)
        else:
            out = np.zeros(block.rows, np.int64)
        for r in self.special_rows(block):
            out[r] = len(self.tokenizer.encode(self.row_text(block, r), add_special_tokens=False).ids)
            by_shortcut[r] = 0
        return out, by_shortcut

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's rows one after another, and the offsets of the rows."""
        starts, rows = pretokens(block)
        if len(starts):
            at, size, _ = self.lookup(block, starts)
            ids, count = self.ids[ragged(at, size)], np.bincount(rows, size, block.rows).astype(np.int64)
        else:
            ids, count = np.zeros(0, np.uint32), np.zeros(block.rows, np.int64)
        if special := self.special_rows(block):
            offsets = np.concatenate([[0], np.cumsum(count)])
            parts = [ids[offsets[r] : offsets[r + 1]] for r in range(block.rows)]
            for r in special:
                parts[r] = np.array(self.tokenizer.encode(self.row_text(block, r), add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD and not unicodedata.category(chr(b)).startswith(("Z", "C"))]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)

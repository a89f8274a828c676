"""A tokenizer as the library sees it: where the tokens of a text lie, and how many a model is served. Always injected, never approximated."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A single space between visible characters; words that a worker knows the counts of, and their greatest length.
CUT = re.compile(r"(?<=\S) (?=\S)")
WORDS, WORD_LENGTH = 200_000, 64


class Tokenizer(Protocol):
    def spans(self, text: str) -> list[tuple[int, int]]:
        """Code points [start, end) of each token, special tokens left out."""

    def served(self, text: str) -> int:
        """Tokens with the special ones around them."""


class JsonTokenizer:
    """A tokenizers file. `around`: special tokens that a model adds where the file itself adds none."""

    def __init__(self, path: str, around: int = 0):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer as Library

        self.library, self.around = Library.from_file(path), around
        state = json.loads(self.library.to_str())
        pre, model = state["pre_tokenizer"] or {}, state["model"]
        # The byte-level pattern ends a token before every space that follows a visible character, and merges stay within its tokens.
        plain = state["normalizer"] is None and not state["truncation"] and not state["padding"] and model["type"] == "BPE" and not model.get("dropout")
        self.additive = bool(plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.added = [t["content"] for t in state["added_tokens"]]
        self.known: dict[str, int] = {}
        self.around_own = len(self.library.encode("", add_special_tokens=True).ids) + around

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.library.encode(text, add_special_tokens=False).offsets

    def served(self, text: str) -> int:
        if self.adds_up(text):
            return self.around_own + self.weight(text)
        return len(self.library.encode(text, add_special_tokens=True).ids) + self.around

    def adds_up(self, text: str) -> bool:
        """Whether the tokens of the text are those of its parts, where it is cut before a single space between visible characters."""
        return self.additive and not any(t in text for t in self.added)

    def weight(self, text: str, behind: bool = False) -> int:
        """Tokens of a text that adds up, special ones left out; `behind`: as they are behind a space that counts as theirs. Each distinct word
        is encoded once until WORDS are known."""
        first, *words = [None, *CUT.split(text)] if behind else CUT.split(text)
        n = 0 if behind else self._encoded([first])[0]
        try:
            return n + sum(map(self.known.__getitem__, words))
        except KeyError:
            return n + self._learned(words)

    def _learned(self, words: list[str]) -> int:
        new = {w for w in words if w not in self.known}
        short = [w for w in new if len(w) <= WORD_LENGTH]
        if len(self.known) + len(short) > WORDS:
            self.known.clear()
            new = set(words)
        found = dict(zip(new, self._encoded([f" {w}" for w in new]), strict=True))
        n = sum(found[w] if w in found else self.known[w] for w in words)
        if len(found) <= WORDS:
            self.known.update((w, c) for w, c in found.items() if len(w) <= WORD_LENGTH)
        return n

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def json_tokenizer(path: str, around: int = 0) -> JsonTokenizer:
    return JsonTokenizer(path, around)


def served_tokens(text: Column, tokenizer: Callable[[], Tokenizer]) -> Column:
    """Tokens of each text, special ones included; null for null."""
    if tokenizer is None:
        raise ValueError("a tokenizer is needed; nothing stands in for it")

    @F.pandas_udf("long")
    def run(texts):
        own = tokenizer()
        return texts.map(lambda t: None if t is None else own.served(t)).astype("Int64")

    return run(text)

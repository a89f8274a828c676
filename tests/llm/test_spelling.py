"""Spelling variants against brute force: deletions by hash, near words, forms, roots; hot places, odd rows, empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import spelling


def brute(rows):
    count = Counter()
    for i, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in m)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)
    for a in count:
        for b in count:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
            if len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in count:
        if near[w] and count[f := min(near[w], key=lambda x: (-count[x], x))] >= 2 * count[w]:
            form[w] = f
    out = []
    for w, n in count.items():
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, n, len(near[w]), count[form[w]] if w in form else None))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, place int")
    return sorted((tuple(r) for r in spelling.variants(docs, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcéÀz") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    stems += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "bababab", "ABABABABA"]
    words = []
    for s in stems:
        k = rng.randrange(len(s))
        words += [s] * rng.choice([1, 3, 9, 40]) + [s[:k] + rng.choice("xé") + s[k:]] * 4 + [s[:k] + s[k + 1 :]] * 20 + [s[:k] + "Q" + s[k + 1 :]] * 3
    rng.shuffle(words)
    out = [(i, " ".join(words[k : k + 9])) for i, k in enumerate(range(0, len(words), 9))]
    long = "lorem" * 2000
    return [*out, *out[:20], (None, "NullID words words WORDS wordz"), (None, "wordz wordz"), (900, None), (901, ""), (902, " 12 \n"), (903, f"{long} {long} {long}x {long} {long}x {long}x é"), (904, "x" * 30000)]


@pytest.mark.parametrize("block", [2, 4096])
def test_against_brute_force(spark, rows, block):
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 30 and any(w[2] != w[1] and w[1] for w in want)
    assert run(spark, rows, block=block) == want


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "a b")]) == []


def test_prefix_is_met_by_every_near_word():
    rng = random.Random(3)
    order = defaultdict(lambda: rng.randrange(50))
    for _ in range(3000):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(5, 9)))
        k = rng.randrange(len(s))
        for t in (s[:k] + "c" + s[k + 1 :], s[:k] + "a" + s[k:]):
            for g in (*spelling.grams(s), *spelling.grams(t)):
                order[g]
            total = {g: i for i, g in enumerate(sorted(order, key=lambda g: (order[g], g)))}
            moves = (0,) if len(s) == len(t) else (0, 1)
            assert any((g, p + m) in spelling.prefix(t, total) for g, p in spelling.prefix(s, total) for m in moves)

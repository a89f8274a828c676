"""Alignment of two tokenizers against a two-pointer sweep over whole texts: odd texts, hot and other units, shuffled id pairs, empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import align
from corpusloom.llm.bpe import _bytes_of_symbols

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = _bytes_of_symbols()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def tokens(text):
    """(end, id) of the tokens of the whole text, or none if a side does not give its bytes back."""
    sides = [[(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(f" {text}", add_special_tokens=False).ids], []]
    for i in B.encode(text):
        p = B.id_to_piece(i)
        sides[1].append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    if not text or any(b"".join(x for _, x in s) != f" {text}".encode() for s in sides):
        return [], []
    out = []
    for s in sides:
        at = 0
        out.append([((at := at + len(x)), i) for i, x in s])
    return out


def brute(rows):
    found, count, best = [], Counter(), defaultdict(int)
    for doc, text in rows:
        a, b = tokens(text or "")
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i][1], b[j][1]))
            ends = a[i][0], b[j][0]
            i, j = i + (ends[0] <= ends[1]), j + (ends[1] <= ends[0])
        groups, ga, gb = [], defaultdict(list), defaultdict(list)
        cuts = sorted({e for e, _ in a} & {e for e, _ in b})
        for side, of in ((a, ga), (b, gb)):
            for e, x in side:
                of[next(c for c in cuts if c >= e)].append(str(x))
        groups = [",".join(ga[c]) + "|" + ",".join(gb[c]) for c in cuts]
        count.update(links)
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((d, a, b, g, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), s) for d, a, b, g, x, s in found), key=str)


def odd_texts():
    rng = random.Random(11)
    signs = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "a", "B's", "don't", "é", "ß", "😀", "中文", "12345", "=", "====", "<s>", "<|endoftext|>", "</s>", "\x00", "é", "العربية", ",", "…", "internationalization"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   "), (204, "a "), (205, "a▁ b"), (206, "▁"), (207, "x ▁ y"), (208, "=" * 700 + "-" * 701), (209, "aé" * 1500), (210, " ".join(["word"] * 9000)), (None, "null id"), (5, "repeat me"), (5, "repeat me")]
    return rows


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, unit string, n int")
    return sorted((tuple(r) for r in align.align(docs, **kw).select(*COLUMNS).collect()), key=str)


def test_against_a_sweep(spark):
    rows = odd_texts()
    want = brute(rows)
    assert sum(w[1] == 0 for w in want) == 5 and any(w[3] < w[1] for w in want)
    assert run(spark, rows) == want
    # Few hot units, small buckets, and id pairs that are shuffled but for hot ones.
    assert run(spark, rows, hot=5, bucket_bytes=2000, pairs_bound=0) == want


def test_unsafe_code_points():
    assert align.unsafe((public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))) == "▁"


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, sf):
    got = align.op11_tokenizer_alignment(spark, sf)
    assert got.columns == [*COLUMNS[:-1], "groups_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want), key=str)


def test_asked_units_are_shuffled_once(spark, monkeypatch):
    """Units that buckets of texts ask for meet the stored ones after one shuffle, and a bucket is put together slice by slice."""
    monkeypatch.setattr(align, "SLICE_BYTES", 300)
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with align._setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = align.align(docs, hot=5, bucket_bytes=2000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str) == brute(rows)
    assert plan.count("Exchange hashpartitioning(unit") == 1 and "SortMergeJoin [unit" in plan, plan


def test_units_are_split_and_counted_by_arrow(monkeypatch):
    """Only texts with a space that does not split, or with a doubtful character, go through Python one by one; units are the same."""
    import pyarrow as pa

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    of, plain, one_by_one = align.Texts(paths, "▁"), align.Texts(paths, "▁"), []
    monkeypatch.setattr(of, "units", lambda t: one_by_one.append(t) or plain.units(t))
    texts = [t for _, t in odd_texts()] + [f"a{c} b" for c in align.BLANK] + [f"word{i} other\nline" for i in range(500)]
    got = {}
    for rows, units, sizes in of.parts(pa.array(texts, pa.string())):
        flat = iter(units.to_pylist())
        got |= {r: [next(flat) for _ in range(n)] for r, n in zip(rows.tolist(), sizes.tolist(), strict=True)}
        assert next(flat, None) is None
    assert [got[r] for r in range(len(texts))] == [plain.units(t) for t in texts]
    assert len(one_by_one) < len(texts) - 500

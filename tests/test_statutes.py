"""Statutes: the line automaton against literal cases and a line-by-line walk; the budget by token ids; the way out by pages."""

import random
import re
from functools import partial

import public_tokenizers
import pytest

from corpusloom.functions.tokenizer import json_tokenizer, served_tokens
from corpusloom.operators import statutes as L
from corpusloom.plans.base import inline
from corpusloom.plans.fixtures import STATUTES

SCHEMA = "doc long, page_no long, text string, path string"


#: A model puts one special token before a text and one behind it.
tokenizer = partial(json_tokenizer, public_tokenizers.path("byte_bpe_50k.json"), 2)


@pytest.fixture(scope="module")
def chunks(spark):
    out = {}
    for r in L.statute_chunks(inline(spark, STATUTES)).orderBy("doc", "chunk").collect():
        out.setdefault(r.doc, []).append(r)
    return out


def test_act_over_two_pages(chunks):
    one, two = chunks[-1]
    assert (one.label, one.page_no, two.label, two.page_no) == ("Article 1", 1, "Article 2", 2)
    assert one.code == two.code == "قانون الالتزامات والعقود" and one.law_type == "dahir"
    assert one.law == "ظهير شريف رقم 1.11.151 صادر في 16 من رمضان 1432 (17 أغسطس 2011) بتنفيذ القانون رقم 36.21 المتعلق بالحالة المدنية"
    assert one.book == "الكتاب الأول: أحكام عامة" and one.part is None and two.part == "الباب الثاني: التسجيل"
    # The heading of the next item belongs to the text of this one, as a line, and to the next one's hierarchy.
    assert one.text == "المادة 1 - نطاق التطبيق\nتسري أحكام هذا القانون على جميع المغاربة.\nالباب الثاني: التسجيل"


def test_law_types_codes_and_items(chunks):
    assert [(c.law_type, c.page_no, c.label) for c in chunks[-2]] == [("decree", 3, "Article 1")]
    assert [(c.law_type, c.page_no, c.code) for c in chunks[-3]] == [("decision", 5, "المعاملات الإلكترونية")] * 2
    assert [(c.label, c.book, c.chapter) for c in chunks[-4]] == [("Fasl 1", "الكتاب الأول: الالتزامات", None), ("Fasl 2", "الكتاب الأول: الالتزامات", None)]
    assert -5 not in chunks
    assert [(c.label, c.page_no, c.code, c.law) for c in chunks[-6]] == [("section-p4", 4, L.DEFAULT_CODE, None)]


def test_headings_preamble_and_continuations(chunks):
    got = [(c.label, c.page_no, c.book, c.part, c.chapter) for c in chunks[-7]]
    assert got == [
        ("preamble", 1, None, "Titre II", None), ("Article 1", 1, None, "Titre II", None), ("Article 2", 2, None, "Titre III", "الفصل الأول"),
        ("Fasl 3", 2, None, "Titre III", "الفصل الأول"), ("Fasl 5", 2, None, "Titre III", "الفصل الأول"), ("Fasl 7", 2, "الكتاب الثاني", None, None),
    ]
    assert chunks[-7][0].text == "Préambule du texte" and chunks[-7][1].text == "Article 1\nPremier corps.\nsuite\nTitre III\nالفصل الأول"
    # Blank lines do not end a run of continuations; a line before the header is the preamble; later continuation lines are text.
    assert [(c.label, c.law, c.text) for c in chunks[-8]] == [("preamble", "قانون رقم 1 المتعلق بكذا بشأن كذا", "Avant"), ("Article 9", "قانون رقم 1 المتعلق بكذا بشأن كذا", "المادة 9\nنص\nالصادر بعد ذلك")]
    # An item before any header: there is no law.
    assert [(c.law, c.law_type) for c in chunks[-9]] == [(None, None)]
    assert [(c.label, c.law, c.text) for c in chunks[-10]] == [("preamble", "دستور المتعلق بكذا", "حاشية\nالمتعلق بغيره"), ("Article 1", "دستور المتعلق بكذا", "المادة 1")]


def walk(pages):
    """The rules line by line, over (page_no, text)."""
    lines = [(n, x) for n, t in pages if t and t.strip() for x in t.splitlines()]
    label = lambda x: (m := re.match(r"\s*Article\s+(\d+)", x)) and f"Article {m[1]}"
    kinds = [("book", r"\s*الكتاب\s+.+"), ("part", r"\s*Titre\s+.+"), ("chapter", r"\s*الفصل\s+.+")]
    head = lambda x: re.match(r"\s*قانون\b", x)
    law, extra, state = None, set(), "seek"
    for i, (_, x) in enumerate(lines):
        if not x.strip():
            continue
        if state == "seek" and head(x):
            law, state = x.strip(), "more"
            extra.add(i)
        elif state == "seek" and label(x):
            break
        elif state == "more":
            if label(x) or any(re.match(p, x) for _, p in kinds) or not re.match(r"\s*المتعلق\b", x):
                break
            law = f"{law} {x.strip()}"
            extra.add(i)
    now, items = {}, []
    for i, (n, x) in enumerate(lines):
        if label(x):
            items.append((i, n, label(x), dict(now)))
        elif kind := next((k for k, p in kinds if re.match(p, x)), None):
            now[kind] = x.strip()
            for k in {"book": ["part", "chapter"], "part": ["chapter"], "chapter": []}[kind]:
                now.pop(k, None)
    if not items:
        return [(f"section-p{n}", n, None, None, None, None, t.strip()) for n, t in pages if t and t.strip()]
    out = []
    first = items[0]
    before = "\n".join(x for i, (_, x) in enumerate(lines[: first[0]]) if x.strip() and i not in extra and not head(x) and not any(re.match(p, x) for _, p in kinds)).strip()
    if before:
        out.append(("preamble", first[1], law, *(first[3].get(k) for k, _ in kinds), before))
    for (i, n, name, at), after in zip(items, [*(x[0] for x in items[1:]), len(lines)], strict=True):
        out.append((name, n, law, *(at.get(k) for k, _ in kinds), "\n".join(x for _, x in lines[i:after]).strip()))
    return out


def test_against_a_walk(spark):
    rng = random.Random(9)
    kinds = ["Article 4", " Article 12 x", "قانون رقم 3", "المتعلق بكذا", "الكتاب الأول", "Titre II", "الفصل الثاني", "", "  ", "some text.", "more", "Articles"]
    docs = {d: [(p, rng.choice(["\n", "\r\n"]).join(rng.choice(kinds) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n", "\n\n"])) for p in range(1, rng.randint(2, 5))] for d in range(150)}
    docs[150] = [(1, None), (2, "Article 1"), (3, "\n")]
    rows = [(d, p, t, None) for d, pages in docs.items() for p, t in pages]
    got = {}
    for r in L.statute_chunks(spark.createDataFrame(rows, SCHEMA)).orderBy("doc", "chunk").collect():
        got.setdefault(r.doc, []).append((r.label, r.page_no, r.law, r.book, r.part, r.chapter, r.text))
    for d, pages in docs.items():
        assert got.get(d, []) == walk(pages), d


# ---- the budget


def pieces(spark, rows, **kw):
    return L.statute_pieces(spark.createDataFrame(rows, SCHEMA), tokenizer, **kw).orderBy("doc", "chunk", "piece").collect()


def test_long_article_is_cut_with_links(spark):
    sentences = [f"الطرف {i} يتمتع بالحقوق المقررة له بموجب المادة {i} من هذا القانون." for i in range(1, 121)]
    got = pieces(spark, [(1, 1, "ظهير شريف بتنفيذ القانون\nالمادة 7 - المسؤولية\n" + " ".join(sentences), None)])
    own = tokenizer()
    assert len(got) > 5 and all(r.token_count == own.served(r.text) + 4 * r.text.count("\n") <= 450 and r.error is None and r.way == "articles" for r in got)
    assert all(r.label.startswith("Article 7 · part ") for r in got) and [r.continued_from for r in got] == [None, *(r.label for r in got[:-1])]
    for a, b in zip(got, got[1:], strict=False):
        assert a.text not in b.text and b.text not in a.text
        tail = own.spans(a.text)
        lead = a.text[tail[-64][0] :].strip()
        # The end of the piece before leads where it still fits.
        assert b.text.startswith(lead) or own.served(f"{lead} {b.text}") > 450
    assert all(any(s in r.text for r in got) for s in sentences)


def test_sentence_beyond_the_budget(spark):
    """It is cut by ids into runs that fit and give the whole text back; a run of one character has no cuts but those of its tokens."""
    for text in ("كلمة " * 3000, "é" * 4000, "a" * 9000, "x" + "😀" * 900):
        got = L.Budget(tokenizer()).split(text.strip())
        assert all(L.Budget(tokenizer()).fits(p) for p in got) and "�" not in "".join(got)
        begin, at = 0, "".join(text.split())
        for p in L.Budget(tokenizer()).windows(text.strip()):
            piece = "".join(p.split())
            assert at[begin : begin + len(piece)] == piece
            begin += len(piece)
        assert begin == len(at)
    led = L.Budget(tokenizer(), 30, 4).split("One two three four five six seven eight nine ten eleven twelve. " + "A b c d e f g h i j k l m n o p q r s. " + "x y z.")
    assert led == ["One two three four five six seven eight nine ten eleven twelve.", "ten eleven twelve. A b c d e f g h i j k l m n o p q r s. x y z."]
    words = L.Budget(tokenizer(), 40, 8).split("Short one. " + "word " * 100 + ". Last one here.")
    assert words[0] == "Short one." and words[-1].endswith("Last one here.")


def test_way_out_by_pages(spark):
    """Where a piece cannot fit, the whole document goes by pages; what does not fit there keeps its row and an error."""
    rows = [(1, 1, "Article 1\nfine", None), (1, 2, "Titre I\nfine z", None), (2, 1, "Article 1\nfine", None)]

    class Heavy:
        def spans(self, text):
            return [(i, i + 1) for i in range(len(text))]

        def served(self, text):
            return 1000 if "z" in text else len(text)

    got = L.statute_pieces(spark.createDataFrame(rows, SCHEMA), Heavy, tokens=60).orderBy("doc", "chunk", "piece").collect()
    assert [(r.doc, r.label, r.way, r.error) for r in got if r.doc == 2] == [(2, "Article 1", "articles", None)]
    first = [r for r in got if r.doc == 1]
    assert {r.way for r in first} == {"pages"} and first[0].label == "section-p1" and first[1].label.startswith("section-p2") and any(r.error == "exceeds the served budget: 1000 tokens" for r in first) and first[0].law_type is None
    with pytest.raises(ValueError):
        L.statute_pieces(spark.createDataFrame(rows, SCHEMA), None)


def test_empty_and_null(spark):
    assert pieces(spark, []) == [] and pieces(spark, [(1, 1, None, None), (2, 1, " \n", "x")]) == []
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "t string")
    assert [r[0] for r in df.select(served_tokens(df.t, tokenizer)).collect()] == [None, 2, 4]


class Counted:
    """The public tokenizer, with the characters that it is asked to encode; `sums` off: every candidate is encoded."""

    def __init__(self, sums):
        self.own, self.asked, self.around_own = json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), 2), 0, 2
        self.own.known.clear()
        library = self.own.library
        outer = self

        class Library:
            def encode(self, text, **kw):
                outer.asked += len(text)
                return library.encode(text, **kw)

            def encode_batch_fast(self, texts, **kw):
                outer.asked += sum(map(len, texts))
                return library.encode_batch_fast(texts, **kw)

        self.inner = object.__new__(type(self.own))
        self.inner.__dict__ |= self.own.__dict__ | {"library": Library(), "known": {}}
        self.sums = sums

    def spans(self, text):
        return self.inner.spans(text)

    def served(self, text):
        return self.inner.served(text) if self.sums else len(self.inner.library.encode(text).ids) + 2

    def adds_up(self, text):
        return self.sums and self.inner.adds_up(text)

    def weight(self, text, behind=False):
        return self.inner.weight(text, behind)


def test_every_word_is_measured_once():
    """By sums the same pieces, odd texts included; an article is not encoded anew for every sentence that may join a piece."""
    rng = random.Random(4)
    bits = ["a" * 700, "كلمة " * 90, "x.  y! z?\n\nq", "don't 's. 're  ok.", "　wide. em. \x1cfs. ", "<|endoftext|> s. ", "😀" * 90, ". . . . ", "1234567890" * 30, "  two  spaces.   three ", "قانون رقم 1. "]
    for k in range(120):
        text = "".join(rng.choice(bits) + "word " * rng.randrange(12) for _ in range(rng.randrange(1, 14))).strip()
        budget = {"tokens": rng.choice([30, 60, 450]), "overlap": rng.choice([0, 4, 9])}
        assert L.Budget(Counted(True), **budget).split(text) == L.Budget(Counted(False), **budget).split(text), k
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    text = " ".join(" ".join(rng.choices(words, k=9)) + "." for _ in range(900))
    few, many = Counted(True), Counted(False)
    assert L.Budget(few).split(text) == L.Budget(many).split(text)
    assert few.asked < 2 * len(text) < 10 * len(text) < many.asked


def test_served_counts_of_known_words(monkeypatch):
    own, texts = tokenizer(), ["", " ", "a b", "a  b", " a b ", "it's 's x", "<|endoftext|> a", "\x1c a \x85b c", "word " * 50, "x" * 200 + " y", "é ü 中 文 😀 😀"]
    for limit in (200_000, 3):
        monkeypatch.setattr("corpusloom.functions.tokenizer.WORDS", limit)
        assert [own.served(t) for t in texts * 2] == [len(own.library.encode(t).ids) + 2 for t in texts * 2]
        assert own.served(texts[8]) and (limit > 3 or len(own.known) <= 3 or own.known.clear() is None)


def test_lines_are_made_once(spark):
    """The aggregates over lines read them as they were written; none splits the pages anew."""
    plan = L.statute_chunks(spark.createDataFrame([(1, 1, "Article 1\nfine", None)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan

"""Statutes as articles: a two-pass line automaton in windows, articles cut to the served budget by token ids, a page-wise way out.

pages (doc, page_no, text, path) -> chunks. The first pass finds the law's header and the lines that continue it; the second cuts at
items and keeps the headings in force at each. Every step is a window or an aggregate keyed by document, so a document's lines
are sorted once; only the cut to the budget, which asks a tokenizer, goes through Arrow, article by article.

Defined results: null and blank pages are no pages; a document without any gives no row; a null path has the default code; rows
repeated are pages repeated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokenizer import Tokenizer
from . import relational as R

#: The codes of folders, and the law types of header words.
FOLDER_CODES = {
    "المادة الأسرية": "مدونة الأسرة",
    "المادة التجارية": "القانون التجاري",
    "المادة الجنائية": "القانون الجنائي",
    "المادة المدنية": "قانون الالتزامات والعقود",
    "مادة التأمين و التقاعد": "التأمين والتقاعد",
    "مادة الحقوق والحريات": "الحقوق والحريات",
    "مادة المعاملات الالكترونية": "المعاملات الإلكترونية",
    "مادة الوظيفة العمومية": "الوظيفة العمومية",
}
DEFAULT_CODE = "Code du Travail"
LAW_TYPES = {
    "ظهير شريف": "dahir", "ظهير": "dahir", "مرسوم بقانون": "decree-law", "مرسوم": "decree", "قرار مشترك": "decision", "قرار": "decision",
    "القانون التنظيمي": "organic-law", "القانون": "law", "قانون": "law", "الدستور": "constitution", "دستور": "constitution",
}
#: Patterns of items, headers, lines that continue a header, headings, and sentence ends.
ARTICLE = r"(?iuU)^\s*(?:المادة|Article)\s+([0-9٠-٩]+)"
FASL = r"(?U)^\s*الفصل\s+([0-9٠-٩]+)(?![\p{L}\p{N}_])"
FASL_REVERSED = r"(?U)^\s*([0-9٠-٩]+)\s+الفصل(?![\p{L}\p{N}_])"
HEADER = r"(?U)^\s*(القانون التنظيمي|الدستور|دستور|ظهير شريف|مرسوم بقانون|قرار مشترك|ظهير|مرسوم|قرار|القانون|قانون)(?![\p{L}\p{N}_])"
CONTINUATION = r"(?U)^\s*(بتنفيذ|بتطبيق|بتحديد|بشأن|المتعلق|بتتميم|بتغيير|القاضي|الصادر)(?![\p{L}\p{N}_])"
HEADINGS = {"book": r"(?iuU)^\s*(?:الكتاب| Livre)\s+(.+)$", "part": r"(?iuU)^\s*(?:الباب| Partie|Titre)\s+(.+)$", "chapter": r"(?iuU)^\s*(?:الفصل| Chapitre)\s+(.+)$"}
SENTENCE_END = r"(?<=[.!؟?])\s+|\n+"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LAW_SIZE, OVERLAP = 300, 64
HIERARCHY = ["code", "law_type", "law", "book", "part", "chapter"]
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def _blank(c: Column) -> Column:
    return F.length(_strip(c)) == 0


def _one_of(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def law_type_for(head: Column) -> Column:
    return _one_of(head, LAW_TYPES)


def code_for(path: Column) -> Column:
    """The code of the folder that holds the file."""
    return F.coalesce(_one_of(F.regexp_extract(path, r"([^/]+)/+[^/]*$", 1), FOLDER_CODES), F.lit(DEFAULT_CODE))


def item_label(line: Column) -> Column:
    number = lambda p: F.nullif(F.translate(F.regexp_extract(line, p, 1), "٠١٢٣٤٥٦٧٨٩", "0123456789"), F.lit(""))
    return F.coalesce(F.concat(F.lit("Article "), number(ARTICLE)), F.concat(F.lit("Fasl "), F.coalesce(number(FASL), number(FASL_REVERSED))))


def _lines(pages: DataFrame) -> DataFrame:
    """doc, at (page and line in order), page_no, line: blank pages go, and what follows a page's last line end."""
    rows = pages.where(F.col("text").isNotNull() & ~_blank(F.col("text")))
    parts = F.split(F.regexp_replace("text", rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS, -1)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page_no", "text"))
    rows = rows.withColumn("_page", place).select("doc", "_page", "page_no", F.posexplode(parts).alias("_k", "line"))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("_page", "_k")).cast("long"))


def line_states(pages: DataFrame) -> DataFrame:
    """Every line with its part in the automaton: label (of an item), role (header, continuation, heading, blank, item or body), law and
    law_type of the document, and the headings in force."""
    rows = _lines(pages)
    line = F.col("line")
    found = {c: F.when(line.rlike(p), F.substring(_strip(line), 1, LAW_SIZE)) for c, p in HEADINGS.items()}
    any_heading = line.rlike(HEADINGS["book"]) | line.rlike(HEADINGS["part"]) | line.rlike(HEADINGS["chapter"])
    rows = rows.withColumns({"label": item_label(line), "_blank": _blank(line), "_head": F.nullif(F.regexp_extract(line, HEADER, 1), F.lit("")), "_heading": any_heading})
    free = ~F.col("_blank") & F.col("label").isNull()
    whole = Window.partitionBy("doc")
    # First pass: the first line that is a header, unless an item comes before it; then the unbroken run of continuations.
    opens = F.min(F.when(~F.col("_blank") & (F.col("_head").isNotNull() | F.col("label").isNotNull()), F.struct("at", F.col("_head").alias("head")))).over(whole)
    rows = rows.withColumn("_open", opens)
    rows = rows.withColumn("_from", F.when(F.col("_open.head").isNotNull(), F.col("_open.at")))
    goes_on = F.col("label").isNull() & ~F.col("_heading") & line.rlike(CONTINUATION)
    rows = rows.withColumn("_until", F.min(F.when((F.col("at") > F.col("_from")) & ~F.col("_blank") & ~goes_on, F.col("at"))).over(whole))
    extra = (F.col("at") > F.col("_from")) & ~F.col("_blank") & (F.col("_until").isNull() | (F.col("at") < F.col("_until")))
    rows = rows.withColumn("_extra", F.coalesce(extra, F.lit(False)))
    # Second pass: headings by position; of several patterns the first counts, and a numbered chapter is none.
    level, first = {}, free
    for name in HEADINGS:
        hit = first & found[name].isNotNull()
        level[name] = F.when(hit & ~line.rlike(r"(?iuU)^\s*(?:الفصل| Chapitre)\s+\s*[0-9٠-٩]") if name == "chapter" else hit, found[name])
        first = first & found[name].isNull()
    rows = rows.withColumns(level)
    rows = R.headings_in_force(rows, "doc", "at", keep=[c for c in rows.columns if c not in ("doc", "at")])
    role = (
        F.when(F.col("_blank"), "blank").when(F.col("label").isNotNull(), "item").when(F.col("_extra"), "continuation")
        .when(F.col("_head").isNotNull(), "header").when(F.col("_heading"), "heading").otherwise("body")
    )
    return rows.select(
        "doc", "at", "_page", "page_no", "line", "label", role.alias("role"), ((F.col("at") == F.col("_from")) | F.col("_extra")).alias("of_law"), F.col("_open.head").alias("head"),
        F.col("in_book").alias("book"), F.col("in_part").alias("part"), F.col("in_chapter").alias("chapter"),
    )


def _joined(keep: Column | None = None) -> Column:
    """The lines of a group in order, stripped as one text."""
    row = F.struct("at", "line")
    return _strip(F.array_join(F.transform(F.array_sort(F.collect_list(row if keep is None else F.when(keep, row))), lambda x: x["line"]), "\n"))


def statute_chunks(pages: DataFrame, normalize: bool = True) -> DataFrame:
    """doc, chunk (from 0), label, page_no, code, law_type, law, book, part, chapter, text of the articles of every document, its preamble
    first; of a document without items, of its pages."""
    if normalize:
        pages = R.durable(pages.withColumn("text", T.nfkc(F.col("text"))))
    paths = pages.groupBy("doc").agg(F.min("path").alias("path"))
    rows = line_states(pages)
    w = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # Five aggregates read the lines' states: they are made once.
    rows = R.durable(rows.withColumn("item", F.count("label").over(w)).withColumn("_items", F.count("label").over(Window.partitionBy("doc"))))
    law = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("of_law"), F.struct("at", "line")))), lambda x: _strip(x["line"])), " "), 1, LAW_SIZE)
    laws = rows.groupBy("doc").agg(law.alias("law"), law_type_for(F.max("head")).alias("law_type"))
    body = rows.where("item > 0").groupBy("doc", "item").agg(F.min_by("label", "at").alias("label"), F.min_by("page_no", "at").alias("page_no"), *[F.min_by(c, "at").alias(c) for c in HEADINGS], _joined().alias("text"))
    # The preamble has the page and the headings of the first item.
    start = body.where("item = 1").select("doc", "page_no", *HEADINGS)
    before = rows.where("_items > 0 and item = 0 and role = 'body'").groupBy("doc").agg(_joined().alias("text")).where("length(text) > 0")
    preamble = before.join(start, "doc").select("doc", F.lit(0).cast("long").alias("item"), F.lit("preamble").alias("label"), "page_no", *HEADINGS, "text")
    # A document without items gives its pages as they are.
    bare = rows.groupBy("doc").agg(F.count("label").alias("n")).where("n = 0")
    plain = page_chunks(pages, False).join(bare, "doc", "left_semi").select("doc", F.col("chunk").alias("item"), "label", "page_no", *HEADINGS, "text")
    chunks = body.unionByName(preamble).withColumn("_law", F.lit(True)).unionByName(plain.withColumn("_law", F.lit(False)))
    out = chunks.where("length(text) > 0").join(laws, "doc").join(paths, "doc")
    law_of = F.when(F.col("_law") & (F.length("law") > 0), F.col("law"))
    order = Window.partitionBy("doc").orderBy("item")
    return out.select("doc", (F.row_number().over(order) - 1).cast("long").alias("chunk"), "label", "page_no", code_for(F.col("path")).alias("code"), "law_type", law_of.alias("law"), *HEADINGS, "text")


def page_chunks(pages: DataFrame, normalize: bool = True) -> DataFrame:
    """The way out: every page that is not blank as one chunk, known by its number, with the code alone."""
    if normalize:
        pages = pages.withColumn("text", T.nfkc(F.col("text")))
    rows = pages.where(F.col("text").isNotNull() & ~_blank(F.col("text")))
    order = Window.partitionBy("doc").orderBy("page_no", "text")
    none = [F.lit(None).cast("string").alias(c) for c in HIERARCHY[1:]]
    return rows.select("doc", (F.row_number().over(order) - 1).cast("long").alias("chunk"), F.concat(F.lit("section-p"), F.col("page_no").cast("string")).alias("label"), "page_no", code_for(F.col("path")).alias("code"), *none, _strip(F.col("text")).alias("text"))


#: Characters of a text's beginning and end that are looked at before the whole.
_AHEAD = 8


@dataclass
class Budget:
    """Cuts one text into pieces that a model can be served. Pieces are slices of the text and of its sentences: ids are only measured,
    so no character is altered, and a cut never falls inside one.

    Where a tokenizer's counts add up over words (`adds_up`), every sentence is measured once, and sums are compared with the budget; other
    tokenizers are asked for each candidate."""

    tokenizer: Tokenizer
    tokens: int = T.SERVED_TOKENS
    overlap: int = OVERLAP
    _last: tuple[str, int] | None = None

    def estimate(self, text: str) -> int:
        if self._last is None or self._last[0] != text:
            self._last = text, self.tokenizer.served(text) + T.NEWLINE_WEIGHT * text.count("\n")
        return self._last[1]

    def fits(self, text: str) -> bool:
        return self.estimate(text) <= self.tokens

    def _sums(self, text: str) -> bool:
        return getattr(self.tokenizer, "adds_up", lambda t: False)(text)

    def _long(self, text: str) -> bool:
        """Whether the beginning of the text, up to a cut that adds up, is beyond the budget already; the text adds up."""
        head = text[: self.tokens * _AHEAD]
        cut = _last_cut(head) if len(head) < len(text) else 0
        return cut > 0 and not self.fits(head[:cut])

    def tail(self, text: str) -> str:
        """The last `overlap` tokens of a text."""
        if self.overlap and self._sums(text):
            size = self.overlap * _AHEAD
            while size < len(text):
                cut = _first_cut(text, len(text) - size)
                spans = self.tokenizer.spans(text[cut:]) if cut > 0 else []
                if len(spans) >= self.overlap:
                    return text[cut + spans[-self.overlap][0] :].strip()
                size *= 4
        spans = self.tokenizer.spans(text)
        return text[spans[-self.overlap :][0][0] :].strip() if spans and self.overlap else ""

    def windows(self, text: str) -> Iterator[str]:
        """A text without sentence ends, as the longest runs of tokens that fit."""
        spans = self.tokenizer.spans(text)
        # Where a token starts a character of its own; characters of several tokens are not divided.
        cuts = sorted({a for a, _ in spans[1:] if a} | {len(text)})
        begin = at = 0
        guess = None
        while at < len(cuts):
            low, high = at, min(at + self.tokens, len(cuts)) - 1
            if guess is not None:  # a run is mostly as long as the one before
                near = min(at + guess, high)
                if near > low and self.fits(text[begin : cuts[near]]):
                    low = near
                    if low < high and not self.fits(text[begin : cuts[low + 1]]):
                        high = low
                elif near > low:
                    high = near - 1
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self.fits(text[begin : cuts[middle]]) else (low, middle - 1)
            if piece := text[begin : cuts[low]].strip():
                yield piece
            guess = low - at
            begin, at = cuts[low], low + 1

    def packed(self, text: str, lead: str = "") -> list[str]:
        """Sentences joined while they fit; the lead opens the first piece of whole sentences, if it fits there, and is never alone."""
        sentences = list(filter(None, map(str.strip, re.split(SENTENCE_END, text))))
        if self._sums(text) and self._sums(lead):
            return self._packed(sentences, lead)
        out: list[str] = []
        held = ""

        def close() -> None:
            nonlocal held, lead
            if held:
                led = f"{lead} {held}" if lead else held
                out.append(led if self.fits(led) else held)
                held = lead = ""

        for sentence in sentences:
            if not self.fits(sentence):
                close()
                out += list(self.windows(sentence)) or [sentence]
            elif held and not self.fits(f"{held} {sentence}"):
                close()
                held = sentence
            else:
                held = f"{held} {sentence}" if held else sentence
        close()
        return out

    def _packed(self, sentences: list[str], lead: str) -> list[str]:
        """packed, by sums. Sentences hold no line feed; a lead may."""
        alone, behind = self.tokenizer.weight, [self.tokenizer.weight(x, True) for x in sentences]
        out: list[str] = []
        room, weight = self.tokens - self.tokenizer.around_own, 0
        led = self.estimate(lead) - self.tokenizer.around_own if lead else 0
        held: list[int] = []

        def close() -> None:
            nonlocal held, lead
            if held:
                body = " ".join(sentences[i] for i in held)
                out.append(f"{lead} {body}" if lead and led + weight - alone(sentences[held[0]]) + behind[held[0]] <= room else body)
                held, lead = [], ""

        for i, sentence in enumerate(sentences):
            if len(sentence) * 4 > room and alone(sentence) > room:  # a character has at most four tokens
                close()
                out += list(self.windows(sentence)) or [sentence]
            elif held and weight + behind[i] > room:
                close()
                held, weight = [i], alone(sentence)
            else:
                weight = weight + behind[i] if held else alone(sentence)
                held.append(i)
        close()
        return out

    def split(self, text: str) -> list[str]:
        """One piece if it fits; else pieces of which each opens with the end of the one before, packed anew with it."""
        if not (self._sums(text) and self._long(text)) and self.fits(text):
            return [text]
        first, *rest = self.packed(text) or [text]
        out = [first]
        for piece in rest:
            lead = self.tail(out[-1])
            out += self.packed(piece, lead) if lead and lead not in piece else [piece]
        return out


def _cuts_at(text: str, i: int) -> bool:
    return text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()


def _last_cut(text: str) -> int:
    """The last single space between visible characters, or 0."""
    return next((i for i in range(len(text) - 2, 0, -1) if _cuts_at(text, i)), 0)


def _first_cut(text: str, begin: int) -> int:
    """The first such space from `begin`, or 0."""
    return next((i for i in range(max(begin, 1), len(text) - 1) if _cuts_at(text, i)), 0)


def _cut(chunks: DataFrame, tokenizer: Callable[[], Tokenizer], tokens: int, overlap: int) -> DataFrame:
    columns = ["doc", "chunk", "page_no", *HIERARCHY]

    def run(batches: Iterator[pa.RecordBatch]):
        budget = Budget(tokenizer(), tokens, overlap)
        for batch in batches:
            of, rows = [], []
            for k, (label, text) in enumerate(zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                pieces = budget.split(text)
                names = [label] if len(pieces) == 1 else [f"{label} · part {i}/{len(pieces)}" for i in range(1, len(pieces) + 1)]
                of += [k] * len(pieces)
                rows += zip(range(len(pieces)), names, [None, *names[:-1]], pieces, map(budget.estimate, pieces), strict=True)
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)] if rows else []
            if made:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of, pa.int64())) for c in columns), *made], [*columns, "piece", "label", "continued_from", "text", "token_count"])

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in columns)
    return chunks.select(*columns, "label", "text").mapInArrow(run, f"{kinds}, piece int, label string, continued_from string, text string, token_count bigint")


def statute_pieces(pages: DataFrame, tokenizer: Callable[[], Tokenizer], tokens: int = T.SERVED_TOKENS, overlap: int = OVERLAP, normalize: bool = True) -> DataFrame:
    """The chunks of statute_chunks cut to the budget: doc, chunk, piece, label, continued_from, page_no, hierarchy, text, token_count, way
    (articles or pages), error. A document of which a piece does not fit is cut by pages instead; a piece that does not fit there either
    keeps its row, with an error."""
    if tokenizer is None:
        raise ValueError("a tokenizer is needed; nothing stands in for it")
    if normalize:
        pages = R.durable(pages.withColumn("text", T.nfkc(F.col("text"))))
    # Both ways read what was cut: it is cut once.
    made = R.durable(_cut(statute_chunks(pages, False), tokenizer, tokens, overlap)).withColumn("_over", F.max(F.col("token_count") > tokens).over(Window.partitionBy("doc")))
    over = made.where("_over").select("doc").distinct()
    other = _cut(page_chunks(pages.join(over, "doc", "left_semi"), False), tokenizer, tokens, overlap)
    both = made.where("not _over").drop("_over").withColumn("way", F.lit("articles")).unionByName(other.withColumn("way", F.lit("pages")))
    return both.withColumn("error", F.when(F.col("token_count") > tokens, F.concat(F.lit("exceeds the served budget: "), F.col("token_count").cast("string"), F.lit(" tokens"))))

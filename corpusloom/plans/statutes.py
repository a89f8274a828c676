"""Queries of the statute splitter, over statutes that documents are cut into by a stated rule, beside literal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizer import json_tokenizer, served_tokens
from ..operators import relational as R
from ..operators import statutes as L
from .base import inline, query, read
from .fixtures import STATUTES

#: The rule: a text's sentences are lines; twelve are a page; some lines get headers, headings and item marks before them, by their number.
_SENTENCE, _PAGE = ". ", 12
_MARKS = """concat(
    case when j = 0 and n_chars % 3 = 0 then concat('قانون رقم ', doc_id, '\n') else '' end,
    case when j = 0 and n_chars % 2 = 0 then 'المتعلق بالنشر\n' else '' end,
    case when j % 30 = 7 then concat('الكتاب ', j, '\n') else '' end,
    case when j % 15 = 0 then concat('Titre ', j, '\n') else '' end,
    case when j % 9 = 4 then concat('الفصل ', case when j % 2 = 0 then 'العام' else 'الأول' end, '\n') else '' end,
    case when j % 5 = 2 and n_chars % 7 > 0 then concat(case when j % 2 = 0 then 'Article ' else 'المادة ' end, j, '\n') else '' end, s)"""
_PATH = "case when n_chars % 2 = 0 then concat('/x/المادة المدنية/', doc_id, '.pdf') else concat('/x/', source, '/y.pdf') end"


def statutes_of(docs: DataFrame) -> DataFrame:
    """doc, page_no, text, path."""
    rows = docs.select("doc_id", "n_chars", "source", F.posexplode(F.split("text", r"\. ", -1)).alias("j", "s"))
    rows = rows.select(F.col("doc_id").alias("doc"), (F.floor(F.col("j") / _PAGE) + 1).cast("long").alias("page_no"), "j", F.expr(_MARKS).alias("line"), F.expr(_PATH).alias("path"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda x: x.line), "\n")
    return rows.groupBy("doc", "page_no", "path").agg(text.alias("text")).select("doc", "page_no", "text", "path")


def _pages(spark, sf_dir) -> DataFrame:
    return statutes_of(read(spark, sf_dir, "documents")).unionByName(inline(spark, STATUTES))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_W = "(partition by doc order by pos rows between unbounded preceding and current row)"
_LEVEL = {"book": r"^\s*(الكتاب| livre)\s+.+$", "part": r"^\s*(الباب| partie|titre)\s+.+$", "chapter": r"^\s*(الفصل| chapitre)\s+.+$"}
_IS = {k: f"regexp_matches(line, '{v}', 'i')" for k, v in _LEVEL.items()}
_ANY = " or ".join(_IS.values())
_HEAD = "regexp_extract(line, '^\\s*(القانون التنظيمي|الدستور|دستور|ظهير شريف|مرسوم بقانون|قرار مشترك|ظهير|مرسوم|قرار|القانون|قانون)([^\\p{L}\\p{N}_]|$)', 1)"
_CONT = "regexp_matches(line, '^\\s*(بتنفيذ|بتطبيق|بتحديد|بشأن|المتعلق|بتتميم|بتغيير|القاضي|الصادر)([^\\p{L}\\p{N}_]|$)')"
_NUM = "translate(regexp_extract(line, '{0}', 1), '٠١٢٣٤٥٦٧٨٩', '0123456789')"
_LABEL = "case {} end".format(
    " ".join(
        f"when regexp_matches(line, '{p}') then '{kind} ' || {_NUM.format(p)}"
        for kind, p in (("Article", r"(?i)^\s*(?:المادة|Article)\s+([0-9٠-٩]+)"), ("Fasl", r"^\s*الفصل\s+([0-9٠-٩]+)(?:[^\p{L}\p{N}_]|$)"), ("Fasl", r"^\s*([0-9٠-٩]+)\s+الفصل(?:[^\p{L}\p{N}_]|$)"))
    )
)
_TYPES = "case head " + " ".join(f"when '{k}' then '{v}'" for k, v in L.LAW_TYPES.items()) + " end"
_CODE = "coalesce(case regexp_extract(path, '([^/]+)/+[^/]*$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in L.FOLDER_CODES.items()) + f" end, '{L.DEFAULT_CODE}')"
_STATUTES_SQL = f"""
with s as (select doc_id, n_chars, source, unnest(string_split(text, '{_SENTENCE}')) as s, unnest(range(len(string_split(text, '{_SENTENCE}')))) as j from documents),
p as (select doc_id as doc, j // {_PAGE} + 1 as page_no, string_agg({_MARKS}, chr(10) order by j) as text, any_value({_PATH}) as path from s group by 1, 2
    union all select doc, page_no, text, path from {STATUTES.sql}),
q as (select *, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as ls from p where {_STRIP.format("text")} <> ''),
l as (select doc, page_no, path, line, k, row_number() over (partition by doc order by page_no, k) as pos from (select doc, page_no, path, unnest(ls) as line, unnest(range(len(ls))) as k from q)),
a as (select *, {_STRIP.format("line")} as bare, {_LABEL} as label, nullif({_HEAD}, '') as head, ({_ANY}) as heading from l),
b as (select *, min(pos) filter (bare <> '' and (head is not null or label is not null)) over (partition by doc) as first from a),
c as (select *, max(case when pos = first then head end) over (partition by doc) as law_head from b),
d as (select *, min(pos) filter (law_head is not null and pos > first and bare <> '' and not (label is null and not heading and {_CONT})) over (partition by doc) as stop from c),
e as (select *, law_head is not null and bare <> '' and pos >= first and (pos = first or stop is null or pos < stop) as of_law, bare <> '' and label is null as free from d),
f as (select *, case when free and {_IS["book"]} then bare[1:300] end as book, case when free and not {_IS["book"]} and {_IS["part"]} then bare[1:300] end as part,
    case when free and not {_IS["book"]} and not {_IS["part"]} and {_IS["chapter"]} and not regexp_matches(line, '(?i)^\\s*(الفصل| chapitre)\\s+[0-9٠-٩]') then bare[1:300] end as chapter from e),
g as (select *, last_value(book ignore nulls) over {_W} as vb, last_value(part ignore nulls) over {_W} as vp, last_value(chapter ignore nulls) over {_W} as vc,
    coalesce(max(case when book is not null then pos end) over {_W}, -1) as ab, coalesce(max(case when part is not null then pos end) over {_W}, -1) as ap, coalesce(max(case when chapter is not null then pos end) over {_W}, -1) as ac,
    count(label) over {_W} as item, count(label) over (partition by doc) as items from f),
h as (select *, vb as in_book, case when ap >= ab then vp end as in_part, case when ac >= ab and ac >= ap then vc end as in_chapter from g),
w as (select doc, any_value(path) as path, string_agg(bare, ' ' order by pos) filter (of_law) as law, any_value(law_head) as head from h group by 1),
i as (select doc, item, arg_min(label, pos) as label, arg_min(page_no, pos) as page_no, min(struct_pack(a := pos, v := in_book)).v as book, min(struct_pack(a := pos, v := in_part)).v as part, min(struct_pack(a := pos, v := in_chapter)).v as chapter,
    {_STRIP.format("string_agg(line, chr(10) order by pos)")} as text from h where item > 0 group by 1, 2),
z as (select h.doc, 0 as item, 'preamble' as label, any_value(i.page_no) as page_no, any_value(i.book) as book, any_value(i.part) as part, any_value(i.chapter) as chapter, {_STRIP.format("string_agg(line, chr(10) order by pos)")} as text
    from h join i on i.doc = h.doc and i.item = 1 where h.items > 0 and h.item = 0 and bare <> '' and not of_law and h.head is null and not heading group by 1),
y as (select doc, page_no as item, 'section-p' || page_no as label, page_no, null as book, null as part, null as chapter, {_STRIP.format("string_agg(line, chr(10) order by pos)")} as text from h where items = 0 group by 1, 2, 4),
x as (select *, true as own from i union all select *, true from z union all select *, false from y)
select x.doc, (row_number() over (partition by x.doc order by item) - 1)::bigint as chunk, label, page_no, {_CODE} as code, {_TYPES} as law_type, case when own then law[1:300] end as law, book, part, chapter, text
from x join w using (doc) where text <> ''"""


@query(_STATUTES_SQL)
def statute_chunks(spark, sf_dir):
    """Articles with their headings, law and pages. The SQL has no compatibility composition, so the texts are taken as they are."""
    return L.statute_chunks(R.durable(_pages(spark, sf_dir)), normalize=False)


def _tokenizer():
    import public_tokenizers

    # A model puts one special token before a text and one behind it.
    return json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), 2)


@query()
def statute_pieces(spark, sf_dir):
    """The articles cut to the served budget by a tokenizer's ids."""
    return L.statute_pieces(_pages(spark, sf_dir), _tokenizer)


@query()
def budget_pieces(spark, sf_dir):
    """Documents as they are, each a page, cut to the served budget; what the articles' way cannot cut is cut by pages."""
    d = read(spark, sf_dir, "documents")
    return L.statute_pieces(d.select(F.col("doc_id").alias("doc"), F.lit(1).cast("long").alias("page_no"), "text", F.col("source").alias("path")), _tokenizer)


@query()
def served_token_counts(spark, sf_dir):
    """Tokens that a model is served for each document, special ones included."""
    return read(spark, sf_dir, "documents").select("doc_id", served_tokens(F.col("text"), _tokenizer).alias("n_tokens"))

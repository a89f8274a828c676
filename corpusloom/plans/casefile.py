"""Queries of the analysis of case files: documents are sections of matters by a stated rule, beside literal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import casefile as C
from .base import DOC_TYPES, inline, query, read
from .fixtures import CASES, FILED, PASSAGES

#: The rule: a hundred documents are a matter, each a document of one section; users' turns are the messages of a matter.
_SECTIONS = f"""(select doc_id // 100 as matter, doc_id % 100 as seq, doc_id as document_id, 1::bigint as page, 0::bigint as s, n_chars as e, source as title, text, n_chars < 60 as needs_review from documents
    union all select matter, seq, document_id, page, s, e, title, text, needs_review from {CASES.sql})"""
_FILES = f"(select doc_id // 100 as matter, doc_id as document_id, {DOC_TYPES} as doc_type from documents union all select matter, document_id, doc_type from {FILED.sql})"
_MESSAGES = "(select conv_id as matter, turn as seq, text from conversations where role = 'user')"
GLOSSARY = [
    ("notice period", "أجل الإخطار", "المدة قبل انتهاء العقد", "le temps entre l'annonce et la fin du contrat"),
    ("salary", "الأجر", "ما يؤدى مقابل العمل", "ce qui est payé pour le travail"),
    ("settlement", "الصلح", "اتفاق ينهي النزاع", "un accord qui met fin au litige"),
]


def case_of(spark, sf_dir) -> C.Case:
    d = read(spark, sf_dir, "documents")
    matter = F.floor(F.col("doc_id") / 100).cast("long").alias("matter")
    sections = d.select(matter, (F.col("doc_id") % 100).alias("seq"), F.col("doc_id").alias("document_id"), F.lit(1).cast("long").alias("page"), F.lit(0).cast("long").alias("s"), F.col("n_chars").alias("e"), F.col("source").alias("title"), "text", (F.col("n_chars") < 60).alias("needs_review"))
    files = d.select(matter, F.col("doc_id").alias("document_id"), F.expr(DOC_TYPES).alias("doc_type"))
    messages = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("matter"), F.col("turn").alias("seq"), "text")
    return C.Case(sections.unionByName(inline(spark, CASES)), files.unionByName(inline(spark, FILED)), messages, inline(spark, PASSAGES), GLOSSARY)


_W = r"[\p{L}\p{N}_À-ÿ''’-]"
_PERSON = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:Mr|Mrs|Ms|M\.|Mme|Me)\.?\s+([A-ZÀ-Þ]{_W}+(?:\s+[A-ZÀ-Þ]{_W}+){{0,2}})"
_C = r"[\p{L}\p{N}_À-ÿ''’&.-]"
_COMPANY = rf"(?i)([A-ZÀ-Þ]{_C}*(?:\s+[A-ZÀ-Þ]{_C}*){{0,3}}\s+(?:SARL|SA\b|SAS|LLC|Inc\.?|Ltd\.?))"


@query(f"""with f as (select matter, seq, k, unnest(v) as name, unnest(range(len(v))) as i from (
        select matter, seq, 0 as k, regexp_extract_all(text, '{_PERSON}', 1) as v from {_SECTIONS} union all select matter, seq, 1, regexp_extract_all(text, '{_COMPANY}', 1) from {_SECTIONS})),
    r as (select *, row_number() over (partition by matter, lower(trim(name)) order by seq, k, i) as n from f)
    select matter, seq, trim(name) as name, case k when 0 then 'person' else 'employer' end as kind from r where n = 1""")
def parties(spark, sf_dir):
    """Each name of a matter where it comes up first."""
    return C.parties(case_of(spark, sf_dir)).select("matter", "seq", "name", "kind")


_HIT = [" or ".join(f"contains(lower(text), '{w}')" for w in x[3]) for x in C.ISSUES[:3]]
_OWED = "len(list_filter(string_split(regexp_replace(text, '([.!;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: " + " or ".join(f"contains(lower(s), '{w}')" for w in A.OBLIGATIONS) + ")) > 0"
_BEFORE = "(len(list_filter(regexp_extract_all(text, '([\\s\\S]{0,30})\\b(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}[/.]\\d{1,2}[/.]\\d{2,4})\\b', 1), lambda b: regexp_matches(lower(b), 'notice|préavis|pré-avis'))) > 0)"
#: One row a matter: what its sections and files say.
_FLAGS = f"""with s as (select *, lead(text) over (partition by matter order by seq) as after, lead(seq) over (partition by matter order by seq) as next from (select * replace (coalesce(text, '') as text) from {_SECTIONS})),
a as (select matter, count(*) as sections, bool_or({_OWED}) as owed, bool_or({_HIT[0]}) as h0, bool_or({_HIT[1]}) as h1, bool_or({_HIT[2]}) as h2, bool_or({_BEFORE}) as notice_date,
    bool_or(next = seq + 1 and lower(text) like '%notice' and lower(after) like 'period%') as across, {", ".join(f"bool_or(contains(lower(text), '{t[0]}') or contains(text, '{t[1]}')) as g{i}" for i, t in enumerate(GLOSSARY))} from s group by 1),
f as (select matter, count(*) as files, count(*) filter (doc_type = 'payslip') as payslips, list_sort(list(distinct doc_type)) as types from {_FILES} group by 1),
m as (select distinct matter from {_MESSAGES}),
b as (select matter, coalesce(sections, 0) as sections, coalesce(files, 0) as files, coalesce(payslips, 0) as payslips, coalesce(types, []) as types, coalesce(owed, false) as owed, coalesce(h0, false) as h0, coalesce(h1, false) as h1,
    coalesce(h2, false) as h2, coalesce(notice_date, false) as notice_date, coalesce(across, false) as across, {", ".join(f"coalesce(g{i}, false) as g{i}" for i in range(len(GLOSSARY)))} from a full join f using (matter) full join m using (matter)),
t as (select *, [h0, h1 or across, h2, not list_contains(types, 'contract'), payslips < 3, not owed] as tests from b),
i as (select *, unnest(range(6)) as rank, unnest(tests) as holds from t where sections > 0)"""
_OF_RANK = lambda k: "case rank " + " ".join(f"when {i} then '{x[k]}'" for i, x in enumerate(C.ISSUES)) + " end"


@query(f"{_FLAGS} select matter, rank::int as rank, {_OF_RANK(0)} as issue, replace({_OF_RANK(1)}, '{{}}', payslips::varchar) as finding, {_OF_RANK(2)} as risk from i where holds")
def issues(spark, sf_dir):
    """The issues of each matter and what is found."""
    return C.issues(C.flags(case_of(spark, sf_dir)))


_CITED = " ".join(f"when {i} then ({h}) or not h{i}" for i, h in enumerate(_HIT))


@query(f"{_FLAGS} select i.matter, rank::int as rank, s.seq, s.document_id, s.page, s.s, s.e from i join s on s.matter = i.matter where holds and case rank {_CITED} else true end")
def issue_refs(spark, sf_dir):
    """The sections that each issue cites."""
    case = case_of(spark, sf_dir)
    return C.issue_refs(case, C.flags(case))


_TYPES = " || ".join(f"case when list_contains(types, '{t}') then [] else ['{C.MISSING_TYPE.format(t)}'] end" for t in A.EXPECTED_TYPES)
_GAPS = f"""case when files = 0 or sections = 0 then ['{C.NO_FILES}'] else {_TYPES} || case when payslips < 3 then [replace('{C.MISSING_SLIPS}', '{{}}', payslips::varchar)] else [] end
    || case when notice_date then [] else ['{C.MISSING_NOTICE}'] end end"""


def _said(lines, term):
    q = lambda x: x.replace("'", "''")
    terms = ", ".join(f"case when g{i}{' or across' if ' ' in t[0] else ''} then '{q(term(*t))}' end" for i, t in enumerate(GLOSSARY))
    return f"concat_ws(chr(10), replace('{q(lines[0])}', '{{}}', sections::varchar), replace('{q(lines[1])}', '{{}}', issues::varchar), {terms}, case when len(gaps) > 0 then replace('{q(lines[2])}', '{{}}', len(gaps)::varchar) end)"


@query(f"""{_FLAGS}, h as (select *, {_GAPS} as gaps, len(list_filter(tests, lambda x: x)) * (sections > 0)::int as issues from t)
    select matter, case when sections > 0 then 'complete' else 'needs-documents' end as status, array_to_string(types, ',') as types, sections, issues::bigint as issues, array_to_string(gaps, '|') as gaps,
    case when sections > 0 then {_said(C.AR, lambda t, ar, pa, pf: f"{ar} ({t}): {pa}")} else '{C.EMPTY_AR}' end as summary_ar,
    case when sections > 0 then {_said(C.FR, lambda t, ar, pa, pf: f"{t} ({ar}) : {pf}")} else '{C.EMPTY_FR.replace("'", "''")}' end as summary_fr from h""")
def case_heads(spark, sf_dir):
    """Status, gaps and both summaries of each matter."""
    return C.heads(case_of(spark, sf_dir)).select("matter", "status", F.array_join("types", ",").alias("types"), "sections", "issues", F.array_join("gaps", "|").alias("gaps"), "summary_ar", "summary_fr")


@query(f"""with m as (select matter, seq, lower(v) as value, row_number() over (partition by matter, seq) as i from (select matter, seq, unnest(regexp_extract_all(text, '(?i)(\\d+\\s*(?:months?|mois))')) as v from {_SECTIONS} where contains(lower(text), 'notice period') or contains(lower(text), 'préavis'))),
    v as (select matter, value, min(struct_pack(s := seq, i := i)) as o, min(seq) as lo, max(seq) as hi, count(*) as n from m group by 1, 2)
    select a.matter, a.value as a_value, b.value as b_value, a.n as a_mentions, b.n as b_mentions from v a join v b on a.matter = b.matter and (a.o, a.value) < (b.o, b.value) where not (a.lo = a.hi and b.lo = b.hi and a.lo = b.lo)""")
def contradiction_classes(spark, sf_dir):
    """Every two different notice periods of a matter once, with their mentions."""
    said = r"'(\d+\s*(?:months?|mois))' vs '(\d+\s*(?:months?|mois))'"
    return C.contradictions(case_of(spark, sf_dir)).select("matter", *[F.regexp_extract("note", said, k + 1).alias(f"{n}_value") for k, n in enumerate("ab")], "a_mentions", "b_mentions")


@query()
def analysis_report(spark, sf_dir):
    """All lists of the analysis, by parts."""
    return C.lists(C.items(case_of(spark, sf_dir)))


@query()
def case_citations(spark, sf_dir):
    return C.citations(case_of(spark, sf_dir))


@query()
def draft_render(spark, sf_dir):
    """The four drafts of each matter."""
    return C.drafts(case_of(spark, sf_dir))

"""The whole analysis of a case file: parties, dates, obligations, issues, gaps, contradictions, summaries, the four lists of what is known,
citations and the four drafts, all keyed by matter.

A matter may hold any number of sections, so no list of it is ever gathered in one row: every item is a row with its place (`seq` of its
section, `at` within it), and lists are cut into parts of what SIZE consecutive sections give. A draft is its blocks in order; only the
drafts of matters that fit one part are joined to one text. What is one row for each matter (flags, gaps, counts, summaries) comes from
aggregates that combine in the tasks.

Defined results: a null text is an empty one; a matter without sections needs documents; sections repeated with all their columns are
sections of their own; of one name, whatever its case, the first place counts, persons before companies; contradictions are stated once
for each pair of different durations (with how many mentions each has), never for each pair of mentions; a phrase that two neighbouring sections make
together counts as met, and then cites all sections.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import analysis as A
from . import relational as R

#: Sections whose items make one part of a list.
SIZE = 200
NOTICE_WORDS = ["notice period", "préavis"]
#: What is said of an issue, in order; the first three are met by words.
ISSUES = [
    ("Employment termination recorded", "Evidence states the employment ended; verify the stated ground and procedure.", "High", ["terminat", "licenci", "fired"]),
    ("Notice period stated", "Evidence states a notice period; verify it was observed and paid.", "Medium", ["notice period", "préavis", "pré-avis"]),
    ("Final compensation stated", "Evidence mentions a final payment; verify the amount reached the employee.", "Medium", ["compensat", "indemnit", "paid", "mad"]),
    ("Employment contract not on file", "No contract document in this matter; the stated terms cannot be cross-checked.", "High", None),
    ("Salary history incomplete", "Only {} payslip(s) on file; 3 expected to verify salary claims.", "Medium", None),
    ("No explicit obligations detected", "No payment/promise sentence detected; obligations may be in a missing document.", "Low", None),
]
#: Gaps.
NO_FILES = "No documents on file — upload the employment contract, termination letter, at least 3 recent payslips, and any correspondence so the analysis has evidence to work from."
MISSING_TYPE = "Missing {0} — upload the {0} document to complete the file."
MISSING_SLIPS = "Missing payslips — 3 recent payslips expected, only {} on file; upload the missing payslips."
MISSING_NOTICE = "Missing notice date — no date in notice context found in the evidence; provide the document stating when notice started."
#: Lines of the summaries, and what is said of a matter without documents.
EMPTY_AR = "لا توجد وثائق في هذه القضية بعد. أضف وثائق ليتمكن التحليل من العمل."
EMPTY_FR = "Aucun document dans ce dossier pour le moment. Ajoutez des documents pour permettre l'analyse."
AR = ["تم تحليل {} مقطع من وثائق القضية.", "تم رصد {} نقطة تحتاج إلى انتباه.", "وثائق ناقصة ({}): انظر قائمة النواقص."]
FR = ["{} passage(s) des documents du dossier ont été analysés.", "{} point(s) à examiner ont été relevés.", "Documents manquants ({}) : voir la liste des lacunes."]
#: The templates of drafts; names in braces are blocks. Lines of lists bring their own line feed.
BANNER = "AI-generated draft, not legal advice, verify before use\n\n"
NONE = {"issues": "\n- (no issues recorded in the analysis)", "obligations": "\n- (no explicit obligations detected)", "gaps": "\n- (no gaps recorded)", "authorities": "\n(none on file — no authority passages stored for this matter)", "parties": "(parties as recorded in the file)"}
TEMPLATES = {
    "opinion": ["OPINION (provisional, based solely on the matter file)\n\nSummary (AR): ", "{summary_ar}", "\n\nSummary (FR): ", "{summary_fr}", "\n\nIssues identified:", "{issues}", "\n\nObligations on record:", "{obligations}", "\n\nAuthority passages cited:", "{authorities}", "\n\nOpen points before any conclusion:", "{gaps}"],
    "client_email": ["Subject: Update on your file (provisional draft)\n\nHello,\n\nHere is a plain-language update based on your documents:\n", "{summary_fr}", "\n\nملخص بالعربية:\n", "{summary_ar}", "\n\nPoints we have spotted:", "{issues}", "\n\nTo move forward we still need:", "{gaps}", "\n\nPlease confirm the missing documents so the file can be completed."],
    "demand_letter": ["DEMAND LETTER (provisional draft — do not send without review)\n\nParties on record: ", "{parties}", "\n\nFacts and obligations relied upon:", "{obligations}", "\n\nIssues supporting this demand:", "{issues}", "\n\nAuthority passages cited:", "{authorities}", "\n\nRequested next steps (provisional, subject to verification):", "{gaps}"],
    "memo": ["MEMO (provisional, file-internal)\n\nFACTS (from matter spans):", "{obligations}", "\n\nISSUES / RISKS:", "{issues}", "\n\nGAPS (missing documents):", "{gaps}", "\n\nAUTHORITIES ON FILE:", "{authorities}"],
}


@dataclass
class Case:
    """sections (matter, seq: from 0 without gaps within a matter, document_id, page, s, e, title, text, needs_review); files (matter,
    document_id, doc_type); messages of the user (matter, seq, text); authorities stored with messages (matter, seq, domain, source, version,
    edition, article_or_section); glossary: (term, ar, plain_ar, plain_fr)."""

    sections: DataFrame
    files: DataFrame
    messages: DataFrame
    authorities: DataFrame | None = None
    glossary: list[tuple[str, str, str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.sections = self.sections.withColumns({"text": F.coalesce("text", F.lit("")), "needs_review": F.coalesce("needs_review", F.lit(False))})


_PLACE = ["document_id", "page", "s", "e"]


def _ref() -> Column:
    return F.struct("document_id", "page", F.array("s", "e").alias("span"))


def _contains(c: Column, words: list[str]) -> Column:
    return A.any_of(F.lower(c), words)


def parties(case: Case) -> DataFrame:
    """matter, seq, at, name, kind (person or employer) and its place: the first of each name within a matter."""

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), T.strip(x).alias("name")))

    employer = named("employer", A.COMPANY)
    # Without the beginning of a legal form no name of a company is looked for.
    employer = F.when(F.col("text").rlike(r"(?iuU)\s(?:SA|LLC|Inc|Ltd)"), employer).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))
    kinds = F.concat(named("person", A.PERSON), employer)
    found = case.sections.select("matter", "seq", *_PLACE, F.posexplode(kinds).alias("at", "p")).select("matter", "seq", "at", "p.*", *_PLACE)
    first = found.groupBy("matter", F.lower("name").alias("_low")).agg(F.min(F.struct("seq", "at", "name", "kind", *_PLACE)).alias("p"))
    return first.select("matter", "p.*")


def employers(found: DataFrame) -> DataFrame:
    """matter, who: the first employer of each matter."""
    return found.where("kind = 'employer'").groupBy("matter").agg(F.min_by("name", F.struct("seq", "at")).alias("who"))


def dates(case: Case) -> DataFrame:
    """matter, seq, at, label, value, needs_review and the place. The label looks at the 30 characters before a date: at most five dates
    with what lies between them."""
    rows = case.sections.where(F.col("text").rlike(r"\d[-/.]\d")).withColumns({"_g": F.split("text", A.DATE, -1), "_h": F.regexp_extract_all("text", F.lit(A.DATE), F.lit(1))})
    rows = rows.select("matter", "seq", "needs_review", *_PLACE, "_g", F.posexplode("_h").alias("at", "value"), "_h")
    at = F.col("at")
    parts = [x for k in range(5, 0, -1) for x in (F.coalesce(F.get("_g", at - k), F.lit("")), F.coalesce(F.get("_h", at - k), F.lit("")))]
    around = F.lower(F.right(F.concat(*parts, F.get("_g", at)), F.lit(30)))
    label = F.when(around.rlike("notice|préavis|pré-avis"), "notice date").when(around.rlike("effect|partir"), "effective date").otherwise("mentioned date")
    return rows.select("matter", "seq", "at", label.alias("label"), "value", "needs_review", *_PLACE)


def obligations(case: Case, found: DataFrame) -> DataFrame:
    """matter, seq, at, who, what and the place: sentences that promise or demand; the matter's employer owes them."""
    # No phrase lies across two sentences: texts without any are not split.
    rows = case.sections.where(_contains(F.col("text"), A.OBLIGATIONS)).select("matter", "seq", *_PLACE, F.posexplode(F.split("text", r"(?<=[.!;])(?U)\s+")).alias("at", "what"))
    rows = rows.where(_contains(F.col("what"), A.OBLIGATIONS)).withColumn("what", T.strip(F.col("what")))
    return rows.join(employers(found), "matter", "left").select("matter", "seq", "at", F.coalesce("who", F.lit("employer")).alias("who"), "what", *_PLACE)


def _across(case: Case, phrase: str) -> DataFrame:
    """The matters of which two neighbouring sections make the phrase together, at one of its spaces."""
    words, out = phrase.split(" "), None
    for k in range(1, len(words)):
        left, right = " ".join(words[:k]), " ".join(words[k:])
        last, begin = F.lower(F.right("text", F.lit(len(left)))), F.lower(F.left("text", F.lit(len(right))))
        ends, starts = case.sections.where(last.endswith(left)).select("matter", (F.col("seq") + 1).alias("seq")), case.sections.where(begin.startswith(right)).select("matter", "seq")
        met = ends.join(starts, ["matter", "seq"]).select("matter").distinct()
        out = met if out is None else out.unionByName(met).distinct()
    return out


def flags(case: Case) -> DataFrame:
    """One row for each matter: sections, hit0.. (a rule's words stand in one section), met0.. (or across two), owed, notice_date, types,
    payslips, files, and term0.. of the glossary."""
    text = F.col("text")
    worded = [words for *_, words in ISSUES if words]
    terms = [F.contains(F.lower(text), F.lit(t.lower())) | (F.contains(text, F.lit(ar)) if ar else F.lit(False)) for t, ar, *_ in case.glossary]
    owed = _contains(text, A.OBLIGATIONS)
    by = case.sections.groupBy("matter").agg(
        F.count("*").alias("sections"), F.bool_or(owed).alias("owed"), *[F.bool_or(_contains(text, w)).alias(f"hit{i}") for i, w in enumerate(worded)], *[F.bool_or(t).alias(f"term{i}") for i, t in enumerate(terms)]
    )
    notice = dates(case).where("label = 'notice date'").select("matter").distinct().withColumn("notice_date", F.lit(True))
    files = case.files.groupBy("matter").agg(F.array_sort(F.collect_set("doc_type")).alias("types"), F.count_if(F.col("doc_type") == "payslip").alias("payslips"), F.count("doc_type").alias("files"))
    said = case.messages.select("matter").distinct()
    out = by.join(files, "matter", "full_outer").join(said, "matter", "full_outer").join(notice, "matter", "left")
    across = [(f"met{i}", f"hit{i}", w) for i, words in enumerate(worded) for w in words if " " in w] + [(f"term{i}", f"term{i}", t[0].lower()) for i, t in enumerate(case.glossary) if " " in t[0]]
    for k, (_, _, phrase) in enumerate(across):
        out = out.join(_across(case, phrase).withColumn(f"_x{k}", F.lit(True)), "matter", "left")
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    reached = {f"met{i}": false(f"hit{i}") for i in range(len(worded))} | {f"term{i}": false(f"term{i}") for i in range(len(case.glossary))}
    for k, (name, _, _) in enumerate(across):
        reached[name] = reached[name] | false(f"_x{k}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "matter", zero("sections"), zero("files"), zero("payslips"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), false("owed").alias("owed"), false("notice_date").alias("notice_date"),
        *[false(f"hit{i}").alias(f"hit{i}") for i in range(len(worded))], *[c.alias(n) for n, c in reached.items()],
    )


def _filled(template: str, value: Column) -> Column:
    """The template with value for {}."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def _tests() -> list[Column]:
    """Whether each issue holds, over flags."""
    words = [F.col(f"met{i}") for i, x in enumerate(ISSUES) if x[3]]
    absent = [~F.array_contains("types", "contract"), F.col("payslips") < A.PAYSLIPS, ~F.col("owed")]
    return [(F.col("sections") > 0) & t for t in (*words, *absent)]


def issues(marks: DataFrame) -> DataFrame:
    """matter, rank, issue, finding, risk from the flags of matters."""
    rules = []
    for i, ((issue, finding, risk, _), test) in enumerate(zip(ISSUES, _tests(), strict=True)):
        said = _filled(finding, F.col("payslips")) if "{}" in finding else F.lit(finding)
        rules.append(F.when(test, F.struct(F.lit(i).alias("rank"), F.lit(issue).alias("issue"), said.alias("finding"), F.lit(risk).alias("risk"))))
    return marks.select("matter", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("matter", "x.*")


def issue_refs(case: Case, marks: DataFrame) -> DataFrame:
    """matter, rank, seq and the place of every section that an issue cites: those with its words, or all where no single one has them."""
    tests = _tests()
    marks = marks.select("matter", *[t.alias(f"_t{i}") for i, t in enumerate(tests)], *[f"hit{i}" for i, x in enumerate(ISSUES) if x[3]])
    rows = case.sections.join(marks, "matter")
    cited = [F.col(f"_t{i}") & (_contains(F.col("text"), words) | ~F.col(f"hit{i}") if words else F.lit(True)) for i, (*_, words) in enumerate(ISSUES)]
    return rows.select("matter", "seq", *_PLACE, F.explode(F.array_compact(F.array(*[F.when(c, i) for i, c in enumerate(cited)]))).alias("rank"))


def gaps(marks: DataFrame) -> DataFrame:
    """matter, gaps: at most five lines."""
    expected = [F.when(~F.array_contains("types", t), MISSING_TYPE.format(t)) for t in A.EXPECTED_TYPES]
    lines = F.array_compact(F.array(*expected, F.when(F.col("payslips") < A.PAYSLIPS, _filled(MISSING_SLIPS, F.col("payslips"))), F.when(~F.col("notice_date"), MISSING_NOTICE)))
    return marks.select("matter", F.when((F.col("files") == 0) | (F.col("sections") == 0), F.array(F.lit(NO_FILES))).otherwise(lines).alias("gaps"))


def contradictions(case: Case) -> DataFrame:
    """matter, seq, at (the first mentions' sections), a and b (places), note, a_mentions, b_mentions: every two different durations that
    different sections give for the notice period."""
    noticed = case.sections.where(_contains(F.col("text"), NOTICE_WORDS))
    said = noticed.select("matter", "seq", *_PLACE, F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(A.DURATION), F.lit(1)), lambda x: F.lower(x))).alias("at", "value"))
    place = F.struct("seq", "at", _ref().alias("ref"))
    classes = said.groupBy("matter", "value").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("mentions"))
    a, b = (classes.select("matter", *[F.col(c).alias(f"{c}_{n}") for c in ("value", "first", "last", "mentions")]) for n in "ab")
    order = lambda n: F.struct(f"first_{n}.seq", f"first_{n}.at", f"value_{n}")
    pairs = a.join(b, "matter").where(order("a") < order("b"))
    same = lambda x, y: F.col(x)["ref"] == F.col(y)["ref"]
    ends = (
        F.when(~same("first_a", "first_b"), F.struct(F.col("first_a").alias("a"), F.col("first_b").alias("b")))
        .when(~same("first_a", "last_b"), F.struct(F.col("first_a").alias("a"), F.col("last_b").alias("b")))
        .when(~same("last_a", "first_b"), F.struct(F.col("last_a").alias("a"), F.col("first_b").alias("b")))
    )
    note = F.concat(F.lit("Conflicting notice-period durations retained side by side: '"), "value_a", F.lit("' vs '"), "value_b", F.lit("'. Both spans are kept; neither is treated as fact."))
    rows = pairs.withColumn("_e", ends).where(F.col("_e").isNotNull())
    return rows.select("matter", F.col("_e.a.seq").alias("seq"), F.col("_e.b.seq").alias("at"), F.col("_e.a.ref").alias("a"), F.col("_e.b.ref").alias("b"), note.alias("note"), F.col("mentions_a").alias("a_mentions"), F.col("mentions_b").alias("b_mentions"))


def heads(case: Case, marks: DataFrame | None = None) -> DataFrame:
    """One row for each matter: status, types, sections, issues, gaps, glossary_used, summary_ar, summary_fr."""
    marks = flags(case) if marks is None else marks
    n_issues = F.array_size(F.array_compact(F.array(*[F.when(t, 1) for t in _tests()])))
    rows = marks.join(gaps(marks), "matter").withColumn("issues", n_issues)
    some = F.col("sections") > 0
    used = F.array_compact(F.array(*[F.when(F.col(f"term{i}") & some, t[0]) for i, t in enumerate(case.glossary)])) if case.glossary else F.array().cast("array<string>")

    def summary(lines: list[str], term) -> Column:
        said = [F.when(F.col(f"term{i}"), term(*t)) for i, t in enumerate(case.glossary)]
        lack = F.when(F.size("gaps") > 0, _filled(lines[2], F.size("gaps")))
        return F.concat_ws("\n", _filled(lines[0], F.col("sections")), _filled(lines[1], F.col("issues")), *said, lack)

    ar = summary(AR, lambda t, ar, plain_ar, plain_fr: f"{ar} ({t}): {plain_ar}")
    fr = summary(FR, lambda t, ar, plain_ar, plain_fr: f"{t} ({ar}) : {plain_fr}")
    return rows.select("matter", F.when(some, "complete").otherwise("needs-documents").alias("status"), "types", "sections", F.col("issues").cast("long").alias("issues"), "gaps", used.alias("glossary_used"), F.when(some, ar).otherwise(EMPTY_AR).alias("summary_ar"), F.when(some, fr).otherwise(EMPTY_FR).alias("summary_fr"))


def items(case: Case) -> DataFrame:
    """matter, key, seq, at, item (JSON): every entry of every list of the analysis, the four lists of what is known among them."""
    marks = R.durable(flags(case))
    found, when, issue = R.durable(parties(case)), dates(case), issues(marks)
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame, key: str, item: Column, seq: Column | str = "seq", at: Column | str = "at") -> DataFrame:
        at, seq = (F.col(x) if isinstance(x, str) else x for x in (at, seq))
        return df.select("matter", F.lit(key).alias("key"), seq.cast("long").alias("seq"), at.cast("long").alias("at"), F.to_json(item).alias("item"))

    ref = _ref().alias("span_ref")
    known = case.sections.select("matter").distinct()
    types = marks.where("sections > 0").select("matter", F.posexplode("types").alias("at", "t"))
    day = F.concat(F.lit("Date "), "value", F.lit(" ("), "label", F.lit(") appears in evidence."))
    parts = [
        rows(found, "parties", F.struct("name", "kind", ref)),
        rows(when, "dates", F.struct("label", "value", ref, "needs_review")),
        rows(obligations(case, found), "obligations", F.struct("who", "what", ref)),
        rows(issue, "issues", F.struct("issue", "finding", "risk"), "rank", zero),
        rows(issue_refs(case, marks), "issue_refs", F.struct("rank", ref), "seq", "rank"),
        rows(contradictions(case), "contradictions", F.struct("a", "b", "note", "a_mentions", "b_mentions")),
        rows(gaps(marks).select("matter", F.posexplode("gaps").alias("at", "gap")), "gaps", F.struct("gap"), zero),
        rows(case.sections, "source_statements", F.struct("text", "title", ref, "needs_review"), "seq", zero),
        rows(case.messages, "client_assertions", F.struct("text"), "seq", zero),
        # File presence stands before all dates.
        rows(types.join(known, "matter", "left_semi"), "verified_facts", F.struct(F.concat(F.lit("Document of type '"), "t", F.lit("' on file.")).alias("fact"), F.lit("file-presence").alias("kind")), F.lit(-1)),
        rows(when.where("not needs_review"), "verified_facts", F.struct(day.alias("fact"), F.lit("evidence-date").alias("kind"), ref)),
        rows(issue, "ai_inferences", F.struct(F.concat(F.lit("Heuristic issue: "), "issue", F.lit(" (risk "), "risk", F.lit(").")).alias("inference"), F.lit("heuristic-issue").alias("kind")), "rank", zero),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lists(found: DataFrame, size: int = SIZE) -> DataFrame:
    """items -> matter, key, part, items: the entries in order, by parts of `size` sections."""
    part = F.floor(F.greatest(F.col("seq"), F.lit(0)) / size)
    got = found.groupBy("matter", "key", part.cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "item"))).alias("x"))
    return got.select("matter", "key", "part", F.transform("x", lambda x: x["item"]).alias("items"))


def citations(case: Case) -> DataFrame:
    """matter, document_id, page, s, e, rank, seq, at: each place once, where it comes up first among issues, obligations, parties, dates and
    contradictions."""
    marks, found = R.durable(flags(case)), R.durable(parties(case))
    pairs = contradictions(case)
    sides = [pairs.select("matter", "seq", F.lit(k).alias("at"), F.col(f"{x}.document_id"), F.col(f"{x}.page"), F.col(f"{x}.span")[0].alias("s"), F.col(f"{x}.span")[1].alias("e")) for k, x in enumerate("ab")]
    sources = [issue_refs(case, marks).withColumnRenamed("rank", "at"), obligations(case, found), found, dates(case), *sides]
    out = None
    for k, df in enumerate(sources):
        # Issues go by rank first, the others by section.
        order = ("at", "seq") if k == 0 else ("seq", "at")
        rows = df.select("matter", *_PLACE, F.lit(min(k, 4)).alias("rank"), *[F.col(c).cast("long").alias(n) for c, n in zip(order, ("first", "second"), strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("matter", *_PLACE).agg(F.min(F.struct("rank", "first", "second")).alias("o")).select("matter", *_PLACE, "o.*")


def authority_citations(stored: DataFrame) -> DataFrame:
    """matter, seq, source, version, edition, article_or_section: stored authority passages with a source and an article, each once."""
    clean = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    rows = stored.where((F.coalesce("domain", F.lit("authority")) == "authority") & (F.length(clean("source")) > 0) & (F.length(clean("article_or_section")) > 0))
    key = [clean("source").alias("_s"), F.coalesce("version", F.lit("")).alias("_v"), clean("article_or_section").alias("_a")]
    return rows.groupBy("matter", *key).agg(F.min(F.struct("seq", "source", "version", "edition", "article_or_section")).alias("c")).select("matter", "c.*")


def matter_ref() -> Column:
    return F.format_string("[matter: doc %d p.%d ¶[%d, %d]]", *_PLACE)


def draft_blocks(case: Case, marks: DataFrame, size: int = SIZE) -> DataFrame:
    """matter, block, sub, part, content: the list blocks of drafts, cut in parts, each line with its own line feed."""
    found = R.durable(parties(case))
    part = F.floor(F.col("seq") / size).cast("long").alias("part")

    def block(df: DataFrame, name: str, line: Column, glue: str, at: str | None = "at", sub: Column | None = None) -> DataFrame:
        own = F.lit(0) if sub is None else sub
        place = F.struct("seq", *([at] if at else []), line.alias("line"))
        got = df.groupBy("matter", own.alias("sub"), part).agg(F.array_sort(F.collect_list(place)).alias("x"))
        text = F.array_join(F.transform("x", lambda x: x["line"]), glue)
        return got.select("matter", F.lit(name).alias("block"), F.col("sub").cast("long").alias("sub"), "part", text.alias("content"))

    one = lambda df, name, sub, content: df.select("matter", F.lit(name).alias("block"), sub.cast("long").alias("sub"), F.lit(-1).cast("long").alias("part"), content.alias("content"))
    head = F.concat(F.lit("\n- "), "issue", F.lit(": "), "finding", F.lit(" (risk: "), "risk", F.lit(")"))
    issue = one(issues(marks), "issues", F.col("rank"), head).unionByName(block(issue_refs(case, marks), "issues", F.concat(F.lit(" "), matter_ref()), "", None, F.col("rank")))
    owed = block(obligations(case, found), "obligations", F.concat(F.lit("\n- "), "who", F.lit(": "), "what", F.lit(" "), matter_ref()), "")
    begins = found.groupBy("matter").agg(F.min(F.floor(F.col("seq") / size)).alias("_p"))
    named = block(found, "parties", F.col("name"), ", ").join(begins, "matter").withColumn("content", F.when(F.col("part") > F.col("_p"), F.concat(F.lit(", "), "content")).otherwise(F.col("content"))).drop("_p")
    lack = one(gaps(marks), "gaps", F.lit(0), F.array_join(F.transform("gaps", lambda g: F.concat(F.lit("\n- "), g)), ""))
    out = issue.unionByName(owed).unionByName(named).unionByName(lack.where("content <> ''"))
    if case.authorities is not None:
        tag = F.concat(*[x for c in ("source", "version", "article_or_section") for x in (F.lit(" "), F.coalesce(F.col(c), F.lit("None")))])
        out = out.unionByName(block(authority_citations(case.authorities), "authorities", F.concat(F.lit("\n- [authority:"), tag, F.lit(" ("), F.coalesce("edition", F.lit("None")), F.lit(")]")), "", None))
    return out


def drafts(case: Case, size: int = SIZE) -> DataFrame:
    """matter, draft_type, piece, content. A draft whose lists have one part each is one text (piece 0); a longer one comes in pieces that,
    in order, are the text."""
    marks = R.durable(flags(case))
    blocks = R.durable(draft_blocks(case, marks, size))
    top = R.durable(heads(case, marks))
    summaries = [top.select("matter", F.lit(c).alias("block"), F.lit(0).cast("long").alias("sub"), F.lit(0).cast("long").alias("part"), F.col(c).alias("content")) for c in ("summary_ar", "summary_fr")]
    have = blocks.select("matter", "block").distinct()
    empty = top.select("matter", F.explode(F.create_map(*[F.lit(x) for kv in NONE.items() for x in kv])).alias("block", "content")).join(have, ["matter", "block"], "left_anti")
    empty = empty.select("matter", "block", F.lit(0).cast("long").alias("sub"), F.lit(0).cast("long").alias("part"), "content")
    named = blocks.unionByName(empty).unionByName(summaries[0]).unionByName(summaries[1])
    spots, fixed = [], []
    for kind, template in TEMPLATES.items():
        for k, x in enumerate([BANNER, *template]):
            (spots if x.startswith("{") else fixed).append((kind, k, x.strip("{}") if x.startswith("{") else x))
    where = F.broadcast(case.sections.sparkSession.createDataFrame(spots, "draft_type string, place int, block string"))
    zero = F.lit(0).cast("long")
    said = F.array(*[F.struct(F.lit(d).alias("draft_type"), F.lit(k).alias("place"), F.lit(x).alias("content")) for d, k, x in fixed])
    words = top.select("matter", F.explode(said).alias("w")).select("matter", "w.draft_type", "w.place", zero.alias("sub"), zero.alias("part"), "w.content")
    rows = named.join(where, "block").select("matter", "draft_type", "place", "sub", "part", "content").unionByName(words)
    # Without further parts a draft has a bounded number of rows.
    sized = rows.groupBy("matter").agg((F.max("part") <= 0).alias("_whole"))
    rows = rows.join(sized, "matter")
    whole = rows.where("_whole").groupBy("matter", "draft_type").agg(F.array_sort(F.collect_list(F.struct("place", "sub", "part", "content"))).alias("x"))
    whole = whole.select("matter", "draft_type", F.lit("0").alias("piece"), F.array_join(F.transform("x", lambda x: x["content"]), "").alias("content"))
    piece = F.format_string("%02d.%d.%012d", "place", "sub", F.col("part") + 1)
    return whole.unionByName(rows.where("not _whole").select("matter", "draft_type", piece.alias("piece"), "content"))

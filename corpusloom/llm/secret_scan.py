"""Secret scan over a trigram inverted index, in DataFrame operations only.

1. `trigram_query` reads a rule's regular expression and derives the Boolean query that any matching text must satisfy:
   a disjunction of conjunctions of lower-case trigrams, or None where nothing is mandatory.
2. `postings` is the inverted index (trigram -> doc_id) for the trigrams that the rules ask for.
3. `candidates` intersects the postings: one row per document that satisfies at least one rule's query, with those rules.
4. `scan` verifies. Rules with a query run on their candidates only; rules without one run on every text.

A text's matches are taken in chunks whose starts are known from the chunks' lengths, so that no array grows match by match: work
is linear in the matches of a text up to millions of them.

Spans count code points, end exclusive. Matches of a rule are leftmost and non-overlapping; a match too short is dropped
after matching, so it still hides what it covers.

Defined results: a null text is empty; a null doc_id is an ordinary value (ids meet null-safely); rows with the same doc_id
share candidates, yet each text is verified for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C  # the standard library's own view of a pattern
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, join_measured, table


@dataclass(frozen=True)
class Rule:
    """pattern: Java and Python read it alike. min_length: of group `group` (0: the match)."""

    kind: str
    pattern: str
    min_length: int
    group: int = 0
    base: bool = False


#: The base kinds of the contract, in its order, then the method's own kinds.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]+", 16, 0, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
]
#: Matches of a text that are folded together; trigrams of a conjunction that the index holds, and rows on which they are chosen.
CHUNK, RAREST, PLAN_ROWS = 256, 2, 2000
#: Exact prefixes followed through a pattern: beyond so many, what is known so far becomes trigrams.
MAX_EXACT = 64


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _strings(tree, limit: int = MAX_EXACT) -> set[str] | None:
    """The finite set of lower-case strings that a parsed piece matches, or None if it has more than limit."""
    sets = {""}
    for op, arg in tree:
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            part = _strings(arg[3], limit)
        elif op is C.BRANCH:
            found = [_strings(x, limit) for x in arg[1]]
            part = None if None in found else set().union(*found)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 3:
            one = _strings(arg[2], limit)
            part = None if one is None else set()
            if one is not None:
                layer = {""}
                for n in range(arg[1] + 1):
                    if n >= arg[0]:
                        part |= layer
                    layer = {a + b for a in layer for b in one}
        elif op is C.AT:
            part = {""}
        else:
            part = None
        if part is None or len(sets) * len(part) > limit:
            return None
        sets = {a + b for a in sets for b in part}
    return sets


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Disjunction of conjunctions of trigrams that a text with a match contains; None: nothing is mandatory."""
    best, run = None, []

    def close():
        nonlocal best, run
        found = _strings(run) if run else None
        run = []
        if found and all(len(s) >= 3 for s in found):
            query = frozenset(_trigrams(s) for s in found)
            if best is None or min(map(len, query)) > min(map(len, best)):
                best = query

    for item in _parser.parse(pattern):
        trial = _strings([*run, item])
        if trial is None:
            close()
            if _strings([item]) is not None:
                run = [item]
        else:
            run.append(item)
    close()
    return best and frozenset(q for q in best if not any(other < q for other in best))  # a weaker conjunction absorbs a stricter one


def _queries(rules: list[Rule]) -> dict[str, frozenset[frozenset[str]] | None]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def _has(low: str, grams: list[str]) -> list[Column]:
    return [F.contains(low, F.lit(g)) for g in grams]


def rarest(docs: DataFrame, queries: dict[str, frozenset[frozenset[str]] | None], size: int = RAREST) -> dict[str, frozenset[frozenset[str]] | None]:
    """The queries with the `size` rarest trigrams of each conjunction, by some rows of docs: weaker, so nothing is lost, and an
    index for them is smaller. The choice changes the work, never the result."""
    grams = sorted(set().union(*[c for q in queries.values() if q for c in q]))
    some = docs.limit(PLAN_ROWS).select(F.lower("text").alias("_low"))
    n = dict(zip(grams, some.agg(*[F.count_if(x) for x in _has("_low", grams)]).first(), strict=True)) if grams else {}
    return {k: q and frozenset(frozenset(sorted(c, key=lambda g: (n[g], g))[:size]) for c in q) for k, q in queries.items()}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: rows (trigram, doc_id). Texts are in lower case, which keeps every ASCII trigram."""
    low = docs.select("doc_id", F.lower("text").alias("_low"))
    hits = F.array_compact(F.array(*[F.when(x, F.lit(g)) for x, g in zip(_has("_low", trigrams), trigrams, strict=True)]))
    return low.select("doc_id", F.explode(hits).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """Intersect postings: rows (doc_id, rules) of documents that satisfy the query of at least one rule."""
    lists = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("_has"))

    def holds(query) -> Column:
        out = F.lit(False)
        for conjunction in sorted(map(sorted, query)):
            out = out | (F.size(F.array_intersect("_has", F.array(*map(F.lit, conjunction)))) == len(conjunction))
        return out

    wanted = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return lists.select("doc_id", wanted.alias("rules")).where(F.size("rules") > 0)


def _chunks(array: str) -> str:
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {CHUNK}), c -> slice({array}, cast(c * {CHUNK} + 1 as int), {CHUNK}))"


def _running(chunks: str, of: str, step: str) -> str:
    """For each chunk what `step` makes of the figures `of` of the chunks before it; a is the figure so far, v the next."""
    return f"""aggregate(transform({chunks}, c -> {of}), named_struct('now', 0L, 'before', cast(array() as array<bigint>)),
        (s, v) -> named_struct('now', {step}, 'before', array_append(s.before, s.now)), s -> s.before)"""


def _matches(rule: Rule, text: str) -> str:
    """array<struct<gap, hit, value>>: lengths of what lies before each match of the rule, of the match, and of what is measured."""
    q = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    hits = f"transform(regexp_extract_all({text}, '{q}', 0), x -> length(x))"
    values = f"transform(regexp_extract_all({text}, '{q}', {rule.group}), x -> length(x))" if rule.group else hits
    return f"arrays_zip(transform(split({text}, '{q}', -1), x -> length(x)), {hits}, {values})"


def _spans(rule: Rule, matches: str, chunks: str, begins: str) -> str:
    """array<struct<start,end,kind>>; the last element of matches is what follows the last match."""
    found = "cast(array() as array<struct<start: bigint, end: bigint, kind: string>>)"
    return f"""flatten(zip_with({chunks}, {begins}, (m, b) -> aggregate(m, named_struct('at', b, 'found', {found}),
        (a, x) -> named_struct('at', a.at + x.`0` + coalesce(x.`1`, 0), 'found', if(x.`2` >= {rule.min_length},
            array_append(a.found, named_struct('start', a.at + x.`0`, 'end', a.at + x.`0` + x.`1`, 'kind', '{rule.kind}')), a.found)),
        a -> a.found)))"""


def _guard(rule: Rule) -> str:
    """A cheap test that every kept match passes, so that most texts are matched once and never split."""
    if rule.group == 0 and rule.pattern.endswith("+") and rule.min_length:
        head = rule.pattern[: rule.pattern.rindex("[")]
        least = max(1, rule.min_length - sum(1 for _ in _parser.parse(head))) if head else rule.min_length
        return f"{rule.pattern[:-1]}{{{least},}}" if "\\" not in rule.pattern and (not head or head.isalnum()) else rule.pattern
    return rule.pattern


_EMPTY = "cast(array() as array<struct<start: bigint, end: bigint, kind: string>>)"


def find_spans(rows: DataFrame, text: str, rules: list[Rule], allowed: Column | None = None) -> DataFrame:
    """Add one column _s_<kind> for each rule; allowed: names of the rules to verify on a row (null: all)."""
    for r in rules:
        may = F.col(text).rlike(_guard(r)) if allowed is None else F.coalesce(F.array_contains(allowed, r.kind), F.lit(False))
        m, c, b = (f"_{x}_{r.kind}" for x in "mcb")
        rows = rows.withColumn(m, F.when(may, F.expr(_matches(r, text)))).withColumn(c, F.expr(f"if({m} is null, null, {_chunks(m)})"))
        length = "aggregate(c, 0L, (a, x) -> a + x.`0` + coalesce(x.`1`, 0))"
        rows = rows.withColumn(b, F.expr(f"if({m} is null, null, {_running(c, length, 's.now + v')})"))
        rows = rows.withColumn(f"_s_{r.kind}", F.expr(f"if({m} is null, {_EMPTY}, {_spans(r, m, c, b)})")).drop(m, c, b)
    return rows


def scan(docs: DataFrame, rules: list[Rule] | None = None, bound: int = BROADCAST_ROWS, into: str = "found") -> DataFrame:
    """docs (doc_id, text, ...) plus the column `into` (one of that name is replaced): array<struct<start,end,kind>> ordered by start, then as the rules are listed.

    The candidates are counted: up to `bound` of them are broadcast, more are joined by a shuffle on doc_id."""
    rules = RULES if rules is None else rules
    queries = _queries(rules)
    indexed, full = [r for r in rules if queries[r.kind]], [r for r in rules if not queries[r.kind]]
    base = docs.select(F.struct("*").alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = base
    if indexed:
        asked = rarest(base, {r.kind: queries[r.kind] for r in indexed})
        grams = sorted(set().union(*[c for q in asked.values() for c in q]))
        found = durable(candidates(postings(base, grams), asked)).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
        out = join_measured(out, found, F.col("doc_id").eqNullSafe(F.col("_id")), "left", bound=bound).drop("_id")
        out = find_spans(out, "text", indexed, F.col("_rules")).drop("_rules")
    out = find_spans(out, "text", full)
    order = {r.kind: i for i, r in enumerate(rules)}
    ranked = [F.transform(f"_s_{r.kind}", lambda x, i=order[r.kind]: F.struct(x.start.alias("start"), F.lit(i).alias("rank"), x.end.alias("end"), x.kind.alias("kind"))) for r in rules]
    joined = F.transform(F.array_sort(F.concat(*ranked)), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind")))
    return out.select(joined.alias("_found"), *[F.col(f"doc.{c}") for c in docs.columns if c != "_found"]).withColumn(into, F.col("_found")).select(*[c for c in docs.columns if c != into], into)


def digest(found: Column | str) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]", column: str = "found") -> DataFrame:
    """Replace what the scan found by a mark; overlapping spans become one. n_chars follows where it exists."""
    names = [f"{column}{x}" for x in ("_chunks", "_begins")]
    chunks, begins = names
    out = scanned.withColumn(chunks, F.expr(f"if(size({column}) > 0, {_chunks(column)}, null)"))
    reach = "aggregate(c, 0L, (a, x) -> greatest(a, x.end))"
    out = out.withColumn(begins, F.expr(f"if({chunks} is null, null, {_running(chunks, reach, 'greatest(s.now, v)')})"))
    # A chunk's part of the text is cut once; its spans cut that part.
    part = f"substring(text, cast(b + 1 as int), cast(greatest({reach.replace('(c,', '(m,')}, b) - b as int))"
    step = f"""aggregate(m, named_struct('at', b, 'out', '', 'part', {part}),
        (a, x) -> case when x.end <= a.at then a
            when x.start < a.at then named_struct('at', x.end, 'out', a.out, 'part', a.part)
            else named_struct('at', x.end, 'out', concat(a.out, substring(a.part, cast(a.at - b + 1 as int), cast(x.start - a.at as int)), '{mark}'), 'part', a.part) end,
        a -> a.out)"""
    last = f"aggregate({column}, 0L, (a, x) -> greatest(a, x.end))"
    redacted = f"concat(array_join(zip_with({chunks}, {begins}, (m, b) -> {step}), ''), substring(text, cast({last} + 1 as int)))"
    out = out.withColumn("text", F.expr(f"if({chunks} is null, text, {redacted})")).drop(*names)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(scanned.schema["n_chars"].dataType))
    return out.drop(column)


def mask(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with every secret replaced by a mark; all rows and columns stay."""
    name = "spans"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return redact(scan(docs, rules, into=name), column=name).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RULES
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    base = [r.kind for r in rules if r.base]
    of = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(digest(F.filter("found", lambda x: x.kind.isin(*base))), 256).alias("base_sha256"),
        digest("found").alias("spans"),
    )

"""Quality rules as a short-circuit cascade, in built-in column functions only.

Every rule is a rejecting predicate over statistics of the whole text. `plan_cascade` estimates each rule's cost (its work on a
row, in characters read, from weights of its operators) and selectivity on a bounded sample, in one pass, and orders the rules by
rejection per cost, so that one sample gives one order; `verdict` nests them in that order, so that a row's later rules are not
evaluated once one rejects it. Where only the verdict is wanted (`keep_passing`), the dearest statistic, repeated windows, is last
and is computed only for rows that pass everything else. The order changes the work, never the verdict.

Defined results: a null text counts as one without words; an empty or blank text has zeros everywhere and fails
`base_failed`; repeated rows are scored each on its own; an empty table gives an empty result. Input columns other than the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the contract.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Expected rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1500
#: Bits of a window's place in its sort key; texts of more words take LONG_PLACE bits, which any array's places fit in.
PLACE, LONG_PLACE = 24, 31


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def _bits() -> str:
    return f"if(size(_words) < {1 << PLACE}, {PLACE}, {LONG_PLACE})"


def with_windows(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Add _keys: for every 3-word window one long, the upper bits of its hash above its place; sorted. Null where not wanted."""
    pack = f"shiftleft(shiftright(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), {_bits()}), {_bits()}) | cast(i as bigint)"
    keys = F.expr(f"sort_array(slice(transform(_words, (w, i) -> {pack}), 1, greatest(size(_words) - 2, 0)))")
    return df.withColumn("_keys", keys if wanted is None else F.when(wanted, keys))


def with_repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words. Windows whose hash bits meet are compared as words; places of equal ones are merged in order."""
    same = f"shiftright(x ^ get(_keys, i + 1), {_bits()}) = 0 or shiftright(x ^ get(_keys, i - 1), {_bits()}) = 0"
    at = f"cast(x & (shiftleft(1L, {_bits()}) - 1) as int)"
    window = f"named_struct('s', concat_ws(' ', get(_words, {at}), get(_words, {at} + 1), get(_words, {at} + 2)), 'at', {at})"
    df = df.withColumn("_near", F.expr(f"filter(_keys, (x, i) -> coalesce({same}, false))"))
    df = df.withColumn("_sorted", F.expr(f"case when size(_near) > 0 then sort_array(transform(_near, x -> {window})) end"))
    equal = "coalesce(x.s = get(_sorted, i + 1).s, false) or coalesce(x.s = get(_sorted, i - 1).s, false)"
    df = df.withColumn("_places", F.expr(f"case when _sorted is not null then sort_array(transform(filter(_sorted, (x, i) -> {equal}), x -> x.at)) end"))
    covered = "aggregate(transform(_places, (p, i) -> least(coalesce(get(_places, i + 1) - p, 3), 3)), 0L, (a, x) -> a + x)"
    return df.withColumn("n_repeat_words", F.expr(f"coalesce(case when _places is not null then {covered} end, 0L)"))


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None, gate: Column | None = None) -> DataFrame:
    """One row per document with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helpers (_text, _words). gate: over
    the others, of the rows for which n_repeat_words is wanted; elsewhere it is 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c) for c in (keep if keep is not None else ["doc_id"])], t.alias("_text"))
    df = df.withColumn("_words", _words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    size = lambda c: F.length(c).cast("long")
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": size(F.translate("_text", SPACE_CHARS, "")),
        "n_symbols": size(F.col("_text")) - size(F.translate("_text", SYMBOLS, "")),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = df.withColumn("_keys_wanted", F.lit(True) if gate is None else gate)
    df = with_repeats(with_windows(df, None if gate is None else F.col("_keys_wanted")))
    return df.select(*(keep if keep is not None else ["doc_id"]), "_keys_wanted", "_text", "_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Weights of operators for each character: a comparison of statistics, splitting, hashing words, replacing by a pattern.
COMPARE, SPLIT, DISTINCT, REPLACE = 0.01, 1.0, 2.0, 4.0


@dataclass(frozen=True)
class Rule:
    """rejects: the predicate; work: characters that it reads on a row, times the weight of the operator that reads them."""

    name: str
    rejects: Column
    work: Column | None = None  # that of a comparison


def default_rules() -> list[Rule]:
    """The method's own rules. Thresholds are wide: a rule names junk, not a style."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    letters = F.length(F.regexp_replace("_text", r"[^\p{L}]+", ""))
    read = lambda weight: F.length("_text") * F.lit(weight)
    return [
        Rule("symbols", F.col("n_symbols") > 0.10 * c, F.lit(COMPARE)),
        Rule("mean_word_length", (F.col("word_chars") > 30 * n) | (F.col("word_chars") < 2 * n), F.lit(2 * COMPARE)),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.size(F.split("_text", "\n", -1))), F.when(F.col("n_dup_lines") >= 3, read(SPLIT)).otherwise(COMPARE)),
        Rule("few_letters", letters < 0.5 * c, read(REPLACE)),
        Rule("shouting", F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")) > 0.6 * c, read(REPLACE)),
        Rule("few_distinct_words", F.size(F.array_distinct("_words")) < 0.08 * F.least(n, F.lit(1000)), read(DISTINCT)),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.cost, 1e-6)


def plan_cascade(stats: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Work and selectivity of each rule over the rows of stats, a sample, in one job; best rejection per cost first, ties as listed."""
    found = stats.agg(F.count("*"), *[F.count_if(r.rejects) for r in rules], *[F.coalesce(F.sum(F.lit(COMPARE) if r.work is None else r.work), F.lit(0.0)) for r in rules]).first()
    total, k = max(found[0], 1), len(rules)
    out = [Estimate(r, float(found[1 + k + i]) / total, found[1 + i] / total) for i, r in enumerate(rules)]
    return sorted(out, key=lambda m: (-m.rank, m.cost))


def verdict(cascade: list[Estimate]) -> Column:
    """Name of the first rule in cascade order that rejects the row, else null. CASE stops at the first true branch."""
    out = F.when(F.col("n_words") < MIN_WORDS, F.lit("base"))
    for m in cascade:
        out = out.when(F.coalesce(m.rule.rejects, F.lit(False)), F.lit(m.rule.name))
    return out


def _sampled(docs: DataFrame, rules: list[Rule]) -> list[Estimate]:
    # A fraction of every partition, so that nothing is shuffled to draw it; about SAMPLE_ROWS rows at any table size.
    some = docs.sample(min(1.0, SAMPLE_ROWS / max(docs.count(), 1)), seed=11)
    return plan_cascade(statistics(some, keep=[], gate=F.lit(False)), rules)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Statistics, base_failed and kept for each row of docs."""
    keep = keep if keep is not None else ["doc_id"]
    cascade = _sampled(docs, default_rules() if rules is None else rules)
    df = statistics(docs, keep=keep).withColumn("_rejected", F.when(base_failed(), F.lit("base")).otherwise(verdict(cascade)))
    # A filter on these columns must not be pushed below the statistics, where it would repeat them within their own lambdas; it
    # is not pushed past an expression that numbers rows.
    here = F.monotonically_increasing_id() >= 0
    repeats = F.when(here, F.col("n_repeat_words")).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats, base_failed().alias("base_failed"), (F.col("_rejected").isNull() & here).alias("kept"))


def keep_passing(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, as they came. Repeated windows are looked for in rows that all other rules pass."""
    rows = docs.select(F.struct("*").alias("doc"), "text")  # one column, so that no name of docs can clash
    cascade = _sampled(rows, default_rules() if rules is None else rules)
    passes = verdict(cascade).isNull()
    df = statistics(rows, keep=["doc"], gate=passes)
    here = F.monotonically_increasing_id() >= 0
    return df.select("doc", (F.col("_keys_wanted") & ~base_failed() & here).alias("kept")).where("kept").select("doc.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Rules around the pipeline: states and their moves, gates, gaps, replies, payloads and small reads, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of each machine; the one that is never left, where there is one; machines whose moves are listed.
STATES = {
    "parse_status": ["pending", "parsed", "quarantined", "failed"],
    "extract_status": ["pending", "extracted", "quarantined", "failed"],
    "embed_status": ["pending", "embedded", "failed"],
    "index_status": ["pending", "indexed", "failed"],
    "chunk": ["pending", "embedded", "indexed", "failed"],
    "draft": ["draft", "acknowledged", "lawyer_reviewed"],
}
DONE = {"parse_status": "parsed", "extract_status": "extracted", "embed_status": "embedded", "index_status": "indexed", "chunk": "indexed", "draft": "lawyer_reviewed"}
DRAFT_MOVES = [("draft", "acknowledged"), ("draft", "lawyer_reviewed"), ("acknowledged", "lawyer_reviewed")]
#: Documents that a file should hold, recent payslips, and what is said of those missing.
EXPECTED_TYPES, PAYSLIPS = ["contract", "letter", "correspondence"], 3
NO_DOCUMENTS = "No documents on file — upload the employment contract, termination letter, at least 3 recent payslips, and any correspondence so the analysis has evidence to work from."
NO_NOTICE_DATE = "Missing notice date — no date in notice context found in the evidence; provide the document stating when notice started."
#: Frames of a reply, uploads, the quality gate's least sizes and its tolerance in points.
FRAME_CHARS, SUFFIXES, UPLOAD_BYTES = 600, [".pdf", ".docx", ".txt", ".md"], 20_000_000
PER_BUCKET, SAMPLE, TOLERANCE = 15, 100, 5.0


def _in(c: Column, groups: dict[str, list[str]], key: Column) -> Column:
    return reduce(lambda a, k: a | ((key == k) & c.isin(groups[k])), groups, F.lit(False))


def move(machine: Column, before: Column, after: Column, reviewer: Column) -> Column:
    """same, allowed, or why not: unknown (machine or state), terminal, reviewer (one is required), illegal.

    Any state of a stage or chunk may follow any other but the last one, so that failed ones are tried again."""
    last = F.coalesce(*[F.when(machine == k, F.lit(v)) for k, v in DONE.items()])
    listed = reduce(lambda a, m: a | ((before == m[0]) & (after == m[1])), DRAFT_MOVES, F.lit(False))
    named = F.length(F.trim(F.coalesce(reviewer, F.lit("")))) > 0
    return (
        F.when(~F.coalesce(_in(after, STATES, machine), F.lit(False)), "unknown").when(before == after, "same").when(before == last, "terminal")
        .when((machine == "draft") & (after == "lawyer_reviewed") & ~named, "reviewer").when((machine == "draft") & ~listed, "illegal").otherwise("allowed")
    )


def status_label(state: Column, reviewer: Column) -> Column:
    by = F.coalesce(F.nullif(reviewer, F.lit("")), F.lit("counsel"))
    return (
        F.when(state == "acknowledged", "Acknowledged by user — provisional, verify before use")
        .when(state == "lawyer_reviewed", F.concat(F.lit("Reviewed by "), by, F.lit(" — provisional, verify before use")))
        .otherwise("Draft — provisional, verify before use")
    )


def document_status(review: Column, indexed: Column) -> Column:
    """What ingestion leaves: doubts keep a document out of the index; without the index it waits."""
    return F.when(review, "needs_review").when(indexed, "indexed").otherwise("pending-indexing")


def gaps(matters: DataFrame, sections: DataFrame, dates: DataFrame) -> DataFrame:
    """matter, gap: of matters (matter), sections (matter, doc_type) and dates (matter, label), what is missing."""
    held = sections.groupBy("matter").agg(F.collect_set("doc_type").alias("_types"), F.count_if(F.col("doc_type") == "payslip").alias("_payslips"))
    notice = dates.where("label = 'notice date'").select("matter").distinct().withColumn("_notice", F.lit(True))
    rows = matters.select("matter").distinct().join(held, "matter", "left").join(notice, "matter", "left")
    missing = [F.when(~F.array_contains("_types", t), F.lit(f"Missing {t} — upload the {t} document to complete the file.")) for t in EXPECTED_TYPES]
    slips = F.when(F.col("_payslips") < PAYSLIPS, F.concat(F.lit(f"Missing payslips — {PAYSLIPS} recent payslips expected, only "), F.col("_payslips").cast("string"), F.lit(" on file; upload the missing payslips.")))
    found = F.array_compact(F.array(*missing, slips, F.when(F.col("_notice").isNull(), F.lit(NO_NOTICE_DATE))))
    return rows.select("matter", F.explode(F.when(F.col("_types").isNull(), F.array(F.lit(NO_DOCUMENTS))).otherwise(found)).alias("gap"))


def token_frames(text: Column, size: int = FRAME_CHARS) -> Column:
    """array<string>: one empty frame of an empty text, two halves up to 2 * size characters, equal slices of a longer one."""
    n = F.length(text)
    parts = F.ceil(n / size).cast("int")
    step = F.ceil(n / parts).cast("int")
    half = F.floor(n / 2).cast("int")
    halves = F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, n))
    slices = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))  # one pass, whatever the length
    return F.when(n == 0, F.array(F.lit(""))).when(parts <= 2, halves).otherwise(slices)


def upload_check(name: Column, size: Column) -> Column:
    """ok, unsupported or oversize; a name's suffix is what follows the last dot of its last part."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))
    return F.when(size > UPLOAD_BYTES, "oversize").when(~suffix.isin(SUFFIXES), "unsupported").otherwise("ok")


def any_contains(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    return reduce(lambda a, c: a | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)), columns, F.lit(False))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Null until something is done and after all is."""
    return F.when((done > 0) & (elapsed > 0) & (total > done), (total - done) / (done / elapsed))


def mean_confidence(c: Column) -> Column:
    """Mean of the valid percentages (not negative) as a share from 0 to 1; 0 without any."""
    return F.coalesce(F.least(F.greatest(F.avg(F.when(c >= 0, c)) / 100, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def localized(texts: dict[str, str], lang: Column) -> Column:
    """The text of a language, else the English one."""
    found = F.create_map(*[F.lit(x) for pair in sorted(texts.items()) for x in pair])
    return F.coalesce(F.element_at(found, F.lower(lang)), F.lit(texts["en"]))


def quoted_path(c: Column) -> Column:
    """A path without fragment and leading slash; what an address may not hold is percent-encoded, addresses stay."""
    bare = F.regexp_replace(F.trim(F.element_at(F.split(c, "#"), 1)), "^/", "")
    coded = F.transform(F.split(bare, ""), lambda x: F.when(x.rlike(r"^[A-Za-z0-9_.~/:?=&-]*$"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "utf-8")), "(..)", "%$1")))
    return F.when(bare.startswith("http"), bare).otherwise(F.array_join(coded, ""))


def extract_again(status: Column, index: Column, sha: Column, reason: Column, retriable: list[str]) -> Column:
    """Whether a file is extracted again: not indexed ones that are pending, failed, extracted without a stored sha, or
    quarantined for a reason that may pass."""
    passing = reduce(lambda a, p: a | F.coalesce(reason, F.lit("")).startswith(p), retriable, F.lit(False))
    due = status.isin("pending", "failed") | ((status == "extracted") & (F.coalesce(sha, F.lit("")) == "")) | ((status == "quarantined") & passing)
    return F.coalesce((index != "indexed") & due, F.lit(False))


def gate_buckets(sample: DataFrame, bucket: str) -> DataFrame:
    """bucket, n, dropped: why a bucket of the quality gate does not count (null: it does)."""
    return sample.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("dropped", F.when(F.col("n") < PER_BUCKET, F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(f" < {PER_BUCKET}"))))


def gate_score(hits: DataFrame) -> DataFrame:
    """hits (bucket, new_hit, old_hit: booleans of each query) -> bucket (null: overall), n, recalls, delta in points, pass: the new
    model loses at most TOLERANCE points overall, and the sample is large enough."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = hits.rollup("bucket").agg(F.count("*").alias("n"), share("new_hit").alias("new_recall"), share("old_hit").alias("old_recall"))
    delta = (F.col("new_recall") - F.col("old_recall")) * 100
    enough = F.col("n") >= F.when(F.col("bucket").isNull(), SAMPLE).otherwise(PER_BUCKET)
    return out.select("bucket", "n", F.round("new_recall", 6).alias("new_recall"), F.round("old_recall", 6).alias("old_recall"), F.round(delta, 4).alias("delta_points"), (enough & (F.col("bucket").isNotNull() | (delta >= -TOLERANCE))).alias("pass"))


def same_ids(a: DataFrame, b: DataFrame, order: str, key: str) -> DataFrame:
    """differences: positions at which two captures hold different ids, or only one holds any; 0: they may be compared."""
    joined = a.select(F.col(order).alias("_o"), F.col(key).alias("_a")).join(b.select(F.col(order).alias("_o"), F.col(key).alias("_b")), "_o", "full_outer")
    return joined.agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differences"))


def grouped_numbers(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows numbered from 1 within each group, with the group's size."""
    w = Window.partitionBy(group)
    return rows.withColumn("number", F.row_number().over(w.orderBy(*order))).withColumn("group_size", F.count("*").over(w))


def authority_payload(rows: DataFrame) -> DataFrame:
    """Points with defaults: a page that is no number is 0, a missing chunk_id is the id, missing texts are empty."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("source", "version", "edition", empty("language"), empty("text"), F.coalesce(F.expr("try_cast(page as int)"), F.lit(0)).alias("page"), F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), F.col("id"), F.lit("")).alias("chunk_id"), empty("category"), empty("file_sha"))


def nested_digest(rows: DataFrame, group: str, order: str, line: Column, width: int = 4096, levels: int = 3) -> DataFrame:
    """group, fingerprint: SHA-256 over a group's lines in order, by blocks of `width` numbers of `order`, `levels` deep: no row holds
    more than `width` lines of one level but the last."""
    now = rows.select(group, F.col(order).alias("_o"), F.sha2(line, 256).alias("_x"))
    for level in range(levels + 1):
        last = level == levels
        key = [group] if last else [group, F.floor(F.col("_o") / width).alias("_b")]
        now = now.groupBy(*key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_x"))), lambda x: x["_x"]), "\n"), 256).alias("_x"))
        now = now if last else now.withColumnRenamed("_b", "_o")
    return now.select(group, F.col("_x").alias("fingerprint"))

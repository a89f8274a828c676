"""Queries of the rules around the pipeline. The SQL states the rules in its own words; it takes nothing from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as A
from ..operators import structure as S
from ..operators import workflow as W
from .base import DOC_TYPES, inline, ledger, query, read
from .beside import FILES, MOVES, PATHS, UPLOADS
from .fixtures import MESSAGES, SECTIONS

_REPLIES = {"en": "Hello! Ask a question.", "fr": "Bonjour ! Posez une question.", "ar": "مرحباً! اطرح سؤالاً."}


def _matters(spark, sf_dir):
    """Documents as sections of matters: a hundred documents are a matter, their sizes stand for their types."""
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("matter"), F.expr(DOC_TYPES).alias("doc_type"), "doc_id", "n_chars")
    own = inline(spark, SECTIONS).select((-F.col("matter")).alias("matter"), "doc_type", "section", F.lit(0).cast("long"))
    return d.unionByName(own.toDF("matter", "doc_type", "doc_id", "n_chars"))


_MATTERS = f"(select doc_id // 100 as matter, {DOC_TYPES} as doc_type, doc_id, n_chars from documents union all select -matter, doc_type, section, 0 from {SECTIONS.sql})"


# ---- states


@query(f"""select id, case
    when machine = 'draft' and after not in ('draft', 'acknowledged', 'lawyer_reviewed') then 'unknown'
    when machine = 'chunk' and after not in ('pending', 'embedded', 'indexed', 'failed') then 'unknown'
    when machine = 'parse_status' and after not in ('pending', 'parsed', 'quarantined', 'failed') then 'unknown'
    when machine = 'extract_status' and after not in ('pending', 'extracted', 'quarantined', 'failed') then 'unknown'
    when machine = 'embed_status' and after not in ('pending', 'embedded', 'failed') then 'unknown'
    when machine = 'index_status' and after not in ('pending', 'indexed', 'failed') then 'unknown'
    when machine not in ('draft', 'chunk', 'parse_status', 'extract_status', 'embed_status', 'index_status') then 'unknown'
    when before = after then 'same'
    when (machine, before) in (('draft', 'lawyer_reviewed'), ('chunk', 'indexed'), ('parse_status', 'parsed'), ('extract_status', 'extracted'), ('embed_status', 'embedded'), ('index_status', 'indexed')) then 'terminal'
    when machine = 'draft' and after = 'lawyer_reviewed' and trim(coalesce(reviewer, '')) = '' then 'reviewer'
    when machine = 'draft' and (before, after) not in (('draft', 'acknowledged'), ('draft', 'lawyer_reviewed'), ('acknowledged', 'lawyer_reviewed')) then 'illegal'
    else 'allowed' end as verdict from {MOVES.sql}""")
def transition_check(spark, sf_dir):
    return MOVES.rows(spark, sf_dir).select("id", W.move(F.col("machine"), F.col("before"), F.col("after"), F.col("reviewer")).alias("verdict"))


@query("""select doc_id, case quality when 1 then 'Acknowledged by user — provisional, verify before use' when 0 then 'Reviewed by ' || case when toxic = 1 then 'counsel' else 'r' || doc_id end || ' — provisional, verify before use'
    else 'Draft — provisional, verify before use' end as label from documents left join labels using (doc_id)""")
def status_labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "acknowledged").when(F.col("quality") == 0, "lawyer_reviewed").otherwise("draft")
    return d.select("doc_id", W.status_label(state, F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("r"), F.col("doc_id").cast("string")))).alias("label"))


@query("select doc_id, case when n_chars < 60 then 'needs_review' when v.vec_id is not null then 'indexed' else 'pending-indexing' end as status from documents left join (select distinct vec_id from embeddings) v on vec_id = doc_id")
def document_status(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct().withColumn("_in", F.lit(True))
    return read(spark, sf_dir, "documents").join(v, "doc_id", "left").select("doc_id", W.document_status(F.col("n_chars") < 60, F.col("_in").isNotNull()).alias("status"))


@query("select event_type as kind, arg_max(case when value < 10 then 'failed' when value < 20 then 'rolled-back' else 'done' end, event_id) as status, max(event_id) as run from events group by 1")
def latest_run(spark, sf_dir):
    """The last entry of each kind in an append-only log of runs."""
    e = read(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") < 10, "failed").when(F.col("value") < 20, "rolled-back").otherwise("done"))
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.max_by("status", "event_id").alias("status"), F.max("event_id").alias("run"))


@query(f"""select id from {FILES.sql} where index_status <> 'indexed' and (status in ('pending', 'failed') or (status = 'extracted' and coalesce(sha, '') = '') or (status = 'quarantined' and (reason like 'worker-crash%' or reason like 'timeout%')))""")
def extract_again(spark, sf_dir):
    due = W.extract_again(F.col("status"), F.col("index_status"), F.col("sha"), F.col("reason"), ["worker-crash", "timeout"])
    return FILES.rows(spark, sf_dir).where(due).select("id")


# ---- gaps, frames, replies


@query(f"""with s as {_MATTERS}, m as (select distinct matter from s union select -99), n as (select matter, count(*) filter (doc_type = 'payslip') as k from s group by 1), d as (select distinct matter from s where doc_type = 'letter' and n_chars > 500)
    select matter, 'No documents on file — upload the employment contract, termination letter, at least 3 recent payslips, and any correspondence so the analysis has evidence to work from.' as gap from m where matter not in (select matter from s)
    union all select n.matter, 'Missing ' || e || ' — upload the ' || e || ' document to complete the file.' from n, (values ('contract'), ('letter'), ('correspondence')) v(e) where not exists (select 1 from s where s.matter = n.matter and s.doc_type = e)
    union all select matter, 'Missing payslips — 3 recent payslips expected, only ' || k || ' on file; upload the missing payslips.' from n where k < 3
    union all select matter, 'Missing notice date — no date in notice context found in the evidence; provide the document stating when notice started.' from n where matter not in (select matter from d)""")
def gaps(spark, sf_dir):
    s = _matters(spark, sf_dir)
    matters = s.select("matter").unionByName(spark.createDataFrame([(-99,)], "matter long"))
    dates = s.where("doc_type = 'letter' and n_chars > 500").select("matter", F.lit("notice date").alias("label"))
    return W.gaps(matters, s.select("matter", "doc_type"), dates)


@query("""with c as (select conv_id, turn, coalesce(text, '') as t, length(coalesce(text, '')) as n, greatest(ceil(length(coalesce(text, '')) / 600.0), 1)::bigint as parts from conversations where role = 'assistant'),
    x as (select *, case when n = 0 then 1 when parts <= 2 then 2 else ceil(n / ceil(n / parts::double))::bigint end as frames, case when parts <= 2 then n // 2 else ceil(n / parts::double)::bigint end as step from c)
    select conv_id, turn, i as seq, case when n = 0 then '' when parts <= 2 and i = 0 then substr(t, 1, step) when parts <= 2 then substr(t, step + 1) else substr(t, i * step + 1, step) end as token from (select *, unnest(range(frames)) as i from x)""")
def token_batches(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.posexplode(W.token_frames(F.coalesce("text", F.lit("")))).alias("seq", "token")).withColumn("seq", F.col("seq").cast("long"))


_FRAMES = """select conv_id, turn, 0 as phase, 0 as seq, 'data: {"type":"status"}' || chr(10) || chr(10) as frame from conversations where role = 'assistant'
    union all select conv_id, turn, 1, 0, 'data: {"type":"citations"}' || chr(10) || chr(10) from conversations where role = 'assistant'
    union all select conv_id, turn, 9, 0, 'data: {"type":"done"}' || chr(10) || chr(10) from conversations where role = 'assistant'"""


@query(_FRAMES)
def frame_heads(spark, sf_dir):
    """What stands around the tokens of each assistant turn: status, citations, done."""
    return sse_frames(spark, sf_dir).where("phase <> 2")


@query()
def sse_frames(spark, sf_dir):
    """Frames of each assistant turn in contract order: status, citations, tokens, done."""
    t = token_batches(spark, sf_dir)
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    head = turns.select("conv_id", "turn", F.explode(F.array(F.lit("status"), F.lit("citations"), F.lit("done"))).alias("type"))
    head = head.select("conv_id", "turn", F.when(F.col("type") == "status", 0).when(F.col("type") == "citations", 1).otherwise(9).alias("phase"), F.lit(0).cast("long").alias("seq"), F.to_json(F.struct("type")).alias("frame"))
    body = t.select("conv_id", "turn", F.lit(2).alias("phase"), "seq", F.to_json(F.struct(F.lit("token").alias("type"), F.col("token").alias("text"))).alias("frame"))
    return head.unionByName(body).select("conv_id", "turn", "phase", "seq", F.concat(F.lit("data: "), "frame", F.lit("\n\n")).alias("frame"))


@query(f"select doc_id, case lang when 'fr' then '{_REPLIES['fr']}' when 'ar' then '{_REPLIES['ar']}' else '{_REPLIES['en']}' end as reply from documents")
def localized_reply(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", W.localized(_REPLIES, F.col("lang")).alias("reply"))


@query("""select source, count(*) || ' passage(s) des documents du dossier ont été analysés.' || chr(10) || count(*) filter (n_chars < 60) || ' point(s) à examiner ont été relevés.' || case when count(*) filter (n_chars % 5 = 0) > 0 then chr(10) || 'Documents manquants (' || count(*) filter (n_chars % 5 = 0) || ') : voir la liste des lacunes.' else '' end as summary_fr from documents group by 1""")
def summaries(spark, sf_dir):
    """The counted lines of a matter's plain summary."""
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 60).alias("i"), F.count_if(F.col("n_chars") % 5 == 0).alias("g"))
    missing = F.when(F.col("g") > 0, F.format_string("\nDocuments manquants (%d) : voir la liste des lacunes.", "g")).otherwise("")
    return d.select("source", F.concat(F.format_string("%d passage(s) des documents du dossier ont été analysés.\n%d point(s) à examiner ont été relevés.", "n", "i"), missing).alias("summary_fr"))


# ---- gates and reads


@query(f"select id, case when size > 20000000 then 'oversize' when regexp_matches(lower(name), '[^./][^/]*\\.(pdf|docx|txt|md)$') then 'ok' else 'unsupported' end as verdict from {UPLOADS.sql}")
def upload_check(spark, sf_dir):
    return UPLOADS.rows(spark, sf_dir).select("id", W.upload_check(F.col("name"), F.col("size")).alias("verdict"))


@query("select doc_id, source, lang from documents where lower(coalesce(source, '')) like '%rc1%' or lower(coalesce(lang, '')) like '%rc1%' or lower(coalesce(text, '')) like '%rc1%'")
def library_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(W.any_contains(["source", "lang", "text"], "RC1")).select("doc_id", "source", "lang")


@query(f"select doc_id, reason from (select d.doc_id, case when d.n_chars < 60 then 'short-text' end as reason from documents d) where reason is not null")
def with_reason(spark, sf_dir):
    return ledger(spark, sf_dir).where("reason is not null").select("doc_id", "reason")


@query("select d.doc_id, d.source, l.quality as version from documents d join labels l using (doc_id)")
def document_versions(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", F.col("quality").alias("version"))


@query("select d.doc_id, f.first_id, f.n_chars < 60 as needs_ocr from documents d left join (select sha256(text) as sha, min(doc_id) as first_id, max(n_chars) as n_chars from documents group by 1) f on f.sha = sha256(d.text)")
def chunk_sources(spark, sf_dir):
    """Each chunk's source file by its content hash, and a flag of that file."""
    d = read(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    files = d.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("n_chars").alias("_n"))
    return d.join(files, "sha", "left").select("doc_id", "first_id", (F.col("_n") < 60).alias("needs_ocr"))


@query("select count(*) as differences from (select row_number() over (order by doc_id) as o, doc_id from documents) a full join (select row_number() over (order by vec_id) as o, vec_id from embeddings) b using (o) where a.doc_id is distinct from b.vec_id")
def capture_parity(spark, sf_dir):
    from pyspark.sql import Window

    a, b = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select("vec_id")
    number = lambda d, c: d.withColumn("o", F.row_number().over(Window.orderBy(c)))
    return W.same_ids(number(a, "doc_id"), number(b, "vec_id").withColumnRenamed("vec_id", "doc_id"), "o", "doc_id")


@query("select event_type, round(coalesce(least(greatest(avg(case when value >= 0 then value end) / 100, 0), 1), 0), 6) as confidence from events group by 1")
def mean_confidence(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(W.mean_confidence(F.col("value")), 6).alias("confidence"))


@query("select doc_id, round(case when n_chars // 3 > 0 and n_chars > n_chars // 3 then (n_chars - n_chars // 3) / ((n_chars // 3) / 2.5::double) end, 6) as eta from documents")
def embed_eta(spark, sf_dir):
    done = F.floor(F.col("n_chars") / 3)
    return read(spark, sf_dir, "documents").select("doc_id", F.round(W.eta_seconds(done, F.col("n_chars"), F.lit(2.5)), 6).alias("eta"))


@query("select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as number, count(*) over (partition by conv_id, role) as group_size from conversations")
def citation_groups(spark, sf_dir):
    """Citations grouped by domain, numbered anew in each; roles stand for domains."""
    c = read(spark, sf_dir, "conversations").withColumn("_g", F.struct("conv_id", "role"))
    return W.grouped_numbers(c, "_g", ["turn"]).select("conv_id", "turn", "role", F.col("number").cast("long").alias("number"), "group_size")


@query("select doc_id, 'stored' as origin from documents where n_chars > 1000 union all select item_id, 'embedded' from benchmark")
def draft_candidates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", F.lit("stored").alias("origin"))
    return d.unionByName(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("embedded").alias("origin")))


@query("select user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda t: not list_contains(list(distinct event_type), t))), ',') as missing from events group by 1")
def missing_tables(spark, sf_dir):
    """What of a required set each group lacks."""
    wanted = F.array(*map(F.lit, ["click", "purchase", "signup", "view"]))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("event_type"))), ",").alias("missing"))


@query("select lang, doc_id, left(text, 250) as excerpt from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 5")
def spot_sample(spark, sf_dir):
    d = W.grouped_numbers(read(spark, sf_dir, "documents"), "lang", ["doc_id"]).where("number <= 5")
    return d.select("lang", "doc_id", F.substring("text", 1, 250).alias("excerpt"))


@query(f"""select id, case when p like 'http%' then p else array_to_string(list_transform(string_split(p, ''), lambda c: case when regexp_matches(c, '^[A-Za-z0-9_.~/:?=&-]*$') then c else regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') end), '') end as url
    from (select id, regexp_replace(trim(string_split(path, '#')[1]), '^/', '') as p from {PATHS.sql})""")
def download_urls(spark, sf_dir):
    return PATHS.rows(spark, sf_dir).select("id", W.quoted_path(F.col("path")).alias("url"))


@query("select lang as bucket, count(*) as n, case when count(*) < 15 then 'n=' || count(*) || ' < 15' end as dropped from documents group by 1")
def gate_buckets(spark, sf_dir):
    """Buckets of the quality gate, over all documents."""
    return W.gate_buckets(read(spark, sf_dir, "documents").withColumnRenamed("lang", "bucket"), "bucket")


@query("""with h as (select lang as bucket, n_chars % 7 > 0 as a, n_chars % 5 > 0 as b from documents), g as (select bucket, count(*) as n, avg(a::int) as x, avg(b::int) as y from h group by rollup (bucket))
    select bucket, n, round(x, 6) as new_recall, round(y, 6) as old_recall, round((x - y) * 100, 4) as delta_points, case when bucket is null then n >= 100 and (x - y) * 100 >= -5.0 else n >= 15 end as pass from g""")
def gate_score(spark, sf_dir):
    h = read(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), (F.col("n_chars") % 7 > 0).alias("new_hit"), (F.col("n_chars") % 5 > 0).alias("old_hit"))
    return W.gate_score(h)


@query("select source, lang as version, 'e1' as edition, coalesce(lang, '') as language, coalesce(text, '') as text, coalesce(try_cast(case when n_chars % 3 = 0 then 'iv' when n_chars % 3 = 1 then n_chars::varchar end as int), 0) as page, case when n_chars % 2 = 0 then 'c' || doc_id else doc_id::varchar end as chunk_id, '' as category, '' as file_sha from documents")
def authority_payload(spark, sf_dir):
    page = F.when(F.col("n_chars") % 3 == 0, "iv").when(F.col("n_chars") % 3 == 1, F.col("n_chars").cast("string"))
    chunk = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).otherwise("")
    none = F.lit(None).cast("string")
    return W.authority_payload(read(spark, sf_dir, "documents").select("source", F.col("lang").alias("version"), F.lit("e1").alias("edition"), F.col("lang").alias("language"), "text", page.alias("page"), chunk.alias("chunk_id"), F.col("doc_id").cast("string").alias("id"), none.alias("category"), none.alias("file_sha")))


@query("select conv_id, coalesce(nullif(max(case when turn = 1 and length(text) < 40 then text end), ''), 'Matter #' || conv_id) as title from conversations group by 1")
def conversation_titles(spark, sf_dir):
    title = F.max(F.when((F.col("turn") == 1) & (F.length("text") < 40), F.col("text")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(title.alias("_t")).select("conv_id", F.coalesce(F.nullif("_t", F.lit("")), F.concat(F.lit("Matter #"), F.col("conv_id").cast("string"))).alias("title"))


_DIGEST = """with l0 as (select source, doc_id as o, sha256(doc_id || ':' || sha256(text)) as x from documents),
    l1 as (select source, o // 4096 as o, sha256(string_agg(x, chr(10) order by o)) as x from l0 group by 1, l0.o // 4096),
    l2 as (select source, o // 4096 as o, sha256(string_agg(x, chr(10) order by o)) as x from l1 group by 1, l1.o // 4096),
    l3 as (select source, o // 4096 as o, sha256(string_agg(x, chr(10) order by o)) as x from l2 group by 1, l2.o // 4096)
    select source, sha256(string_agg(x, chr(10) order by o)) as fingerprint from l3 group by 1"""


@query(_DIGEST)
def fingerprint(spark, sf_dir):
    """A fingerprint of each source's documents in order, by nested blocks."""
    d = read(spark, sf_dir, "documents")
    return W.nested_digest(d, "source", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)))


@query()
def batch_plan(spark, sf_dir):
    """Batches for the embedder, planned within blocks of a source's documents, so that no row holds a whole source."""
    d = read(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 4096).alias("block"))
    return d.agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("d")).select("source", "block", T.batch_plan(F.transform("d", lambda x: x.n_chars)).alias("batches"))


# ---- texts


@query()
def section_children(spark, sf_dir):
    """Each document as one section, and the parts of those over 2,000 characters."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    return S.children(d.select(F.col("doc_id").alias("doc"), F.lit("s1").alias("section"), F.col("source").alias("title"), "text", F.lit(0).alias("start")))


@query()
def nfkc_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", T.nfkc(F.col("text")).alias("normalized"))
    return d.select("doc_id", F.sha2("normalized", 256).alias("digest"), (F.col("text") != F.col("normalized")).alias("changed"))


@query(f"""with m as (select text, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~،؟؛«»‹›…—–]+', ' ', 'g'), '\\s+', ' ', 'g')) as t from (select text from {MESSAGES.sql} union all select text from conversations))
    select text, case when t in ('bonjour', 'salut', 'merci', 'bonsoir', 'qui etes vous', 'qui êtes vous') then 'fr' when t in ('سلام', 'مرحبا', 'مرحباً', 'شكرا', 'شكراً', 'السلام عليكم', 'سلام عليكم', 'من انت', 'من أنت') then 'ar'
    when t in ('hello', 'hi', 'hey', 'hello there', 'thanks', 'thank you', 'who are you', 'what are you', 'good morning', 'good afternoon', 'good evening') then 'en' end as lang from m""")
def greeting_langs(spark, sf_dir):
    m = inline(spark, MESSAGES).select("text").unionByName(read(spark, sf_dir, "conversations").select("text"))
    return m.select("text", A.greeting_lang(F.col("text")).alias("lang"))

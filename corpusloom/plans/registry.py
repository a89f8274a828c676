"""Queries over the driver's tables, each beside the SQL that states it. Inline fixtures are the same literals on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as A
from ..operators import relational as R
from ..operators import retrieval as H
from ..operators import serving as V
from ..operators import structure as S
from .base import DOC_TYPES, ORACLE_SQL, QUERIES, inline, ledger, query, read  # noqa: F401
from .beside import AUTHORITY_FILES, CITATIONS, EDGES, HEADINGS, MESSAGES, PAGED, PAGES, PRIVACY, SPANS, TOOL_TEXTS
from .fixtures import SECTIONS

# ---- fragments of SQL

_TOKENS = f"select doc_id, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) as token from documents"
_TF = "select {key}, ('0x' || substr(sha256(token), 1, 8))::bigint % 2048 as idx, count(*) as tf from ({tokens}) group by 1, 2"
_DOC_TF = _TF.format(key="doc_id", tokens=_TOKENS)
_ITEM_TF = _TF.format(key="item_id", tokens=f"select item_id, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) as token from benchmark")
_LEDGER = """(select d.doc_id, d.source as category, d.lang as edition, sha256(d.text) as sha, d.n_chars,
    case when d.n_chars < 60 then 'quarantined' else 'parsed' end as parse_status,
    case when d.n_chars < 60 then 'short-text' end as reason,
    case when l.quality is not null then 'extracted' when d.n_chars < 60 then 'quarantined' else 'pending' end as extract_status,
    case when l.quality = 1 then 'embedded' when l.quality = 0 then 'failed' else 'pending' end as embed_status,
    case when l.toxic = 0 and l.quality = 1 then 'indexed' else 'pending' end as index_status,
    case when l.quality = 1 then d.n_chars // 1000 + 1 else 0 end as chunk_count,
    case when l.toxic = 0 and l.quality = 1 then d.n_chars // 1000 + 1 else 0 end as indexed_count
    from documents d left join labels l using (doc_id))"""


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


# ---- retrieval


@query(_DOC_TF)
def tf_hash_vectors(spark, sf_dir):
    return H.tf_vectors(read(spark, sf_dir, "documents"), "doc_id")


_LEX = f"""select q.item_id as query, d.doc_id as id, sum(q.tf * d.tf)::double as score from ({_ITEM_TF}) q
    join ({_DOC_TF}) d using (idx) join documents s on s.doc_id = d.doc_id where {{where}} group by 1, 2"""
_TOP = "select * from (select *, row_number() over (partition by query order by score desc, id)::int as rank from ({scores})) where rank <= {k}"


@query(_TOP.format(scores=_LEX.format(where="true"), k=10))
def lexical_topk(spark, sf_dir):
    """The search without a tenant, over all documents."""
    return H.lexical_topk(_items(spark, sf_dir), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 10)


def _owned(spark, sf_dir):
    """id, text, source: the documents that have a source, which is their tenant."""
    return H.tenants(read(spark, sf_dir, "documents"), "source").select(F.col("doc_id").alias("id"), "text", "source")


_TOP_TENANTS = "select * from (select *, row_number() over (partition by query, source order by score desc, id)::int as rank from ({scores})) where rank <= {k}"
_LEX_TENANTS = f"""select q.item_id as query, s.source, d.doc_id as id, sum(q.tf * d.tf)::double as score from ({_ITEM_TF}) q
    join ({_DOC_TF}) d using (idx) join documents s on s.doc_id = d.doc_id where s.source <> '' group by 1, 2, 3"""


@query(_TOP_TENANTS.format(scores=_LEX_TENANTS, k=10))
def lexical_topk_tenants(spark, sf_dir):
    """lexical_topk for every source, each within its own documents."""
    return H.lexical_topk(_items(spark, sf_dir), _owned(spark, sf_dir), 10, "source")


_NORMED = "select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings"
_DENSE = f"select q.vec_id as query, d.vec_id as id, round(case when q.n * d.n = 0 then 0 else list_dot_product(q.v, d.v) / (q.n * d.n) end, 6) as score from ({_NORMED}) q, ({_NORMED}) d where {{where}}"


@query(_TOP.format(scores=_DENSE.format(where="q.vec_id % 50 = 0"), k=10))
def dense_topk_cosine(spark, sf_dir):
    """The stated query set: every row whose id is divisible by 50, against all rows."""
    v = _vectors(spark, sf_dir)
    return H.dense_topk(v.where("id % 50 = 0").select(F.col("id").alias("query"), "vector"), v, 10)


def _hybrid_sql(where: str, k: int = 10) -> str:
    dense = _TOP.format(scores=_DENSE.format(where=f"q.vec_id in (select item_id from benchmark) and d.vec_id in (select s.doc_id from documents s where {where})"), k=30)
    lexical = _TOP.format(scores=_LEX.format(where=where), k=30)
    fused = f"select query, id, round(sum(1.0::double / (60 + rank)), 6) as score, count(*) as legs from (select query, id, rank from ({dense}) union all select query, id, rank from ({lexical})) group by 1, 2"
    return _TOP.format(scores=fused, k=k)


def _hybrid_tenants_sql(k: int = 10) -> str:
    scored = _DENSE.format(where="q.vec_id in (select item_id from benchmark)")
    dense = _TOP_TENANTS.format(scores=f"select v.*, s.source from ({scored}) v join documents s on s.doc_id = v.id where s.source <> ''", k=30)
    lexical = _TOP_TENANTS.format(scores=_LEX_TENANTS, k=30)
    ranks = f"select query, source, id, rank from ({dense}) union all select query, source, id, rank from ({lexical})"
    return _TOP_TENANTS.format(scores=f"select query, source, id, round(sum(1.0::double / (60 + rank)), 6) as score, count(*) as legs from ({ranks}) group by 1, 2, 3", k=k)


def _hybrid(spark, sf_dir, docs, within=None):
    queries = _items(spark, sf_dir).join(_vectors(spark, sf_dir).withColumnRenamed("id", "query"), "query", "left")
    return H.hybrid(queries, docs, _vectors(spark, sf_dir), within=within)


@query(_hybrid_sql("true"))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"select 'matter' as domain, query, source, id, score, legs, rank from ({_hybrid_tenants_sql()}) union all select 'authority', query, null, id, score, legs, rank from ({_hybrid_sql("true")})")
def hybrid_both_domains(spark, sf_dir):
    """Matter evidence within every source, authorities over all documents."""
    matter = _hybrid(spark, sf_dir, _owned(spark, sf_dir), "source").withColumn("domain", F.lit("matter"))
    return matter.unionByName(hybrid_rrf(spark, sf_dir).withColumns({"domain": F.lit("authority"), "source": F.lit(None).cast("string")}))


_QV = "select a.vec_id, a.label, list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double + 0.5 * x[2]::double) as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 50 = 0"
_RECALL = f"""with q as (select *, sqrt(list_dot_product(v, v)) as n from ({_QV})), d as (select * from ({_NORMED}) x where x.vec_id in (select vec_id from q)),
    s as (select q.vec_id as query, d.vec_id as id, q.label = e.label as same, round(list_dot_product(q.v, d.v) / (q.n * d.n), 6) as score from q, d join embeddings e on e.vec_id = d.vec_id),
    r as (select s.query, 1 + count(*) filter (s.score > g.score) as rank, 1 + count(*) filter (s.score > g.score and s.same) as rank_in from s join s g on g.query = s.query and g.id = g.query group by 1),
    b as (select r.*, e.label as bucket from r join embeddings e on e.vec_id = r.query)
    select bucket, count(*) as n, round(avg((rank_in <= 10)::int), 6) as recall from b group by 1 union all select null, count(*), round(avg((rank <= 10)::int), 6) from b having count(*) > 0"""


@query(_RECALL)
def self_retrieval_recall(spark, sf_dir):
    """The sample are the stated queries' own rows: a bucket ranks within itself, the whole within the sample."""
    e = read(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    q = e.where("vec_id % 50 = 0").join(nxt, "vec_id").select(F.col("vec_id").alias("query"), F.zip_with("embedding", "other", lambda x, y: x.cast("double") + 0.5 * y.cast("double")).alias("vector"))
    sample = e.join(q.select(F.col("query").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"))
    return H.recall_at_k(q, sample, 10)


@query("""with p as (select list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) as c
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select round(avg(c), 6) as mean_cosine, round(min(c), 6) as min_cosine, count(*) as n, avg(c) >= 0.99 as passed from p""")
def parity_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    c = pairs.select(H.cosine(F.col("embedding"), F.col("other")).alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.min("c"), 6).alias("min_cosine"), F.count("*").alias("n"), (F.avg("c") >= 0.99).alias("passed"))


@query()
def mmr_select(spark, sf_dir):
    docs = _owned(spark, sf_dir)
    top = H.lexical_topk(_items(spark, sf_dir), docs, 30, "source")
    return H.mmr(top.join(docs, ["source", "id"]).select("query", "source", "rank", "id", "text"), 10, within="source")


_WORDS = "regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"


@query(f"""with s as (select d.doc_id, case when n_chars < 600 then 'short' when n_chars <= 1300 then 'medium' else 'long' end || '|flag=' || case when toxic = 1 then 'yes' else 'no' end as bucket,
        len({_WORDS}) as n from documents d left join labels l using (doc_id)),
    b as (select *, row_number() over (partition by bucket order by doc_id) as k, count(*) over (partition by bucket) as size from s where n >= 65)
    select doc_id, bucket from b where size >= 15 and k <= 40""")
def stratified_sample(spark, sf_dir):
    """At most 40 rows of each bucket (the feature), none of a bucket of under 15."""
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    bucket = F.concat(T.length_class(F.col("n_chars")), F.lit("|flag="), F.when(F.col("toxic") == 1, "yes").otherwise("no"))
    rows = d.where(T.middle_query(F.col("text")).isNotNull()).select("doc_id", bucket.alias("bucket"))
    w = Window.partitionBy("bucket")
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy("doc_id")), "size": F.count("*").over(w)})
    return rows.where("size >= 15 and k <= 40").select("doc_id", "bucket")


# ---- identity and deduplication


@query("with w as (select sha256(text) as sha, min(doc_id) as winner from documents group by 1) select doc_id, winner, doc_id <> winner as is_duplicate from documents join w on sha256(text) = sha")
def content_dedup(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return R.content_dedup(files, "doc_id", "sha")


@query("with w as (select sha256(text) as sha, min(doc_id) as winner, count(*) as copies from documents group by 1) select winner, copies - 1 as duplicates, sha from w where copies > 1")
def dedup_mapping(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("winner"), F.count("*").alias("copies"))
    return d.where("copies > 1").select("winner", (F.col("copies") - 1).alias("duplicates"), "sha")


@query("select doc_id, source || ':v1:' || lang || ':section:' || substr(sha256(text), 1, 16) || ':p' || (doc_id % 7) || ':o' || (doc_id % 3) as chunk_id from documents")
def chunk_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    c = T.chunk_id(F.col("source"), F.lit("v1"), F.col("lang"), F.lit(None).cast("string"), F.col("text"), (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 3).cast("string"))
    return d.select("doc_id", c.alias("chunk_id"))


@query(f"""with h as (select doc_id, sha1(unhex('{T.URL_NAMESPACE}') || encode(doc_id || ':' || source)) as h from documents)
    select doc_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (('0x' || substr(h,17,1))::int % 4) + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) as point_id from h""")
def point_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.uuid5_url(F.concat_ws(":", F.col("doc_id").cast("string"), "source")).alias("point_id"))


# ---- text functions


@query("select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as normalized, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) as title from documents")
def normalized_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"), T.title(F.col("text")).alias("title"))


_COUNT = "length(regexp_replace(text, '[^{0}]', '', 'g'))"


@query(f"select doc_id, {_COUNT.format(T.ARABIC)} as arabic, {_COUNT.format(T.HEBREW)} as hebrew, {_COUNT.format(T.LATIN)} as latin from documents")
def script_counts(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.count_chars(t, T.ARABIC).alias("arabic"), T.count_chars(t, T.HEBREW).alias("hebrew"), T.count_chars(t, T.LATIN).alias("latin"))


_FR = ", ".join(f"'{w}'" for w in T.FRENCH_WORDS)


@query(f"""select doc_id, case when {_COUNT.format(T.ARABIC)} > {_COUNT.format(T.LATIN)} then 'ar' when regexp_matches(text, '[{T.FRENCH_ACCENTS}]') then 'fr'
    when list_has_any(list_transform(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda x: lower(x)), [{_FR}]) then 'fr' else 'en' end as detected from documents""")
def detect_lang(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("detected"))


@query(f"select role, text, case when {_COUNT.format(T.ARABIC)} + {_COUNT.format(T.HEBREW)} > {_COUNT.format(T.LATIN)} then 'rtl' else 'ltr' end as direction, case when {_COUNT.format(T.ARABIC)} + {_COUNT.format(T.HEBREW)} > {_COUNT.format(T.LATIN)} then case when {_COUNT.format(T.HEBREW)} > {_COUNT.format(T.ARABIC)} then 'he' else 'ar' end when regexp_matches(lower(text), '[{T.FRENCH_ACCENTS}]') then 'fr' else 'en' end as detected from {MESSAGES.sql}")
def detect_direction(spark, sf_dir):
    direction, lang = T.detect_direction(F.col("text"))
    return MESSAGES.rows(spark, sf_dir).select("role", "text", direction.alias("direction"), lang.alias("detected"))


_SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, chr(32) || chr(10) || chr(9) || chr(13))) > 0)"


@query(f"select doc_id, len(s) as n_sentences, sha256(array_to_string(s, '|')) as digest from (select doc_id, {_SENTENCES} as s from documents)")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query()
def sentence_pack(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.pack(T.sentences(F.col("text"))).alias("pieces"))
    return d.select("doc_id", F.posexplode("pieces").alias("piece", "text"))


@query("select doc_id, len(regexp_split_to_array(trim(text), '\\s+')) + 4 * (length(text) - length(replace(text, chr(10), ''))) as estimate, len(regexp_split_to_array(trim(text), '\\s+')) + 4 * (length(text) - length(replace(text, chr(10), ''))) <= 450 as fits from documents")
def served_budget(spark, sf_dir):
    """A word counter stands in for the injected tokenizer."""
    estimate = T.served_estimate(F.size(F.split(F.trim("text"), r"\s+")), F.col("text")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", estimate.alias("estimate"), (estimate <= T.SERVED_TOKENS).alias("fits"))


@query("select conv_id, turn, replace(replace(text, '\"', ''''), ']', ')') as wire, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) as slug from conversations")
def wire_and_slug(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.wire_safe(F.col("text")).alias("wire"), T.slug(F.col("text")).alias("slug"))


@query("select page_id, regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title', 1) as title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


# ---- relational reads


@query("select conv_id, turn, text from conversations where role = 'user'")
def user_messages(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query("select conv_id, count(*) as message_count, substr(arg_min(text, case when text <> '' then turn end), 1, 120) as preview from conversations group by 1 order by 1 desc limit 50")
def conversation_list(spark, sf_dir):
    return R.conversation_list(read(spark, sf_dir, "conversations"))


_SECTIONS_OF = "(select doc_id, n_chars % 9 as page_end from documents where doc_id % 3 <> 0 union all select doc_id, n_chars % 5 from documents where doc_id % 3 = 1)"


@query(f"select d.doc_id, d.source, count(s.doc_id) as section_count, max(s.page_end) as page_count from documents d left join {_SECTIONS_OF} s using (doc_id) group by 1, 2")
def document_list(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    sections = d.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") % 9).alias("page_end")).unionByName(d.where("doc_id % 3 = 1").select("doc_id", (F.col("n_chars") % 5).alias("page_end")))
    return R.document_list(d.select("doc_id", "source"), sections)


@query("select d.doc_id, case when l.doc_id is null then 'pending' else 'seeded' end as status, coalesce(l.quality, 0) as chunks from documents d left join labels l using (doc_id)")
def coverage_titles(spark, sf_dir):
    state = read(spark, sf_dir, "labels").select("doc_id", "quality").withColumn("_there", F.lit(True))
    return read(spark, sf_dir, "documents").join(state, "doc_id", "left").select("doc_id", F.when(F.col("_there"), "seeded").otherwise("pending").alias("status"), F.coalesce("quality", F.lit(0)).alias("chunks"))


@query("select doc_id, 'not indexed: ' || source as gap from documents where doc_id not in (select doc_id from labels)")
def coverage_gaps(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", F.concat(F.lit("not indexed: "), "source").alias("gap"))


@query("select doc_id, source, greatest((select count(*) from documents) - 200, 0) as truncated from documents order by doc_id limit 200")
def capped_titles(spark, sf_dir):
    """A report of at most 200 titles, with the number left out (the feature)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    left = d.agg(F.greatest(F.count("*") - 200, F.lit(0)).alias("truncated"))
    return d.orderBy("doc_id").limit(200).join(F.broadcast(left))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_per_group(spark, sf_dir):
    return R.latest_per_group(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def latest_order(spark, sf_dir):
    return R.latest_per_group(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


# ---- ledger

_STAGES = ["parse_status", "extract_status", "embed_status", "index_status"]


@query(f"select count(*) as files, count(*) filter (index_status = 'indexed') as indexed, count(*) filter (extract_status = 'extracted') as extracted, count(*) filter (embed_status = 'embedded') as embedded, coalesce(sum(chunk_count), 0)::bigint as chunks, coalesce(sum(indexed_count), 0)::bigint as chunks_indexed from {_LEDGER}")
def ledger_summary(spark, sf_dir):
    n = lambda c, v: F.count_if(F.col(c) == v)
    zero = F.lit(0).cast("long")
    return ledger(spark, sf_dir).agg(F.count("*").alias("files"), n("index_status", "indexed").alias("indexed"), n("extract_status", "extracted").alias("extracted"), n("embed_status", "embedded").alias("embedded"), F.coalesce(F.sum("chunk_count"), zero).alias("chunks"), F.coalesce(F.sum("indexed_count"), zero).alias("chunks_indexed"))


@query(" union all ".join(f"select '{s}' as stage, coalesce(nullif({s}, ''), 'unknown') as status, count(*) as n from {_LEDGER} group by 1, 2" for s in _STAGES))
def stage_counts(spark, sf_dir):
    return R.stage_counts(ledger(spark, sf_dir), _STAGES)


@query(f"select coalesce(nullif(category, ''), 'unparsed') as category, coalesce(nullif(edition, ''), 'unparsed') as edition, count(*) as n from {_LEDGER} group by 1, 2")
def ledger_by_category(spark, sf_dir):
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unparsed")).alias(c)
    return ledger(spark, sf_dir).groupBy(named("category"), named("edition")).agg(F.count("*").alias("n"))


_ELIGIBLE = "(parse_status = 'parsed' or (parse_status = 'quarantined' and coalesce(reason, '') not like 'duplicate-of:%'))"


@query(f"select doc_id from {_LEDGER} where {_ELIGIBLE} and index_status <> 'indexed' and extract_status in ('pending', 'failed')")
def resume_extract(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return rows.where(R.extract_eligible(F.col("parse_status"), F.col("reason")) & (F.col("index_status") != "indexed") & F.col("extract_status").isin("pending", "failed")).select("doc_id")


@query(f"select doc_id from {_LEDGER} where extract_status = 'extracted' and embed_status in ('pending', 'failed') and index_status <> 'indexed'")
def resume_embed(spark, sf_dir):
    return ledger(spark, sf_dir).where("extract_status = 'extracted' and embed_status in ('pending', 'failed') and index_status <> 'indexed'").select("doc_id")


@query(f"select doc_id from {_LEDGER} where extract_status = 'extracted' and embed_status = 'embedded' and index_status <> 'indexed'")
def resume_index(spark, sf_dir):
    return ledger(spark, sf_dir).where("extract_status = 'extracted' and embed_status = 'embedded' and index_status <> 'indexed'").select("doc_id")


@query("select min(doc_id) as doc_id from documents group by sha256(text) order by 1 limit 100")
def post_dedup_limit(spark, sf_dir):
    """The limit comes after the content deduplication (the feature)."""
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").orderBy("doc_id").limit(100)


@query(f"select category || '@v1#' || edition as key, max(doc_id) as doc_id, count(*) as files from {_LEDGER} where (reason is null or reason not like 'duplicate-of:%') and parse_status <> 'failed' group by 1")
def manifest_export(spark, sf_dir):
    """One entry for each key; of several the last wins."""
    rows = ledger(spark, sf_dir).where("(reason is null or reason not like 'duplicate-of:%') and parse_status <> 'failed'")
    return rows.groupBy(F.concat("category", F.lit("@v1#"), "edition").alias("key")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("files"))


@query(f"select category || '@v1#' || edition as key, sum(chunk_count)::bigint as chunks from {_LEDGER} where index_status = 'indexed' group by 1")
def seed_state(spark, sf_dir):
    rows = ledger(spark, sf_dir).where("index_status = 'indexed'")
    return rows.groupBy(F.concat("category", F.lit("@v1#"), "edition").alias("key")).agg(F.sum("chunk_count").alias("chunks"))


# ---- writes as merges


@query("select doc_id, source, lang from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'new', 'xx' from labels")
def merge_upsert(spark, sf_dir):
    new = read(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("source"), F.lit("xx").alias("lang"))
    return R.upsert(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), new, "doc_id")


@query("select coalesce(l.doc_id, d.doc_id) as doc_id, coalesce(case when l.quality = 1 then 'good' end, d.source) as source from documents d full join labels l using (doc_id)")
def partial_update(spark, sf_dir):
    patch = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"))
    return R.merge_coalesce(read(spark, sf_dir, "documents").select("doc_id", "source"), patch, "doc_id")


@query("select source, lang, count(*) as kept from documents where not (source = 'src1' and lang = 'en') group by 1, 2")
def delete_complement(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(~((F.col("source") == "src1") & (F.col("lang") == "en"))).groupBy("source", "lang").agg(F.count("*").alias("kept"))


@query("select doc_id, case when doc_id in (select vec_id from embeddings) then 'verified' else 'missing' end as status from documents")
def reconcile_ids(spark, sf_dir):
    return R.reconcile(read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("select d.doc_id, coalesce(nullif(d.lang, 'en'), 'chunk-' || d.doc_id) as article, e.label, l.quality from documents d join labels l using (doc_id) join embeddings e on e.vec_id = d.doc_id")
def index_points(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").join(e, "doc_id")
    return joined.select("doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.concat(F.lit("chunk-"), F.col("doc_id").cast("string"))).alias("article"), "label", "quality")


# ---- structure


@query(f"select s.doc, s.pos, p.page_no from {SPANS.sql} s asof left join {PAGES.sql} p on p.doc = s.doc and p.page_start <= s.pos")
def page_asof(spark, sf_dir):
    return R.as_of(SPANS.rows(spark, sf_dir), PAGES.rows(spark, sf_dir), "doc", "pos", "page_start", "page_no")


@query(f"select s.doc, s.pos as start, s.until as \"end\", min(p.confidence) as confidence, coalesce(bool_or(p.review), false) as needs_review from {SPANS.sql} s left join {PAGES.sql} p on p.doc = s.doc and p.page_start < s.until and p.page_end > s.pos group by 1, 2, 3")
def page_overlap(spark, sf_dir):
    return R.overlapping(SPANS.rows(spark, sf_dir).select("doc", F.col("pos").alias("start"), F.col("until").alias("end")), PAGES.rows(spark, sf_dir), "doc")


_LAST = "last_value({0} ignore nulls) over w"
_AT = "max(case when {0} is not null then line end) over w"


@query(f"""with x as (select doc, line, {_LAST.format("book")} as b, {_LAST.format("part")} as p, {_LAST.format("chapter")} as c, coalesce({_AT.format("book")}, -1) as ab, coalesce({_AT.format("part")}, -1) as ap, coalesce({_AT.format("chapter")}, -1) as ac
    from {HEADINGS.sql} window w as (partition by doc order by line rows between unbounded preceding and current row))
    select doc, line, b as in_book, case when ap >= ab then p end as in_part, case when ac >= ab and ac >= ap then c end as in_chapter from x""")
def statute_hierarchy(spark, sf_dir):
    return R.headings_in_force(HEADINGS.rows(spark, sf_dir), "doc", "line")


@query("select doc_id, piece, case when piece > 0 then doc_id || ' part ' || piece end as continued_from from (select doc_id, unnest(range(n_chars // 1500 + 1)) as piece from documents)")
def continued_from(spark, sf_dir):
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 1500).cast("long"))).alias("piece"))
    label = F.concat(F.col("doc_id").cast("string"), F.lit(" part "), (F.col("piece") + 1).cast("string"))
    return d.select("doc_id", "piece", F.lag(label).over(Window.partitionBy("doc_id").orderBy("piece")).alias("continued_from"))


@query(f"with recursive r(node, depth) as (select 1::bigint, 0 union select e.dst, r.depth + 1 from r join {EDGES.sql} e on e.src = r.node where e.dst <> 568 and r.depth < 20) select node, min(depth)::int as depth from r group by 1")
def folder_walk(spark, sf_dir):
    return R.reachable(EDGES.rows(spark, sf_dir), [1], skip=[568])


# ---- analysis of documents and of inline sections

#: Documents as sections of matters: a hundred documents are a matter, `DOC_TYPES` gives their types; inline ones have negative ids.
_CASES = f"(select doc_id // 100 as matter, doc_id as section, {DOC_TYPES} as doc_type, text from documents union all select -matter, -section, doc_type, text from {SECTIONS.sql})"


def _cases(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("matter"), F.col("doc_id").alias("section"), F.expr(DOC_TYPES).alias("doc_type"), "text")
    return d.unionByName(inline(spark, SECTIONS).select((-F.col("matter")).alias("matter"), (-F.col("section")).alias("section"), "doc_type", "text"))


_KEY = ", ".join(f"({' + '.join(f'(case when contains(lower(text), {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)}) then {n} else 0 end)' for w, n in words)}) as {name}" for name, words in A.CLASS_KEYWORDS)
_NAMES = [name for name, _ in A.CLASS_KEYWORDS]
_BEST = f"greatest({', '.join(_NAMES)})"


@query(f"select section, case when {_BEST} < 2 then 'unknown' {' '.join(f'when {n} = {_BEST} then {chr(39)}{n}{chr(39)}' for n in _NAMES)} end as doc_type from (select section, {_KEY} from {_CASES})")
def keyword_classify(spark, sf_dir):
    return _sections(spark, sf_dir).select("section", A.classify(F.col("text")).alias("doc_type"))


def _sections(spark, sf_dir):
    """section, text: all documents by their ids, and the inline sections by theirs, negative, so that no two share one."""
    own = inline(spark, SECTIONS).select((-F.col("section")).alias("section"), "text")
    return own.unionByName(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text"))


@query()
def dates(spark, sf_dir):
    return A.dates(_sections(spark, sf_dir))


@query()
def obligations(spark, sf_dir):
    return A.obligations(_sections(spark, sf_dir))


@query(f"""with m as (select matter, section, lower(v) as value from (select matter, section, unnest(regexp_extract_all(text, '(?i)(\\d+\\s*(?:months?|mois))')) as v from {_CASES} where contains(lower(text), 'notice period') or contains(lower(text), 'préavis')))
    select a.matter, a.section as a_section, a.value as a_value, b.section as b_section, b.value as b_value from m a join m b on a.matter = b.matter and a.section < b.section and a.value <> b.value""")
def contradictions(spark, sf_dir):
    return A.contradictions(_cases(spark, sf_dir))


_GLOSSARY = ["notice", "salaire", "contrat"]


@query(f"select section, sum({' + '.join(f'coalesce(contains(lower(text), {chr(39)}{w}{chr(39)}), false)::bigint' for w in _GLOSSARY)})::bigint as hits from {_CASES} group by 1")
def glossary_hits(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("section").agg(F.sum(A.glossary(F.col("text"), _GLOSSARY)).alias("hits"))


_MARKS = " or ".join(f"contains(text, '{m}')" for m in A.EVIDENCE_MARKS)


@query(f"select id, case when not ({_MARKS}) then 'ok' when not external then 'ok' when mode = 'strict' then 'violation' when not consent then 'consent-needed' else 'ok' end as decision from {PRIVACY.sql}")
def privacy_decision(spark, sf_dir):
    evidence = A.any_of(F.col("text"), A.EVIDENCE_MARKS)
    return PRIVACY.rows(spark, sf_dir).select("id", A.privacy(evidence, F.col("external"), F.col("mode"), F.col("consent")).alias("decision"))


@query()
def greeting_gate(spark, sf_dir):
    own = MESSAGES.rows(spark, sf_dir).select("text").unionByName(read(spark, sf_dir, "conversations").select("text"))
    return own.select("text", A.greeting(F.col("text")).alias("greeting"))


@query(f"select id, case when contains(lower(text), 'out_of_scope') and not contains(lower(text), 'in_scope') then 'OUT_OF_SCOPE' else 'IN_SCOPE' end as label from {TOOL_TEXTS.sql}")
def intent_label(spark, sf_dir):
    return TOOL_TEXTS.rows(spark, sf_dir).select("id", A.intent(F.col("text")).alias("label"))


@query()
def tool_call_parse(spark, sf_dir):
    return TOOL_TEXTS.rows(spark, sf_dir).select("id", A.tool_call(F.col("text")).alias("call")).select("id", "call.*")


@query(f"""with r as (select *, row_number() over (partition by document_id, page, s, e order by seq) as n from {CITATIONS.sql})
    select document_id, page, s, e, '[matter: doc ' || document_id || ' p.' || page || ' ¶' || s || '-' || e || ']' as rendered from r where n = 1""")
def citation_dedup(spark, sf_dir):
    c = R.first_per_group(CITATIONS.rows(spark, sf_dir), ["document_id", "page", "s", "e"], ["seq"])
    return c.select("document_id", "page", "s", "e", F.format_string("[matter: doc %d p.%d ¶%d-%d]", "document_id", "page", "s", "e").alias("rendered"))


@query()
def heading_sections(spark, sf_dir):
    return S.heading_sections(PAGED.rows(spark, sf_dir))


# ---- file names


@query()
def filename_provenance(spark, sf_dir):
    from ..sources.catalog import provenance

    return provenance(AUTHORITY_FILES.rows(spark, sf_dir))


# ---- frames, metrics, stages


@query("select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 4) as mean from events group by 1")
def pipeline_metrics(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query()
def embed_stage(spark, sf_dir):
    from ..sources.embedding import embed, hash_embedder

    return embed(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), hash_embedder)


@query()
def events_increment(spark, sf_dir):
    from ..streaming.incremental import run_available

    return run_available(spark, sf_dir)


# ---- serving


@query(_TOP_TENANTS.format(scores=_LEX_TENANTS, k=10))
def rerank_passthrough(spark, sf_dir):
    docs = _owned(spark, sf_dir)
    top = H.lexical_topk(_items(spark, sf_dir), docs, 30, "source")
    return V.rerank(top.join(docs, ["source", "id"]), 10, within="source").select("query", "source", "id", "score", "rank")


@query("select item_id as query, (row_number() over (partition by item_id order by d, r))::int as ordinal, domain, excerpt from (select item_id, 0 as d, 1 as r, 'matter' as domain, substr(text, 1, 800) as excerpt from benchmark union all select item_id, 1, 1, 'authority', substr(text, 1, 800) from benchmark)")
def citation_order(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.lit(1).alias("rank"), "text")
    matter = b.withColumns({"document_id": F.col("query"), "page": F.lit(1)})
    authority = b.withColumns({"source": F.lit("law"), "version": F.lit("v1"), "article": F.lit("Article 1")})
    return V.citations(matter, authority).select("query", "ordinal", "domain", F.get_json_object("citation", "$.excerpt").alias("excerpt"))


@query("select source, lang as version, n_chars % 5 as article, min(doc_id) as seq from documents where trim(source) <> '' group by 1, 2, 3")
def authority_citations(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "source", F.col("lang").alias("version"), (F.col("n_chars") % 5).cast("string").alias("article"))
    return V.authority_dedup(d).select("source", "version", F.col("article").cast("long").alias("article"), "seq")


@query("select conv_id * 1000 + turn as id, 'token' as type, text from conversations where role = 'assistant'")
def sse_parse(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("token").alias("type"), "text")))
    return V.parse_frames(c.select("id", F.when(F.col("role") == "assistant", frame).otherwise(F.concat(F.lit("event: "), "text")).alias("line")))


@query("""with d as (select doc_id, text, string_split(text, chr(10))[1] as line, contains(text, chr(10))::int as gap from documents), l as (select *, 1200 - length(line) - gap - 2 as room from d)
    select doc_id, case when length(text) <= 1200 then text when room <= 0 then line[1:1200] else line || case gap when 1 then chr(10) else '' end || regexp_replace(substr(text, length(line) + 2, room), '\\s+$', '') || ' …' end as summary, length(text) // 4 as estimate from l""")
def summary_cap(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.cap_summary(F.col("text")).alias("summary"), V.token_estimate(F.col("text")).alias("estimate"))


@query("select doc_id, case when n_chars < 20 * (n_chars // 1500 + 1) then 'yes' else 'no' end as ocr from documents")
def ocr_flags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.ocr_flag(F.col("n_chars"), F.floor(F.col("n_chars") / 1500) + 1).alias("ocr"))


@query("select 'vec-' || vec_id as name, case when label = 3 then 'no model' else 'dimension differs' end as problem from embeddings where label in (3, 4)")
def preflight_check(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.preflight(e.select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("name"), F.when(F.col("label") == 3, " ").otherwise("m").alias("model"), F.size("embedding").alias("dim"), F.when(F.col("label") == 4, 65).otherwise(64).alias("expected_dim")))


@query("select conv_id, count(*) as messages from conversations where conv_id not in (select item_id from benchmark) group by 1")
def purge_cascade(spark, sf_dir):
    gone = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"))
    return V.cascade_delete(gone, {"messages": read(spark, sf_dir, "conversations")}, "conv_id")["messages"].groupBy("conv_id").agg(F.count("*").alias("messages"))


@query("select m.conv_id, m.turn, m.role, c.n_turns from conversations m join (select conv_id, count(*) as n_turns from conversations group by 1) c using (conv_id) where c.n_turns >= 3 and m.role = 'user'")
def matter_messages(spark, sf_dir):
    m = read(spark, sf_dir, "conversations")
    own = m.groupBy("conv_id").agg(F.count("*").alias("n_turns")).where("n_turns >= 3")
    return m.where("role = 'user'").join(own, "conv_id").select("conv_id", "turn", "role", "n_turns")


@query(f"select doc_id, case when extract_status = 'extracted' then 'pending' else extract_status end as extract_status, 'pending' as embed_status, 'pending' as index_status, 0::bigint as chunk_count, sha from {_LEDGER} where extract_status = 'extracted'")
def invalidate_derived(spark, sf_dir):
    """Derived states go back, provenance stays."""
    rows = ledger(spark, sf_dir).where("extract_status = 'extracted'")
    pending = F.lit("pending")
    return rows.select("doc_id", pending.alias("extract_status"), pending.alias("embed_status"), pending.alias("index_status"), F.lit(0).cast("long").alias("chunk_count"), "sha")


@query(f"select a.doc_id, a.stage from (select doc_id, 'embed_status' as stage from {_LEDGER} where embed_status = 'embedded' and extract_status <> 'extracted' union all select doc_id, 'index_status' from {_LEDGER} where index_status = 'indexed' and (extract_status <> 'extracted' or embed_status <> 'embedded')) a")
def stage_readiness(spark, sf_dir):
    """Rows that are ahead of a stage before them: none in a sound ledger."""
    rows = ledger(spark, sf_dir)
    ahead = F.array_compact(F.array(F.when((F.col("embed_status") == "embedded") & (F.col("extract_status") != "extracted"), "embed_status"), F.when((F.col("index_status") == "indexed") & ((F.col("extract_status") != "extracted") | (F.col("embed_status") != "embedded")), "index_status")))
    return rows.select("doc_id", F.explode(ahead).alias("stage"))


from . import casefile, stages, statutes, workflow  # noqa: E402, F401  they register their own queries

"""What DuckDB can state of this subpackage's queries, over the whole tables."""

from __future__ import annotations

from . import decontaminate, quality_rules, secret_scan

_WORDS = f"regexp_extract_all(t, '[^{quality_rules.SPACE}]+')"


def quality_sql() -> str:
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, {_WORDS} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{quality_rules.SPACE}]')) as lines from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
h as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by 1),
s as (select w.doc_id, t, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(h.n, 0) as n_repeat_words from w left join h using (doc_id)),
b as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1) as n, greatest(word_chars, 1) as c from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or n_symbols > 0.10::double * c or word_chars > 30 * n or word_chars < 2 * n
        or (n_dup_lines >= 3 and n_dup_lines > 0.3::double * len(string_split(t, chr(10))))
        or length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) < 0.5::double * c or length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) > 0.6::double * c
        or len(list_distinct(w)) < 0.08::double * least(n, 1000)) as kept
from b"""


def secrets_sql() -> str:
    """One pass of each rule over each text: what lies between matches gives their places by a running sum."""
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        cut = f"regexp_replace(t, '{p}', chr(1), 'g')"
        need = f"where regexp_matches(t, '{p}')"
        # Texts without the separator itself are split at it after one replacement; others are split by the pattern.
        parts.append(f"""select doc_id, row, '{r.kind}' as kind, {i} as rank, {str(r.base).lower()} as base, {r.min_length} as least, unnest(h) as hit, unnest(v) as val, unnest(list_transform(g[1:len(h)], lambda x: length(x))) as gap, unnest(range(len(h))) as k
            from (select doc_id, row, regexp_extract_all(t, '{p}', 0) as h, regexp_extract_all(t, '{p}', {r.group}) as v, case when contains(t, chr(1)) then string_split_regex(t, '{p}') else string_split({cut}, chr(1)) end as g from d {need})""")
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.RULES if r.base)
    return f"""
with d as (select doc_id, row_number() over () as row, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
p as (select *, sum(gap + length(hit)) over (partition by row, rank order by k) - length(hit) as s from m),
s as (select row, kind, rank, base, s::bigint as s, (s + length(hit))::bigint as e from p where length(val) >= least),
a as (select row, {counts}, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (base) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from s group by 1)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secret_scan.RULES if r.base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (row)"""


def decontamination_sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = decontaminate.WINDOW
    return f"""
with b as (select item_id, {words} as w from benchmark), d as (select doc_id, {words} as w from documents),
x as (select item_id, least(len(w), {n}) as n, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) as i from b where len(w) > 0)),
v as (select distinct n from x),
p as (select doc_id, i, v.n, array_to_string(w[i:i + v.n - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) q join v on i + v.n - 1 <= len(w)),
h as (select p.doc_id, p.i, p.n, x.item_id from p join x on x.n = p.n and x.g = p.g),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from h)) group by 1),
k as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join k using (doc_id)"""

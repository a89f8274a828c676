"""Fixtures beside rows of the given tables: the rules of each query meet whole tables, the literals keep the cases that those lack."""

from __future__ import annotations

from . import fixtures as X
from .base import Beside

MESSAGES = Beside(X.MESSAGES, "conversations", ("role", "text"))
TOOL_TEXTS = Beside(X.TOOL_TEXTS, "conversations", ("conv_id * 1000 + turn + 100", "text"))
MOVES = Beside(
    X.MOVES, "events",
    (
        "event_id + 100", "case event_id % 3 when 0 then 'chunk' when 1 then 'draft' else 'parse_status' end",
        "case event_id % 5 when 0 then 'pending' when 1 then 'draft' when 2 then 'acknowledged' when 3 then 'indexed' else 'parsed' end",
        "case event_id % 7 when 0 then 'pending' when 1 then 'draft' when 2 then 'lawyer_reviewed' when 3 then 'embedded' when 4 then 'acknowledged' when 5 then 'quarantined' else event_type end",
        "case when event_id % 2 = 0 then event_type end",
    ),
)
FILES = Beside(
    X.FILES, "documents",
    (
        "doc_id + 100", "case n_chars % 4 when 0 then 'pending' when 1 then 'extracted' when 2 then 'quarantined' else 'failed' end", "case when n_chars % 3 = 0 then 'indexed' else 'pending' end",
        "case when n_chars % 5 > 1 then source when n_chars % 5 = 1 then '' end", "case when n_chars % 7 < 3 then concat('worker-crash: ', lang) when n_chars % 7 = 3 then concat('duplicate-of: ', doc_id) end",
    ),
)
UPLOADS = Beside(X.UPLOADS, "pages", ("page_id + 100", "concat(url, case page_id % 4 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.exe' else '' end)", "length(html) * 3000"))
PATHS = Beside(X.PATHS, "pages", ("page_id + 100", "url"))
PRIVACY = Beside(
    X.PRIVACY, "documents",
    ("doc_id + 100", "case when n_chars % 4 = 0 then concat(text, ' ¶ 1') else text end", "n_chars % 2 = 0", "case when n_chars % 3 = 0 then 'strict' else 'ask' end", "n_chars % 5 = 0"),
)
CITATIONS = Beside(X.CITATIONS, "documents", ("doc_id + 100", "n_chars % 97", "n_chars % 3", "0", "n_chars % 7"))
AUTHORITY_FILES = Beside(X.AUTHORITY_FILES, "documents", ("concat(case when n_chars % 2 = 0 then 'قانون رقم ' else 'notes ' end, doc_id, '.', n_chars, '.pdf')", "source"))
PAGES = Beside(X.PAGES, "lineitem", ("l_orderkey + 100", "l_linenumber", "l_linenumber * 100 - 100", "l_linenumber * 100 - 1", "case when l_discount > 0.02 then l_discount end", "l_returnflag = 'R'"))
SPANS = Beside(X.SPANS, "orders", ("o_orderkey + 100", "o_custkey % 300", "o_custkey % 300 + 150"))
HEADINGS = Beside(
    X.HEADINGS, "events",
    (
        "user_id + 100", "event_id", "case when event_id % 11 = 0 then concat('b', event_id) end", "case when event_id % 11 in (1, 2) then concat('p', event_id) end",
        "case when event_id % 11 in (3, 4, 5) then concat('c', event_id) end",
    ),
)
#: A part hangs below the one of half its number.
EDGES = Beside(X.EDGES, "part", ("cast(floor(p_partkey / 2) as bigint)", "p_partkey"))
PAGED = Beside(X.PAGED, "documents", ("doc_id + 100", "1", "text", "case when n_chars % 3 > 0 then n_chars % 10 / 10 end", "n_chars % 2 = 0"))

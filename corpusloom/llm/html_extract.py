"""Main text of web pages by wrapper induction.

1. Pages are parsed and siblings of one signature folded into iterator nodes, so that the signatures from the root down to a node
   name it on every page of its host. Simple tree matching of two folded trees pairs nodes of equal path; grouping by path aligns
   all pages of a host at once.
2. Over all pages of a host, each (path, hash of the text below) counts its pages, characters and links. The counts are summed in
   the tasks before the shuffle, so a host with most of the pages costs no task more than another.
3. Template are constant nodes, texts that recur on pages of their path where such texts cover most of the path's pages, be it one
   wording or several (second layout, other menu), and paths whose text is links on the host as a whole. Other nodes are slots.
4. A page's content is the text in its slots, of its article or main element where it has one. Names are the fallback for what no
   alignment can tell from an article, as it varies like one: whatever names itself a menu, header, footer, sidebar, notice,
   advert, form or comment is left out, by its element, its role, or a whole class or id.

Template removal within an article concerns containers only, never its paragraphs, headings, lists, quotations or tables: pages
that copy one another keep their text. Outside, a page that is template throughout keeps its text for the same reason.

Defined results: a null or empty html, or one without text, gives an empty text; a page without a host is counted with the
others without one; repeated rows are answered each; an empty table gives an empty result; other columns are ignored. Depth,
length and broken markup are not bounded: see `dom`.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .dom import Folded, Node, parse, text_blocks

#: Texts recur if on so many pages each, and on this share of their path's pages; a path is template where they cover so much of it.
CONSTANT_PAGES, CONSTANT_LEAST, CONSTANT_SHARE = 5, 0.001, 0.8
#: A path is a menu if this share of its characters on the host lies in links, of which a page has so many on average.
LINKED_SHARE, LINKS = 0.8, 3
#: (host, path, text) rows that may be broadcast, 50 bytes each; beyond, pages of a host are dealt into so many joins.
BROADCAST_NODES, SALT = 500_000, 64
#: Elements and names of what is not the article.
DROP_TAGS = set("aside button canvas dialog embed fieldset footer form head iframe input label link meta nav noscript object script search select style svg template textarea title video audio".split())
DROP_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal"
    " nav navbar navigation newsletter notice notification overlay pagination popup promo promoted related reply replies share sharing sidebar skip social sponsor"
    " sponsored subscribe subscription toolbar widget".split()
)
#: Parts that say nothing of their own, so that site-footer is a footer but share-price is no share.
PLAIN_NAMES = set("area bar block bottom box buttons container form icons inner left links list main outer page posts right section signup site slot top widget wrap wrapper".split())
DROP_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr td th figure figcaption b i em strong a span code br".split())
#: Lists may be menus or comments by their id; other prose has ids that headings and anchors use.
LISTS = {"ul", "ol", "dl"}


@lru_cache(maxsize=65536)
def _names_itself(value: str, inside: bool) -> bool:
    """Whether a whole class or id of the value is a name to drop, alone or with plain parts."""
    for token in value.lower().split():
        parts = {p for p in token.replace("_", "-").split("-") if p and not p.isdigit()}
        names = DROP_NAMES if inside else DROP_NAMES | {"header"}
        if parts & names and parts <= names | PLAIN_NAMES:
            return True
    return False


def boilerplate(n: Node, inside: bool) -> bool:
    """Whether the element names itself something else than the article; inside: of an article, whose own header stays."""
    if n.tag in DROP_TAGS or (n.tag == "header" and not inside):
        return True
    a = n.attrs
    if not a or n.tag in ("html", "body"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if n.tag in ("article", "main"):
        return False
    if a.get("role", "").lower() in DROP_ROLES:
        return True
    return _names_itself(a.get("class", ""), inside) or ((n.tag not in PROSE or n.tag in LISTS) and _names_itself(a.get("id", ""), inside))


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def induce(pages: DataFrame) -> DataFrame:
    """host, path, own: the nodes that are template; own is a text's hash, or 0 where the path is with any text."""

    def run(batches):
        seen: dict[tuple[str, int, int], list[int]] = {}

        def out():
            keys, numbers = zip(*seen, strict=True), zip(*seen.values(), strict=True)
            kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*keys, *numbers], kinds, strict=True)], ["host", "path", "own", "n", "chars", "linked", "anchors"])

        for b in batches:
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                tree = Folded(parse(text))
                for path, own, *numbers in zip(tree.path, tree.own, tree.chars, tree.linked, tree.anchors, strict=True):
                    if own:
                        held = seen.setdefault((host, path, own), [0, 0, 0, 0])
                        held[0] += 1
                        for i, x in enumerate(numbers):
                            held[i + 1] += x
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    numbers = ("n", "chars", "linked", "anchors")
    counted = pages.select("host", "html").mapInArrow(run, "host string, path bigint, own bigint, n bigint, chars bigint, linked bigint, anchors bigint")
    counted = durable(counted.groupBy("host", "path", "own").agg(*[F.sum(c).alias(c) for c in numbers]))
    paths = counted.groupBy("host", "path").agg(F.sum("n").alias("pages"), *[F.sum(c).alias(c) for c in numbers[1:]])
    paths = paths.withColumn("least", F.greatest(F.lit(CONSTANT_PAGES), F.ceil(F.col("pages") * CONSTANT_LEAST))).where(F.col("pages") >= CONSTANT_PAGES)
    menus = paths.where((F.col("linked") >= LINKED_SHARE * F.col("chars")) & (F.col("anchors") >= LINKS * F.col("pages"))).select("host", "path", F.lit(0).cast("long").alias("own"))
    # Only texts that may recur meet the totals, so varying slots, which are most rows, are not joined.
    again = counted.where(F.col("n") >= CONSTANT_PAGES).join(paths.select("host", "path", "pages", "least"), ["host", "path"]).where("n >= least")
    covered = again.groupBy("host", "path").agg(F.sum("n").alias("covered"), F.first("pages").alias("of")).where(F.col("covered") >= CONSTANT_SHARE * F.col("of"))
    return durable(again.join(covered.select("host", "path"), ["host", "path"]).select("host", "path", "own").unionByName(menus))


def _articles(root: Node) -> list[Node]:
    """Outermost article or main elements that are not boilerplate; a main that holds articles stands for them."""
    out: list[Node] = []
    todo: list[tuple[Node, bool]] = [(root, False)]
    mains: list[tuple[Node, int]] = []
    while todo:  # preorder; a main is left with (node, True), when it is known whether it held articles
        n, left = todo.pop()
        if left:
            main, before = mains.pop()
            if len(out) == before:
                out.append(main)
            continue
        if n.tag == "article" or n.attrs.get("role") == "article":
            out.append(n)
            continue
        if n.tag == "main" or n.attrs.get("role") == "main":
            mains.append((n, len(out)))
            todo.append((n, True))
        todo.extend((c, False) for c in reversed(n.children) if not isinstance(c, str) and not boilerplate(c, False))
    return out


def extract(text: str, template: set[tuple[int, int]]) -> str:
    """Main text of one page under its host's template: (path, hash of the text) pairs, hash 0 for any text."""
    if not text.strip():
        return ""
    root = parse(text)
    constant: set[int] = set()
    menus: set[int] = set()
    if template:
        tree = Folded(root)
        for path, own, members in zip(tree.path, tree.own, tree.members, strict=True):
            if (path, own) in template:
                constant.update(map(id, members))
            if (path, 0) in template:
                menus.update(map(id, members))
    regions = _articles(root)
    if regions:
        skip = lambda n: boilerplate(n, True) or (id(n) in constant and n.tag not in PROSE)
    else:
        regions, skip = [root], lambda n: boilerplate(n, False) or id(n) in constant or id(n) in menus
    blocks: list[str] = []
    for r in regions:
        text_blocks(r, skip, blocks)
    if not blocks:  # all of it is constant: the page is a copy, not a template
        for r in regions:
            text_blocks(r, lambda n: boilerplate(n, r.tag == "article"), blocks)
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, bound: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = with_host(pages)
    nodes = induce(rows)
    few = nodes.count() <= bound
    wrappers = nodes.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("path", "own")).alias("_nodes"))
    on = F.col("host") == F.col("_host")
    if not few:  # a host may hold a third of all pages: they are dealt, and its wrapper, which its templates bound, is repeated
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
        wrappers = wrappers.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on = on & (F.col("_salt") == F.col("_deal"))
    joined = rows.join(F.broadcast(wrappers) if few else wrappers.hint("merge"), on, "left")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        held: tuple = (None, set())
        for b in batches:
            texts = []
            for html, at in zip(b.column("html").to_pylist(), range(b.num_rows), strict=True):
                paths, owns = b.column("paths")[at], b.column("owns")[at]
                if not paths.is_valid:
                    held = (None, set())
                elif held[0] is None or not paths.equals(held[0]) or not owns.equals(held[1]):
                    held = (paths, owns, set(zip(paths.as_py(), owns.as_py(), strict=True)))
                texts.append(extract(html, held[-1]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    shown = joined.select("page_id", "url", "html", F.col("_nodes.path").alias("paths"), F.col("_nodes.own").alias("owns"))
    return shown.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

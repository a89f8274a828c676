"""HTML extraction: the tokenizer, names, and wrapper induction."""

import time

from corpusloom.llm import dom, html_extract


def name(i):
    return "w" + str(i).translate(str.maketrans("0123456789", "aeioubdgkl"))


def text_of(html, template=frozenset()):
    return html_extract.extract(html, set(template))


def test_html(spark):
    article = "<article><h1>T&amp;t</h1><p><b>One.<br><p>two&nbsp; x\n y<ul><li>a<li>b</ul><div class='share'>Share me</div></article>"
    page = lambda i: f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav>menu {i}</nav><div class='ad'>buy</div>{article}<section class='comments'>c</section><footer>f</footer></body></html>"
    plain = lambda i: f"<body><div id='top'>Site name</div><div id='main'><h2>H{i}</h2><p>{'text ' * 30}{i}</p></div><form>f</form></body>"
    rows = [(i, "http://a.example/x", page(i), 1) for i in range(6)] + [(10 + i, "http://b.example:80/", plain(i), 1) for i in range(6)] + [(20, None, None, 1), (21, "x", "", 1), (22, "", "a &lt; b", 1), (22, "", "a &lt; b", 1)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[0] == "T&t\n\nOne.\n\ntwo x y\n\na\n\nb"
    assert text[12] == f"H2\n\n{'text ' * 30}2" and text[20] == text[21] == "" and text[22] == "a < b"


def test_html_keeps_intro_and_finds_second_layout(spark):
    """A headline and intro beside the long part stay; a menu of two wordings is template on all pages of its host."""
    page = lambda i: f"<body><div class='x'>{'Hello user, sign out' if i % 2 else 'Sign in'}</div><div id='main'><h1>Title {name(i)}</h1><div class='intro'>Intro {name(i)}</div><div class='body'>{'text ' * 30}{name(i)}</div></div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(14)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {name(i)}\n\nIntro {name(i)}\n\n{'text ' * 30}{name(i)}" for i in range(14)}


def test_induction_decides(spark):
    """Menus and a footer without a telling name: alignment over the host's pages finds them, names alone do not."""
    menu = lambda i: "<div class='q'>" + "".join(f"<span><a href=/{name(i * 7 + k)}>{name(i * 7 + k)}</a></span>" for k in range(5)) + "</div>"
    page = lambda i: f"<body>{menu(i)}<div class='z'><p>Story {name(i)} goes on.</p><p>Second {name(i)}.</p></div><div class='y'>All rights kept</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(50, "http://b.example/", page(50))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {name(i)} goes on.\n\nSecond {name(i)}." for i in range(12)}
    got = {r.page_id: r.text for r in html_extract.main_text(docs).collect()}
    assert {i: got[i] for i in want} == want
    assert all(text_of(h) != want.get(i) for i, _, h in rows) and "All rights kept" in got[50]
    # Beyond the bound the wrappers are shuffled; the result is the same.
    assert {r.page_id: r.text for r in html_extract.main_text(docs, bound=0).collect()} == got


def test_alignment_is_simple_tree_matching():
    """Equal paths of two folded trees are what simple tree matching by dynamic programming pairs."""

    def tree(n):
        groups = {}
        for m in n:
            for c in m.children:
                if not isinstance(c, str):
                    groups.setdefault(c.signature, []).append(c)
        return n[0].signature, [tree(g) for g in groups.values()]

    def match(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(x, y))
        return 1 + best[-1][-1]

    pages = ["<div><p>x</p><ul><li>1<li>2</ul></div>", "<div><h1>t</h1><p>x</p><ul><li>1</ul></div>", "<div><h1>t</h1><ul></ul></div><p>x", "<div class='a'><p>x</p></div>"]
    roots = [dom.parse(p) for p in pages]
    for a in roots:
        for b in roots:
            assert match(tree([a]), tree([b])) == len(set(dom.Folded(a).path) & set(dom.Folded(b).path))


def test_names_are_whole():
    for tag in ("<article class='post has-sidebar'>", "<main class='no-sidebar'>", "<article id='comments'>"):
        assert text_of(f"{tag}<p>kept</p></{tag[1:5]}" + "<div class='x") == "kept"
    inner = "<article><h2 id='notice-of-change'>H</h2><p class='share-price'>P</p><div id='ad-hoc'>D</div><p id='notice'>N</p><ol id='comments'><li>c</ol><div class='site-footer'>f</div><div class='cookie-banner big'>b</div></article>"
    assert text_of(inner) == "H\n\nP\n\nD\n\nN"


def test_broken_markup_loses_nothing():
    assert text_of("<p class=it's>one</p><p>it's two</p>") == "one\n\nit's two"
    assert text_of('<p class="x>one</p><p>two</p>') == "one\n\ntwo"
    assert text_of("<p>a</p><!--><p>b</p>") == "a\n\nb" and text_of("<!---><p>b</p><!-- x --!><p>c</p><!-- open") == "b\n\nc"
    assert text_of("<p>1 <b and c</p><p>d</p>") == "1 <b and c\n\nd" and text_of("a <b and c") == "a <b and c" and text_of("a < b </> c <") == "a < b c <"
    assert text_of("<p title='a>b' hidden=x class=y/>gone</p><p title='a>b'>kept</p>") == "kept"
    assert text_of('<a href="x"title="y">t</a><br/><img alt=">">u') == "t u"
    assert text_of("<script>if (a < b) '</p>'</script><p>x</p><style>p{") == "x"
    assert text_of("<p>a\x00<\x00b</p>") == "a\x00<\x00b"


def test_deep_and_hostile_pages_are_linear():
    deep = "<div>" * 20000 + "bottom" + "</div>" * 20000
    began = time.perf_counter()
    assert text_of(deep) == "bottom" and dom.Folded(dom.parse(deep)).own[0]
    for piece in ('<a "', "<a b='", "<a x=1 ", "<a b=\">", "</x", "<!--", "<b>", "</section>", "<p><i>", "<a b='>' ", "<title>", "< ", "<a\n\n", "&amp", '<a b="'):
        text_of(piece * (400_000 // len(piece)) + ">")
        text_of("<section>" * 20000 + piece * (100_000 // len(piece)))
    assert time.perf_counter() - began < 60


def test_text_at_any_depth_counts(spark):
    """Varying text under many elements is no constant."""
    page = lambda i: f"<body>{'<div>' * 90}<p>Deep {name(i)}</p>{'</div>' * 90}</body>"
    rows = [(i, "http://a.example/", page(i)) for i in range(9)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Deep {name(i)}" for i in range(9)}


def test_empty_table(spark):
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

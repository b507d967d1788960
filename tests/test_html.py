import pytest

from tessera.functions import html as H
from tessera.operators import pages as P

FIRST, IGN = H.selector(H.PRIORITY), H.selector(H.IGNORED)
RES, NOISE = H.selector(H.RESERVED), H.selector(["rt", "rp"])


def found(markup, ignore=()):
    return [(n.name, H.trim(n.text()), i) for n, i in H.segments(H.body(H.parse(markup)), FIRST, H.selector([*H.IGNORED, *ignore]))]


def test_blocks_are_segments():
    page = "<html><body><div><div><h2>a</h2><div>b</div><div>c<i>d</i></div><pre>e</pre><p>f<b>g</b></p></div></div></body></html>"
    assert found(page) == [("h2", "a", False), ("div", "b", False), ("div", "cd", False), ("pre", "e", True), ("p", "fg", False)]


def test_a_body_of_text_is_one_segment():
    assert found("<body>words and no element</body>") == [("body", "words and no element", False)]


def test_ignored_elements():
    assert found('<body class="menu">a</body>', [".menu"]) == []
    page = '<body><h2>a</h2><div class="menu">b</div><h3>c</h3><p id="foot">d</p></body>'
    assert [i for _, _, i in found(page, [".menu", "#foot"])] == [False, True, False, True]


def test_only_inline_children():
    assert found("<body><div><span>a</span><span>b</span></div></body>") == [("div", "ab", False)]


def test_unclosed_markup():
    assert found("<body><p>a<p>b<b>c<ul><li>d<li>e</ul>") == [("p", "a", False), ("p", "bc", False), ("ul", "de", False)]


def test_mask():
    node = H.body(H.parse('<p>a<img src="x"/>b<ruby>c<rt>d</rt></ruby><code>e</code> <a href="#"><sup>1</sup></a><a>x<sup>2</sup></a></p>')).elements[0]
    text, kept = H.mask(node, RES, NOISE)
    assert text == "a{{id_00000}}bc{{id_00001}} {{id_00002}}x{{id_00003}}"
    assert kept == ['<img src="x"></img>', "<code>e</code>", '<a href="#"><sup>1</sup></a>', "<sup>2</sup>"]


@pytest.mark.parametrize(
    ("markup", "translation", "position", "want"),
    [
        ("<p id='i' class='c'>a</p>", "A", "below", '<p id="i" class="c">a</p><p class="c" dir="auto">A</p>'),
        ("<p>a</p>", "A & B", "above", '<p dir="auto">A &amp; B</p><p>a</p>'),
        ("<p id='i'>a</p>", "A", "only", '<p id="i" dir="auto">A</p>'),
        ("<p>a<br/>b</p>", "A\nB", "below", '<p>a<br/><span dir="auto">A</span><br/>b<br/><span dir="auto">B</span></p>'),
        ("<p>a<br/>b</p>", "A\nB", "above", '<p><span dir="auto">A</span><br/>a<br/><span dir="auto">B</span><br/>b</p>'),
        ("<p>a<br/>b</p>", "A", "below", '<p>a<br/>b</p><p dir="auto">A</p>'),
        ("<p>a</p>", "A", "left", '<table width="100%"><tr><td valign="top" width="45%"><p dir="auto">A</p></td><td width="10%"></td><td valign="top" width="45%"><p>a</p></td></tr></table>'),
        ("<span>a</span>", "A", "below", '<span>a</span> <span dir="auto">A</span>'),
        ("<p>a</p>", "{{id_00000}} aaaaaaa", "only", '<p dir="auto"><hr/> aaaa</p>'),
    ],
)
def test_place(markup, translation, position, want):
    root = H.parse(markup)
    H.place(root, root.elements[0], translation, ["<hr/>"], position)
    assert "".join(c.markup() if isinstance(c, H.Node) else c for c in root.children) == want


def test_markup_of_a_segment_is_strict():
    node = H.body(H.parse('<p class="a">x<br><span></span><i>&lt;</i></p>')).elements[0]
    assert node.markup(strict=True) == '<p class="a">x<br/><span/><i>&lt;</i></p>'  # what is empty below closes itself
    assert H.parse("<p></p>").elements[0].markup(strict=True) == "<p></p>"  # the element itself never
    assert node.markup() == '<p class="a">x<br/><span></span><i>&lt;</i></p>'
    assert H.mask(H.parse("<p>a<svg><g></g></svg><hr></p>").elements[0], RES, NOISE)[1] == ["<svg><g/></svg>", "<hr></hr>"]


def test_attributes_are_ascii():
    assert H.attributes(H.parse('<p title="Größe" xmlns="u">a</p>').elements[0]) == '{"title": "Gr\\u00f6\\u00dfe"}'
    assert H.attributes(H.parse("<p>a</p>").elements[0]) is None


def test_deep_markup():
    for name in ("div", "span", "p"):
        n = 10_000
        root = H.parse("<body>" + f"<{name}>" * n + "deep" + f"</{name}>" * n + "</body>")
        ((node, ignored),) = H.segments(H.body(root), FIRST, IGN) if name != "p" else [H.segments(H.body(root), FIRST, IGN)[-1]]
        assert not ignored and node.text() == "deep" and H.mask(node, RES, NOISE)[0] == "deep"
        assert root.markup().count(f"<{name}>") == n
        H.colour(root, "red")


def test_deep_pages(spark):
    page = "<body>" + "<div>" * 10_000 + "deep" + "</div>" * 10_000
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [(r.text, r.seq) for r in P.page_segments(pages).collect()] == [("deep", 0)]
    new = spark.createDataFrame([(1, 0, "DEEP")], "page_id int, seq int, translation string")
    assert '<div dir="auto">DEEP</div>' in P.rewrite_pages(pages, new).first().html


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("ul > li", "123"), ("div li", "123"), ("li + li", "23"), ("ul ~ p", "qr"), ("li:first-child", "1"), ("li:nth-child(2)", "2"), ("li:not([lang])", "13"), ("[lang|=en]", "2"), ("a[href$='.png']", "l"),
        ("p:last-of-type", "r"), ("div > p.z", "r"), ("a, p.z", "rl"), ("[href*='x.com/a']", "l"), ("a[title~=x]", ""), ("LI", "123"),
    ],
)
def test_combined_selectors(rule, want):
    page = H.parse('<div id="a"><ul class="x y"><li>1</li><li lang="en-US">2</li><li>3</li></ul><p>q</p><p class="z">r</p></div><a href="http://x.com/a.png">l</a>')
    match = H.selector([rule])
    assert "".join(n.text() for n in page.walk() if match(n)) == want and H.invalid_selectors([rule]) == []


def test_invalid_selectors():
    assert H.invalid_selectors(["p", "li:hover", "p::before", "", "..a", "div >", "ul.x", "> p", "[a"]) == ["li:hover", "p::before", "", "..a", "div >", "> p", "[a"]


def test_rules_on_pages(spark):
    pages = spark.createDataFrame([(1, '<body><p>Chapter 1</p><p>12.5 - 3</p><p class="note">all text</p><p><code>only code</code></p></body>')], "page_id int, html string")
    got = lambda **k: [r.ignored for r in P.page_segments(pages, **k).orderBy("seq").collect()]
    assert got() == [False, True, False, False]
    assert got(rules=["chapter"]) == [True, True, False, False]
    assert got(rules=["chapter"], mode="case") == [False, True, False, False]
    assert got(rules=["^all"], mode="regex") == [False, True, True, False]
    assert got(rules=['class="note"'], scope="html") == [False, True, True, False]


def test_colour_of_the_original(spark):
    pages = spark.createDataFrame([(1, "<body><p>a <i>b</i><br></p><p>c</p></body>")], "page_id int, html string")
    rows = spark.createDataFrame([(1, 0, "A"), (1, 1, None)], "page_id int, seq int, translation string")
    got = P.rewrite_pages(pages, rows, original_color="red").first().html
    assert got == '<body><p style="color:red">a <i style="color:red">b</i><br/></p><p style="color:red" dir="auto">A</p><p style="color:red">c</p></body>'
    assert P.rewrite_pages(pages, rows, position="right").first().html.count("<table") == 2


def test_cells_hold_translations():
    root = H.parse("<ul><li class='x'>a</li></ul>")
    H.place(root.elements[0], root.elements[0].elements[0], "A", [], "below")
    assert root.elements[0].markup() == '<ul><li class="x">a<br/><span dir="auto">A</span></li></ul>'


def test_selectors():
    match = H.selector(["p.a", "[x=1]", "not a selector!", "#i,b"])
    assert [match(n) for n in H.parse('<p class="a b"></p><p></p><i x="1"></i><u id="i"></u><b></b>').elements] == [True, False, True, True, True]


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(1, "<body><p>a &amp; b</p><p></p><pre>c</pre><p>d</p></body>"), (2, None), (3, "")], "page_id int, html string")
    rows = P.page_segments(pages)
    assert [(r.page_id, r.seq, r.text, r.ignored) for r in rows.orderBy("page_id", "seq").collect()] == [(1, 0, "a & b", False), (1, 1, "c", True), (1, 2, "d", False)]
    new = spark.createDataFrame([(1, 2, "D"), (1, 1, "never")], "page_id int, seq int, translation string")
    got = {r.page_id: r.html for r in P.rewrite_pages(pages, new).collect()}
    assert got == {1: '<body><p>a &amp; b</p><p></p><pre>c</pre><p>d</p><p dir="auto">D</p></body>', 2: None, 3: ""}


def test_pages_go_in_slices_of_bounded_size():
    import pyarrow as pa

    from tessera.operators.pages import _slices

    pages = ["x" * 40, None, "y" * 250, "", "ä" * 30, "z" * 40] + ["w"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages, pa.string())], ["k", "m"])
    cut = list(_slices(iter([batch, batch.slice(0, 0)]), 100))
    assert [x for c in cut for x in c.column(1).to_pylist()] == pages and [x for c in cut for x in c.column(0).to_pylist()] == list(range(len(pages)))
    assert all(c.num_rows == 1 or sum(len((x or "").encode()) for x in c.column(1).to_pylist()) <= 100 for c in cut)
    assert max(c.num_rows for c in _slices(iter([batch]), 1 << 20)) == 1024


def test_a_page_that_is_done_is_freed_at_once():
    import gc
    import weakref

    gc.disable()
    try:
        root = H.parse("<body><div><p>a <b>b</b></p><ul><li>c</li></ul></div></body>")
        nodes = [root, *root.walk()]
        seen = [weakref.ref(n) for n in nodes]
        H.release(nodes)
        del root, nodes
        assert not any(r() for r in seen)
    finally:
        gc.enable()

import pytest
from pyspark.sql import functions as F

from gleaner.operators import html
from gleaner.operators.selectors import select

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; U</title></head><body><div id="top" class="a film-poster">'
    '<p class="x">one <b>bold</b><p>two</div><ul><li>1<li data-n="2">2<li><a href="/q?a=1&amp;b=2">3</a></ul>'
    '<script>var t="</p>";</script><img src="i.png"><!-- c --></body></html>'
)


@pytest.fixture(scope="module")
def dom(spark):
    return html.parse_pages(spark.createDataFrame([(1, PAGE)], "id long, page string"), "id", "page")


def texts(dom, selector):
    nodes = select(F.col("nodes"), selector)
    return dom.select(F.transform(nodes, lambda n: html.node_text(F.col("page_text"), n)).alias("t")).first()["t"]


@pytest.mark.parametrize(
    "selector,want",
    [
        ("title", ["T & U"]),
        ("p", ["one bold", "two"]),
        ("div p", ["one bold", "two"]),
        ("div > b", []),
        ("p > b", ["bold"]),
        ("#top p.x", ["one bold"]),
        (".film-poster.a > p + p", ["two"]),
        ("li:first-child, li:last-child", ["1", "3"]),
        ("li:nth-child(odd)", ["1", "3"]),
        ("li:nth-child(2)", ["2"]),
        ("li:nth-child(-n+2)", ["1", "2"]),
        ("[data-n]", ["2"]),
        ('a[href^="/q"]', ["3"]),
        ('a[href*="b=2"]', ["3"]),
        ("li ~ li", ["2", "3"]),
        ("ul li a", ["3"]),
        ("script", ['var t="</p>";']),
        ("body", []),
        ("nav", []),
    ],
)
def test_select(dom, selector, want):
    assert texts(dom, selector) == want


def test_list_functions(dom):
    n, t, h = F.col("nodes"), F.col("page_text"), F.col("page_html")
    got = dom.select(
        html.list_text(t, select(n, "li")).alias("text"),
        html.list_attr(select(n, "li"), "data-n").alias("attr"),
        html.node_html(h, html.first(select(n, "a"))).alias("outer"),
        html.node_inner(h, t, html.first(select(n, "p"))).alias("inner"),
        html.node_html(h, html.first(select(n, "img"))).alias("img"),
        html.node_text(t, html.first(select(n, "nav"))).alias("none"),
    ).first()
    assert got["text"] == "1 2 3"
    assert got["attr"] == [None, "2", None]
    assert got["outer"] == '<a href="/q?a=1&amp;b=2">3</a>'
    assert got["inner"] == "one <b>bold</b>"
    assert got["img"] == '<img src="i.png">'
    assert got["none"] is None


def test_select_within(dom):
    n = F.col("nodes")
    top = html.first(select(n, "div"))
    found = lambda s: F.size(select(n, s, within=top))
    got = dom.select(found("div").alias("self"), found("p").alias("p"), found("li").alias("li"), found("html p").alias("above"), found("div > p b").alias("deep")).first()
    assert tuple(got) == (1, 2, 0, 0, 1)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p><b>T<br><p>one</p>", "<p><b>T<br></b></p><p><b>one</b></p>"),
        ("<div>a<!--c--> &lt;b&gt;</div>", "<div>a<!--c--> &lt;b&gt;</div>"),
        ("x</p>y", "x<p></p>y"),
        ("<b><b><b><b>1<p>2", "<b><b><b><b>1<p>2</p></b></b></b></b>"),
    ],
)
def test_tree(page, want):
    assert html._parse(page)[0].decode() == f"<html>{want}</html>"


def test_deep_page():
    out, text, nodes = html._parse("<div>" * 3000 + "x")
    assert len(nodes) == 3001 and text == b"x"


@pytest.mark.parametrize("bad", ["", "a >", "a:hover", "a[", ":nth-child(x)"])
def test_bad_selector(bad):
    with pytest.raises(ValueError):
        select(F.col("nodes"), bad)


def tree(page):
    from gleaner.operators.html import _parse

    return _parse(page)[0].decode()


@pytest.mark.parametrize(
    "page,want",
    [
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
        (
            "<table><caption>t<thead><tr><th>h<tbody><tr><td>1<tfoot><td>f</table>x",
            "<table><caption>t</caption><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody><tfoot><tr><td>f</td></tr></tfoot></table>x",
        ),
        ("<table><col><td>a<table><td>b</table>c</table>", "<table><colgroup><col></colgroup><tbody><tr><td>a<table><tbody><tr><td>b</td></tr></tbody></table>c</td></tr></tbody></table>"),
        ("<table>x<tr><p>y<td>z</table>", "x<p>y</p><table><tbody><tr><td>z</td></tr></tbody></table>"),
        ("<tr><td>a<td>b", "ab"),
        ("<select><option>1<option>2<optgroup><option>3</select>", "<select><option>1</option><option>2</option><optgroup><option>3</option></optgroup></select>"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
        ("<table><td><b>x<td>y</table>z", "<table><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z"),
    ],
)
def test_tree_construction(page, want):
    assert tree(page) == f"<html>{want}</html>"


def test_rows_of_a_table_page(spark):
    page = '<table id="t"><tr><th>Date<th>Name<tr><td>1/2<td><a href="/x">A &amp; B</a><tr><td>3/4<td>C</table>'
    d = html.parse_pages(spark.createDataFrame([(1, page)], "id long, page string"), "id", "page")
    assert texts(d, "table#t tbody tr td") == ["1/2", "A & B", "3/4", "C"]
    assert texts(d, "table > tbody > tr > td:nth-child(2) a") == ["A & B"]


def test_long_text_and_nesting_stay_quick():
    import time

    began = time.process_time()
    assert tree("x&amp;" * 50_000).count("&amp;") == 50_000
    assert time.process_time() - began < 10

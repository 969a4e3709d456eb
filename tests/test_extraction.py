"""Records out of literal pages."""

import pytest
from pyspark.sql import functions as F

from webfacts.functions import dom as D
from webfacts.operators import extraction as X

BASE = "https://x.org/a/b"
TEAM = """<html><body><div class="team-member"><h3>Ann Lee</h3><p class="title">Chief of Data</p><a href="https://linkedin.com/in/annlee">in</a></div>
<div class="team-member big"><h3>Bo</h3><p>Engineer<p>Second</div><div class="team-member"><em>nameless</em></div></body></html>"""
DATA = """<script type="application/ld+json">[{"@type":"Person","name":"Ann Lee","email":"ann@x.org"},{"@type":"Org","name":"No"},
{"@type":"Person","name":"Cy Dow Jr","jobTitle":"CTO"}]</script><script type="application/ld+json">{not json</script>"""
MAIL = "<body>Write to jo@corp.io, INFO@corp.io or a@b.inGet; https://linkedin.com/in/jo-1</body>"
PLANS = """<div class="plan"><h3>Starter</h3><span>$29/mo</span><ul><li>One seat</li><li>x</li><li>Mail help</li></ul><button> Try free </button></div>
<div class="plan"><h3>Pro</h3><span>€1,200.50 per year</span></div><div class="plan"><h3>Q</h3></div>"""
FILES = """<div class="card"><h2>State of data report</h2><a href="/r/1">more</a><form></form></div><div class="card"><h2>Lunch menu</h2></div>
<a href="white.pdf">Whitepaper</a><a href="/r/1" download>again</a>"""
POST = """<head><title> T </title><meta property="og:title" content="First"><meta content="Second" property="og:title"><meta name="twitter:card" content="">
<meta name="description" content="D"><link rel="icon" href="/f.ico"><link rel="icon" type="image/png" href="f.png"><link rel=canonical href="https://x.org/c"></head>
<body><nav>menu</nav><article><h1 class="entry-title">Hello <b>there</b></h1><time class="entry-date" datetime="2024-01-02">Jan</time><span class="author">Ann</span>
<div class="entry-content">%s</div><a rel="tag">News</a><p class="tag"><a>Data</a><a>News</a></p><h2 class="entry-title"><a href="/p/1">p</a></h2></article></body>""" % ("word " * 40)
TABLE = """<table><thead><tr><th>A</th><th>A</th><th></th></tr></thead><tbody><tr><td>1<td>2<td> 3 <tr><td>4</td><td>5</td><td>6</td></tr></tbody></table>
<table><tr><td>only</td></tr><tr><td>one row</td></tr></table><table><tr><th>k</th></tr><tr><td>1</td></tr><tr><td>2</td><td>3</td></tr><tr></tr></table>"""


@pytest.fixture(scope="module")
def of(spark):
    def run(html, *columns):
        pages = spark.createDataFrame([(1, BASE, html)], "page_id int, url string, html string")
        return D.with_nodes(pages).select(*columns).first()

    return run


@pytest.fixture(autouse=True)
def _columns(spark):
    global dom, url
    dom, url = F.col("dom"), F.col("url")


def _texts(selector):
    return F.transform(D.select(dom, selector), lambda x: D.text_of(dom, x))


def test_selectors(of):
    html = '<div id="m" class="a b"><p>one<p>two <b>bold</b></div><section><p data-k="v.pdf">three</p></section><br><p>four'
    wanted = {
        "p": ["one", "two bold", "three", "four"], "div p": ["one", "two bold"], "#m > p": ["one", "two bold"], ".b b": ["bold"], "div > b": [], "section p, b": ["bold", "three"],
        "[data-k]": ["three"], "p[data-k$='.pdf']": ["three"], "p[data-k^=x]": [], "div.a.b p b": ["bold"], ".ab": [], "*[data-k*='.p']": ["three"],
    }
    got = of(html, *[_texts(s).alias(str(i)) for i, s in enumerate(wanted)])
    assert [list(x) for x in got] == list(wanted.values())
    with pytest.raises(ValueError):
        D.matches(dom, dom, "p:hover")


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "</p>stray"), (4, "<p>" * 300)], "page_id int, html string")
    rows = D.with_nodes(pages).select("page_id", F.size("dom").alias("n"), X.content(dom).alias("c"), F.size(X.people(dom)).alias("p"), F.size(X.plans(dom)).alias("q"), X.tables(dom).alias("t")).collect()
    assert [(r["page_id"], r["n"], r["c"]) for r in rows] == [(1, None, None), (2, 0, None), (3, 1, None), (4, 300, None)]
    assert all(not r["p"] and not r["q"] and not r["t"] for r in rows)


def test_people(of):
    got = of(DATA + TEAM, X.people(dom).alias("p"))["p"]
    assert [tuple(p) for p in got] == [
        ("Ann", "Lee", "Chief of Data", "ann@x.org", "https://linkedin.com/in/annlee", "json_ld"), ("Cy", "Dow Jr", "CTO", None, None, "json_ld"), ("Bo", None, "Engineer", None, None, "team_page"),
    ]
    got = of(MAIL, X.people(dom).alias("p"))["p"]
    assert [(p["email"], p["linkedin_url"]) for p in got] == [("jo@corp.io", None), (None, "https://linkedin.com/in/jo-1")]


def test_plans(of):
    got = of(PLANS, X.plans(dom).alias("p"))["p"]
    assert [tuple(p) for p in got] == [("Starter", "$29", "monthly", ["One seat", "Mail help"], True, "Try free"), ("Pro", "€1,200.50", "annual", [], False, None)]
    assert of('<div class="plan"><h3>Single</h3></div>', X.plans(dom).alias("p"))["p"] == []


def test_resources(of):
    got = of(FILES, X.resources(dom, url).alias("r"))["r"]
    assert [(r["url"], r["title"], r["resource_type"], r["gated"], r["download_url"]) for r in got] == [
        ("https://x.org/r/1", "State of data report", "report", True, None), ("https://x.org/a/white.pdf", "Whitepaper", "whitepaper", False, "https://x.org/a/white.pdf"),
    ]


def test_article(of):
    got = of(POST, X.article(dom).alias("a"), X.categories(dom).alias("c"), X.content(dom).alias("t"), X.rich_metadata(dom, url).alias("m"), X.article_links(dom, url).alias("l"))
    body = " ".join(["word"] * 40)
    assert tuple(got["a"]) == ("Hello there", "Ann", "2024-01-02", 40, body)
    assert got["c"] == ["News", "Data"] and got["t"] == body and got["l"] == ["https://x.org/p/1"]
    assert got["m"] == {"title": "T", "og_title": "Second", "description": "D", "favicon": "https://x.org/a/f.png", "canonical_url": "https://x.org/c"}


def test_schema(of):
    html = '<h1> Acme </h1><a class="website" href="/w">w</a><i class="n">1,500</i><i class="p">$29/mo</i><i class="b">True</i><ul class="f"><li>a, b,,c</li></ul><div class="it"><b>X</b></div><div class="it"></div>'
    schema = [
        X.Field("name", "h1", transform="upper"), X.Field("site", "a.website", "href"), X.Field("n", ".n", kind="number"), X.Field("p", ".p", kind="number"),
        X.Field("b", ".b", kind="boolean"), X.Field("f", ".f li", kind="list"), X.Field("gone", ".gone", required=True),
    ]
    got = of(html, X.fields(dom, schema).alias("f"), X.missing(X.fields(dom, schema), schema).alias("m"), X.listed_fields(dom, ".it", [X.Field("x", "b")]).alias("l"))
    assert got["f"] == {"name": "ACME", "site": "/w", "n": "1500", "p": "$29/mo", "b": "true", "f": '["a","b","c"]'}
    assert got["m"] == ["gone"] and got["l"] == [{"x": "X"}]


def test_tables(of):
    got = of(TABLE, X.tables(dom).alias("t"))["t"]
    assert [(t["headers"], t["rows"], t["score"]) for t in got] == [(["A", "A (2)", "Column"], [["1", "2", "3"], ["4", "5", "6"]], 30.0), (["k"], [["1"], ["2", "3"]], 20.0)]


def test_other_patterns(spark, of):
    html = '<dl><dt>a</dt><dd>1</dd><dt>b<dd>2</dl><dl><dt>x</dt></dl><div role="grid"><p role="row"><b role="columnheader">h</b></p><p role="row"><b role="gridcell">1</b></p><p role="row"></p></div>'
    got = of(html, X.definitions(dom).alias("d"), X.grids(dom).alias("g"))
    assert [tuple(x) for x in got["d"]] == [(["a", "b"], ["1", "2"], 14.0)]
    assert [tuple(x) for x in got["g"]] == [([["h"], ["1"], []], 24.0)]
    cards = "<ul>" + '<li class="b a"><i>x</i></li>' * 2 + '<li class="a b"><i>y</i></li><li class="c"></li></ul>' + "<p>bare</p>" * 4
    pages = D.with_nodes(spark.createDataFrame([(1, cards)], "page_id int, html string"))
    assert [tuple(r) for r in X.repeated(pages).collect()] == [(1, 0, "li", "a b", 3, 19.5)]


def test_markdown(of):
    html = '<body><nav>menu</nav><main><h2>Head  line</h2><p>Some <b>bold</b> and <a href="/x">a link</a>.</p><ul><li>one</li><li><em>two</em></li></ul><aside>ad</aside><div><script>1</script>end<br>line</div></main>'
    assert of(html, X.markdown(dom).alias("m"))["m"] == "## Head line\n\nSome **bold** and [a link](/x).\n\n- one\n- *two*\n\nend\nline"
    assert of("<p>no main</p>", X.markdown(dom).alias("m"))["m"] is None


def test_page_records(spark):
    page = "<title>%s</title><body>" + "word " * 210 + '<div class="plan"><h3>Solo</h3>$5/mo</div><div class="plan"><h3>Team</h3></div></body>'
    rows = [(1, "https://x.org/pricing", page % "Prices"), (2, "https://x.org/", page % "Home"), (3, "https://x.org/gone", page % "404 not found"), (4, "https://x.org/s", "<p>short"), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("_raw", F.col("html"))
    nodes = D.with_nodes(pages, "_raw", keep=["page_id", "url", "html"])
    types = ["article", "pricing", "tech_stack", "contact"]
    got = X.page_records(nodes, types).select("page_id", "data_type", "title").collect()
    assert sorted(tuple(r) for r in got) == [
        (1, "article", "Prices"), (1, "page", "Prices"), (1, "pricing", "Solo"), (1, "pricing", "Team"), (2, "article", "Home"), (2, "page", "Home"), (2, "tech_stack", "Tech Stack: x.org"),
    ]
    assert sorted(r["page_id"] for r in X.page_records(nodes, types, raw_only=True).collect()) == [1, 2]

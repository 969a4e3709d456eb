"""Queries over pages as node tables, and over edited tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dom, html, signatures
from ..operators import edits, extraction
from . import views
from .registry import query
from .views import AS_OF, WITH, table

_TITLE = "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"
_DECODED = _TITLE
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char}')"
_HREFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)"


@query("h07_metadata_and_links", f"SELECT page_id, {_DECODED} AS title, CAST(len({_HREFS}) AS INT) AS links FROM pages")
def h07_metadata_and_links(spark, sf_dir):
    """The title of the metadata map and the number of anchors with a reference, by nodes."""
    nodes = dom.with_nodes(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return nodes.select("page_id", extraction.rich_metadata(F.col("dom"), F.col("url"))["title"].alias("title"), F.size(dom.select(F.col("dom"), "a[href]")).alias("links"))


@query("h17_page_records")
def h17_page_records(spark, sf_dir):
    """All records of all types out of each page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.col("html").alias("_raw"))
    nodes = dom.with_nodes(pages, "_raw", keep=["page_id", "url", "html"])
    return extraction.page_records(nodes, ["blog_url", "article", "contact", "resource", "pricing", "tech_stack"])


@query("h48_list_items", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<li[\\s>]')) AS INT) AS items FROM pages")
def h48_list_items(spark, sf_dir):
    """List items in lists, by nodes."""
    nodes = dom.with_nodes(table(spark, sf_dir, "pages").select("page_id", "html"))
    return nodes.select("page_id", F.size(dom.select(F.col("dom"), "ul > li, ol > li")).alias("items"))


_LATER = f"TIMESTAMP '{AS_OF}'"


@query("c03_sparse_update", WITH + ", changes AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'cancelled' END AS status, CASE WHEN id % 3 = 0 THEN 204 END AS status_code FROM v_jobs WHERE id % 5 = 0) SELECT j.id, coalesce(c.status, j.status) AS status, coalesce(c.status_code, j.status_code) AS status_code FROM v_jobs j LEFT JOIN changes c ON j.id = c.id")
def c03_sparse_update(spark, sf_dir):
    """Jobs after an update that sets only what it names."""
    jobs = views.jobs(spark, sf_dir).select("id", "status", "status_code")
    changes = jobs.where("id % 5 = 0").selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'cancelled' END AS status", "CASE WHEN id % 3 = 0 THEN 204 END AS status_code")
    return edits.patched(jobs, changes, "id")


@query("c14_soft_delete", "SELECT c_custkey AS id, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS is_active FROM customer")
def c14_soft_delete(spark, sf_dir):
    """Customers, inactive where an order of theirs has failed."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "true AS is_active")
    return edits.soft_deleted(rows, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS id"), "id")


@query("c20_firings", "SELECT user_id AS signal_id, count(*) AS fire_count, max(ts) AS last_fired_at FROM events WHERE event_type = 'click' GROUP BY 1")
def c20_firings(spark, sf_dir):
    log = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id AS signal_id", "ts AS fired_at")
    return edits.firings(log)


@query("c25_masked", "SELECT c_custkey, CASE WHEN length(c_name) > 0 THEN '****' || right(c_name, 8) END AS hint FROM customer")
def c25_masked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", edits.masked(F.col("c_name")).alias("hint"))


@query("c26_toggle", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN NOT (s_acctbal > 0) ELSE s_acctbal > 0 END AS active FROM supplier")
def c26_toggle(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    out = edits.toggled(rows.selectExpr("s_suppkey", "s_acctbal > 0 AS active"), rows.where("s_nationkey % 2 = 0"), "s_suppkey", "active")
    return out


@query("c27_retries", WITH + f"SELECT id AS retry_of, user_id, domain, 'pending' AS status, {_LATER} AS created_at FROM v_jobs WHERE status = 'failed'")
def c27_retries(spark, sf_dir):
    return edits.retries(views.jobs(spark, sf_dir), ["user_id", "domain"], F.lit(AS_OF).cast("timestamp_ntz"))


@query("k13_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def k13_cascade(spark, sf_dir):
    """Lines of orders that remain once the failed ones are deleted."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS l_orderkey")
    return edits.cascaded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("h35_markdown")
def h35_markdown(spark, sf_dir):
    """The main content of each page as Markdown."""
    nodes = dom.with_nodes(table(spark, sf_dir, "pages").select("page_id", "html"))
    return nodes.select("page_id", extraction.markdown(F.col("dom")).alias("markdown"))


@query("h48_repeated", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul>(.*?)</ul>', 1)) AS ul FROM pages) WHERE len(regexp_extract_all(ul, '(?i)<li>')) >= 3 GROUP BY 1")
def h48_repeated(spark, sf_dir):
    """How many lists of a page have three or more items with a link each."""
    nodes = dom.with_nodes(table(spark, sf_dir, "pages").select("page_id", "html"))
    return extraction.repeated(nodes).where("tag = 'li'").groupBy("page_id").agg(F.count("*").alias("n"))


_SIGNS = {"wordpress": ["wp-content", "wp-includes", "wordpress", "wp-json", "wp-admin"], "hubspot": ["js.hs-scripts.com", "hs-script-loader", "hubspot", ".hs-", "hbspt"], "webflow": ["webflow.com", "wf-page", "wf-section", "w-dyn-list"]}
_MARKED = "html || ['<p class=w-dyn-list>', ' WP-admin ', ' hbspt ', ' plain ', ' wf-page hubspot '][page_id % 5 + 1]"
_SYSTEM = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{x}')" for x in signs) + f" THEN '{name}'" for name, signs in _SIGNS.items()) + " ELSE 'generic' END"


@query("x15_templates", f"SELECT page_id, {_SYSTEM} AS template FROM (SELECT page_id, lower({_MARKED}) AS low FROM pages)")
def x15_templates(spark, sf_dir):
    """The content system of each page, with marks put in by its number."""
    mark = F.element_at(F.array(*map(F.lit, ["<p class=w-dyn-list>", " WP-admin ", " hbspt ", " plain ", " wf-page hubspot "])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", extraction.template(F.concat("html", mark)).alias("template"))


# a small page around each page's number, of which every field is known
_CARD = """'<html><head><title> T' || page_id || ' </title><meta name="description" content="about ' || page_id || '"><meta property="og:title" content="' || CASE WHEN page_id % 2 = 0 THEN 'OG' || page_id ELSE '' END || '">
<link rel="canonical" href="https://c.org/' || page_id || '"></head><body><h1>H' || page_id || '</h1><article><a href="/blog/' || page_id || '">x</a><h2><a href="../up/y.html">y</a></h2></article></body></html>'"""


def _known(spark, sf_dir):
    key = F.col("page_id").cast("string")
    text = [
        F.lit("<html><head><title> T"), key, F.lit(' </title><meta name="description" content="about '), key, F.lit('"><meta property="og:title" content="'), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("OG"), key)).otherwise(""),
        F.lit('">\n<link rel="canonical" href="https://c.org/'), key, F.lit('"></head><body><h1>H'), key, F.lit('</h1><article><a href="/blog/'), key, F.lit('">x</a><h2><a href="../up/y.html">y</a></h2></article></body></html>'),
    ]
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://a.org/s/"), key, F.lit("/z")).alias("url"), F.concat(*text).alias("html"))
    return dom.with_nodes(pages)


@query("h37_metadata", "SELECT page_id, 'https://a.org/s/' || page_id || '/z' AS url, 'T' || page_id AS title, 'about ' || page_id AS description, CASE WHEN page_id % 2 = 0 THEN 'OG' || page_id ELSE '' END AS og_title, '' AS og_description, '' AS og_image, 'https://c.org/' || page_id AS canonical, '' AS author FROM pages")
def h37_metadata(spark, sf_dir):
    return _known(spark, sf_dir).select("page_id", extraction.fixed_metadata(F.col("dom"), F.col("url")).alias("m")).select("page_id", "m.*")


@query("h38_preferred", "SELECT page_id, 'https://c.org/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'OG' ELSE 'T' END || page_id AS title, '' AS author, 'about ' || page_id AS description, '' AS og_image, 3 AS word_count, 0.0::DOUBLE AS reading_time_minutes FROM pages")
def h38_preferred(spark, sf_dir):
    meta = extraction.fixed_metadata(F.col("dom"), F.col("url"))
    return _known(spark, sf_dir).select("page_id", extraction.preferred_metadata(meta, F.lit("three little words")).alias("m")).select("page_id", "m.*")


@query("h41_templated", "SELECT page_id, 'H' || page_id AS title, '[https://a.org/blog/' || page_id || ', https://a.org/s/up/y.html]' AS links FROM pages")
def h41_templated(spark, sf_dir):
    """Title and article links by the generic template."""
    t = extraction.templated(F.col("dom"), F.col("url"), F.lit("generic"))
    return _known(spark, sf_dir).select("page_id", t.alias("t")).select("page_id", "t.title", F.concat(F.lit("["), F.array_join("t.links", ", "), F.lit("]")).alias("links"))


@query("h42_templated", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'H' || page_id END AS title, 0 AS links FROM pages")
def h42_templated(spark, sf_dir):
    """The same pages by the templates of two content systems and the one of directories, which name no listing here."""
    name = F.element_at(F.array(F.lit("hubspot"), F.lit("webflow"), F.lit("directory")), (F.col("page_id") % 3 + 1).cast("int"))
    t = extraction.templated(F.col("dom"), F.col("url"), name)
    return _known(spark, sf_dir).select("page_id", t.alias("t")).select("page_id", "t.title", F.size("t.links").alias("links"))


@query("h46_documents", """SELECT page_id, '# T' || page_id || chr(10) || chr(10) || '*Pages: 2 | Words: 7*' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || '## Extracted Tables' || chr(10) || chr(10) || chr(10)
|| '### Table 2' || chr(10) || chr(10) || '| a | b |' || chr(10) || chr(10) || '| --- | --- |' || chr(10) || chr(10) || '| ' || page_id || ' |  |' || chr(10) || chr(10) AS markdown FROM pages""")
def h46_documents(spark, sf_dir):
    """Parsed documents as Markdown: a table of one row is left out, short rows are filled."""
    key = F.col("page_id").cast("string")
    tables = F.array(F.array(F.array(F.lit("alone"))), F.array(F.array(F.lit("a"), F.lit("b")), F.array(key)))
    return table(spark, sf_dir, "pages").select("page_id", extraction.paged_markdown(F.concat(F.lit("T"), key), F.lit(""), F.lit(2), F.lit(7), F.lit("body"), tables).alias("markdown"))


@query("h53_delimited", """SELECT page_id, 'name,n' || chr(10) || '"a, ""b""' || '",' || page_id || chr(10) || 'plain,' AS csv, 'name' || chr(9) || 'n' || chr(10) || 'a, "b"' || chr(9) || page_id || chr(10) || 'plain' || chr(9) AS tsv FROM pages""")
def h53_delimited(spark, sf_dir):
    """A table's rows as CSV and as text with tabs."""
    from ..operators import exports

    names, rows = F.array(F.lit("name"), F.lit("n")), F.array(F.array(F.lit('a, "b"'), F.col("page_id").cast("string")), F.array(F.lit("plain"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", exports.delimited(names, rows).alias("csv"), exports.delimited(names, rows, tabs=True).alias("tsv"))


# one page of every kind of record around each page's number, so that an oracle can spell the records out
_RICH = [
    "<html><head><title>Acme ", "</title><meta name='author' content='Ann'><script type='application/ld+json'>{\"@type\": \"Person\", \"name\": \"Jo Data", "\", \"jobTitle\": \"CTO\", \"email\": \"jo", "@corp.io\"}</script></head><body>",
    "<div class='team-member'><h3>Sam Card", "</h3><p class='title'>VP Sales</p><a href='https://linkedin.com/in/sam", "'>in</a></div><div class='team-member'><h3>JO Data", "</h3></div>",
    "<div class='plan'><h2>Basic ", "</h2><p>$10/mo free trial</p><ul><li>one thing</li><li>two things</li></ul><button>Buy</button></div><div class='plan'><h2>Pro ", "</h2><p>$1,200.50 per year</p></div>",
    "<div class='resource'><h3>White paper ", "</h3><a href='/r/", ".pdf'>get</a></div><p>Mail kim", "@firm.org or info@firm.org</p><a rel='tag' href='/t'>Tag ", "</a>",
    "<table><tr><th>k</th><th>k</th><th></th></tr><tr><td>a</td><td>b</td><td>", "</td></tr><tr><td>c</td><td>d</td><td>e</td></tr></table><dl><dt>t", "</dt><dd>d1</dd><dt>u</dt><dd>d2</dd></dl>",
    "<div role='grid'><div role='row'><span role='gridcell'>g", "</span></div><div role='row'><span role='gridcell'>h</span></div><div role='row'><span role='gridcell'>i</span></div></div><div class='entry-content'>" + "word " * 250 + "</div></body></html>",
]


def _rich(spark, sf_dir, *more):
    """Nodes of rich pages with page_id, url and ``more`` of their columns."""
    key = F.col("page_id").cast("string")
    parts = [F.lit(_RICH[0])]
    for x in _RICH[1:]:
        parts += [key, F.lit(x)]
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://a.org/"), F.element_at(F.array(*map(F.lit, ["team/", "pricing/", "resources/", "blog/", ""])), (F.col("page_id") % 5 + 1).cast("int"))).alias("url"), F.concat(*parts).alias("html"))
    return dom.with_nodes(pages.withColumn("_raw", F.col("html")), "_raw", keep=["page_id", "url", *more])


def _exploded(rows, found, *names):
    return rows.select("page_id", F.explode(found).alias("r")).select("page_id", *[F.col(f"r.{n}").alias(n) for n in names])


@query("h20_people_of_data", "SELECT page_id, 'Jo' AS first_name, 'Data' || page_id AS last_name, 'CTO' AS job_title, 'jo' || page_id || '@corp.io' AS email FROM pages")
def h20_people_of_data(spark, sf_dir):
    return _exploded(_rich(spark, sf_dir), extraction.people_from_data(F.col("dom")), "first_name", "last_name", "job_title", "email")


@query("h21_people_of_cards", "SELECT page_id, 'Sam' AS first_name, 'Card' || page_id AS last_name, 'VP Sales' AS job_title, 'https://linkedin.com/in/sam' || page_id AS linkedin_url FROM pages UNION ALL SELECT page_id, 'JO', 'Data' || page_id, NULL, NULL FROM pages")
def h21_people_of_cards(spark, sf_dir):
    return _exploded(_rich(spark, sf_dir), extraction.people_from_cards(F.col("dom")), "first_name", "last_name", "job_title", "linkedin_url")


@query("h22_people_of_text", "SELECT page_id, 'kim' || page_id || '@firm.org' AS email FROM pages")
def h22_people_of_text(spark, sf_dir):
    """Personal addresses in the text; those of generic mailboxes are left out."""
    return _exploded(_rich(spark, sf_dir), extraction.people_from_text(F.col("dom")), "email")


@query("h23_merged_people", "SELECT page_id, 'Jo' AS first_name, 'jo' || page_id || '@corp.io' AS email, NULL AS linkedin_url FROM pages UNION ALL SELECT page_id, 'Sam', NULL, 'https://linkedin.com/in/sam' || page_id FROM pages")
def h23_merged_people(spark, sf_dir):
    """People of data and cards, merged by address and name."""
    return _exploded(_rich(spark, sf_dir), extraction.people(F.col("dom")), "first_name", "email", "linkedin_url")


@query("h24_resources", "SELECT page_id, 'https://a.org/r/' || page_id || '.pdf' AS url, 'White paper ' || page_id AS title, 'whitepaper' AS resource_type, 'https://a.org/r/' || page_id || '.pdf' AS download_url FROM pages")
def h24_resources(spark, sf_dir):
    return _exploded(_rich(spark, sf_dir), extraction.resources(F.col("dom"), F.col("url")), "url", "title", "resource_type", "download_url")


@query("h27_plans", "SELECT page_id, 'Basic ' || page_id AS plan_name, '$10' AS price, 'monthly' AS billing_cycle, 'one thing; two things' AS features, true AS has_free_trial, 'Buy' AS cta_text FROM pages UNION ALL SELECT page_id, 'Pro ' || page_id, '$1,200.50', 'annual', '', false, NULL FROM pages")
def h27_plans(spark, sf_dir):
    out = _exploded(_rich(spark, sf_dir), extraction.plans(F.col("dom")), "plan_name", "price", "billing_cycle", "features", "has_free_trial", "cta_text")
    return out.withColumn("features", F.array_join("features", "; "))


@query("h05_categories", "SELECT page_id, 'Tag ' || page_id AS category FROM pages")
def h05_categories(spark, sf_dir):
    return _rich(spark, sf_dir).select("page_id", F.explode(extraction.categories(F.col("dom"))).alias("category"))


@query("h06_main_text", "SELECT page_id, trim(repeat('word ', 250)) AS content FROM pages")
def h06_main_text(spark, sf_dir):
    """The text of the first content element that is long enough."""
    return _rich(spark, sf_dir).select("page_id", extraction.content(F.col("dom")).alias("content"))


@query("h30_fields", "SELECT page_id, '' || page_id AS n, 'Ann' AS author, 'ACME ' || page_id AS name, 'missing' AS lacking FROM pages")
def h30_fields(spark, sf_dir):
    """Fields of a schema, with types, transforms and what is lacking."""
    schema = [extraction.Field("author", "meta[name='author']", "content"), extraction.Field("name", "title", transform="upper"), extraction.Field("n", "dt"), extraction.Field("missing", ".none", required=True)]
    rows = _rich(spark, sf_dir).select("page_id", extraction.fields(F.col("dom"), schema).alias("f"))
    return rows.select("page_id", F.replace(F.col("f")["n"], F.lit("t"), F.lit("")).alias("n"), F.col("f")["author"].alias("author"), F.col("f")["name"].alias("name"), F.array_join(extraction.missing(F.col("f"), schema), ",").alias("lacking"))


@query("h31_listed_fields", "SELECT page_id, unnest(['Basic ' || page_id, 'Pro ' || page_id]) AS plan, unnest(['Buy', NULL]) AS button FROM pages")
def h31_listed_fields(spark, sf_dir):
    schema = [extraction.Field("plan", "h2"), extraction.Field("button", "button")]
    rows = _rich(spark, sf_dir).select("page_id", F.explode(extraction.listed_fields(F.col("dom"), ".plan", schema)).alias("f"))
    return rows.select("page_id", F.col("f")["plan"].alias("plan"), F.col("f")["button"].alias("button"))


@query("h47_tables", "SELECT page_id, 'k|k (2)|Column' AS headers, 'a|b|' || page_id || '/c|d|e' AS rows, 30.0::DOUBLE AS score FROM pages")
def h47_tables(spark, sf_dir):
    """Tables with named columns."""
    out = _exploded(_rich(spark, sf_dir), extraction.tables(F.col("dom")), "headers", "rows", "score")
    return out.select("page_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("rows"), "score")


@query("h49_definitions", "SELECT page_id, 't' || page_id || '|u' AS terms, 'd1|d2' AS definitions, 14.0::DOUBLE AS score FROM pages")
def h49_definitions(spark, sf_dir):
    out = _exploded(_rich(spark, sf_dir), extraction.definitions(F.col("dom")), "terms", "definitions", "score")
    return out.select("page_id", F.array_join("terms", "|").alias("terms"), F.array_join("definitions", "|").alias("definitions"), "score")


@query("h50_grids", "SELECT page_id, 'g' || page_id || '|h|i' AS cells, 24.0::DOUBLE AS score FROM pages")
def h50_grids(spark, sf_dir):
    out = _exploded(_rich(spark, sf_dir), extraction.grids(F.col("dom")), "rows", "score")
    return out.select("page_id", F.array_join(F.flatten("rows"), "|").alias("cells"), "score")


@query("h51_ranked", "SELECT page_id, 'table,grid,definitions' AS kinds FROM pages")
def h51_ranked(spark, sf_dir):
    """Patterns of a page by score."""
    return _rich(spark, sf_dir).select("page_id", F.array_join(F.transform(extraction.ranked_patterns(F.col("dom")), lambda x: x["kind"]), ",").alias("kinds"))


@query("h17_records", """WITH p AS (SELECT page_id, 'Acme ' || page_id AS t, 'https://a.org/' || ['team/', 'pricing/', 'resources/', 'blog/', ''][page_id % 5 + 1] AS u, page_id % 5 AS k FROM pages)
SELECT page_id, 'page' AS data_type, t AS title, u AS url FROM p UNION ALL SELECT page_id, 'article', t, u FROM p UNION ALL SELECT page_id, 'contact', unnest(['Jo Data' || page_id, 'Sam Card' || page_id]), u FROM p WHERE k = 0
UNION ALL SELECT page_id, 'pricing', unnest(['Basic ' || page_id, 'Pro ' || page_id]), u FROM p WHERE k = 1 UNION ALL SELECT page_id, 'resource', 'White paper ' || page_id, 'https://a.org/r/' || page_id || '.pdf' FROM p WHERE k = 2
UNION ALL SELECT page_id, 'blog_url', t, u FROM p WHERE k = 3 UNION ALL SELECT page_id, 'tech_stack', 'Tech Stack: a.org', u FROM p WHERE k = 4""")
def h17_records(spark, sf_dir):
    """Records of all types, by the class of the page's address."""
    types = ["blog_url", "article", "contact", "resource", "pricing", "tech_stack"]
    return extraction.page_records(_rich(spark, sf_dir, "html"), types).select("page_id", "data_type", "title", "url")


@query("h10_metadata", """SELECT page_id, 'article' AS data_type, 'Ann' AS author, 250 AS words, 'Tag ' || page_id AS more, 'Acme ' || page_id AS title FROM pages UNION ALL SELECT page_id, 'tech_stack', 'Ann', NULL, NULL, 'Acme ' || page_id FROM pages WHERE page_id % 5 = 4
UNION ALL SELECT page_id, 'blog_url', 'Ann', 0, 'https://a.org/blog/', 'Acme ' || page_id FROM pages WHERE page_id % 5 = 3""")
def h10_metadata(spark, sf_dir):
    """Metadata of article, listing and technology records: the page's own and the record's."""
    rows = extraction.page_records(_rich(spark, sf_dir, "html"), ["blog_url", "article", "tech_stack"]).where("data_type <> 'page'")
    value = lambda n: F.get_json_object("metadata", f"$.{n}")
    return rows.select(
        "page_id", "data_type", value("author").alias("author"), F.coalesce(value("word_count"), value("total_articles")).cast("int").alias("words"),
        F.coalesce(value("categories[0]"), value("blog_landing_url")).alias("more"), value("title").alias("title"))


@query("k14_valid", """SELECT c_custkey AS id, c_custkey % 8 IN (0, 2, 5, 6) AS valid FROM customer""")
def k14_valid(spark, sf_dir):
    """Metadata that is and is not what its type asks for."""
    cases = [
        ("blog_url", '{"blog_landing_url": "u", "article_urls": ["a"]}'), ("blog_url", '{"article_urls": []}'), ("contact", '{"email": null, "extra": 1}'), ("contact", '{"email": 5}'),
        ("article", '{"categories": "x"}'), ("pricing", '{"price": 1}'), ("resource", '{"gated": true}'), ("tech_stack", "[1]"),
    ]
    at = (F.col("c_custkey") % 8 + 1).cast("int")
    kind, data = (F.element_at(F.array(*[F.lit(c[k]) for c in cases]), at) for k in (0, 1))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), edits.is_valid(kind, data).alias("valid"))


@query("x27_objects", "SELECT event_id, json_type(props) IS NOT NULL AND json_type(props) = 'OBJECT' AS ok FROM events")
def x27_objects(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", edits.is_object(F.col("props")).alias("ok"))


@query("x06_plain", """SELECT page_id, 'x' || page_id || chr(10) || 'b & c' || chr(10) || 'd' AS text FROM pages""")
def x06_plain(spark, sf_dir):
    """Text of a page, a line for each piece."""
    from ..functions import texts

    page = F.concat(F.lit("<style>no</style><p> x"), F.col("page_id").cast("string"), F.lit(" <b>b &amp; c</b></p>\n<script>no</script><i>d</i>"))
    return table(spark, sf_dir, "pages").select("page_id", texts.plain(page).alias("text"))


_FETCHED = "CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 503 ELSE 200 END"


@query("s01_fetch_results", f"""WITH e AS (SELECT event_id % 250 AS page_id, max(event_id) AS last FROM events GROUP BY 1), f AS (SELECT e.page_id, {_FETCHED} AS status_code, ['lightpanda', 'playwright', 'playwright_proxy'][CAST(event_id % 3 + 1 AS INT)] AS tier FROM e JOIN events ON last = event_id)
SELECT p.page_id, url, status_code, tier AS tier_used, CASE tier WHEN 'lightpanda' THEN 0.001 WHEN 'playwright' THEN 0.003 ELSE 0.0035 END::DOUBLE AS cost_usd, status_code IN (403, 429, 503) OR length(html) < 20 AS blocked, false AS captcha_detected FROM pages p JOIN f ON p.page_id = f.page_id""")
def s01_fetch_results(spark, sf_dir):
    """Captured pages with their last fetch: status, tier, cost, whether it was blocked or challenged."""
    from ..operators import fetch_policy, records

    log = table(spark, sf_dir, "events").selectExpr("event_id % 250 AS page_id", "event_id", f"{_FETCHED} AS status_code")
    last = records.first_by(log, ["page_id"], F.col("event_id").desc())
    tier = F.element_at(F.array(*map(F.lit, fetch_policy.TIERS)), (F.col("event_id") % 3 + 1).cast("int"))
    return fetch_policy.fetch_results(table(spark, sf_dir, "pages"), last.select("page_id", "status_code", tier.alias("tier_used")), "page_id").drop("html")


@query("h02_meta", "SELECT page_id, 'Ann' AS author, 'about ' || page_id AS description, CASE WHEN page_id % 2 = 0 THEN 'OG' || page_id END AS og_title FROM pages")
def h02_meta(spark, sf_dir):
    """Meta tags by name and by property, out of the text of a page."""
    from ..functions import html

    key = F.col("page_id").cast("string")
    page = F.concat(F.lit("<meta name='author' content='Ann'><meta content='about "), key, F.lit("' name=\"description\"><meta property='og:title' content='"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("OG"), key)).otherwise(""), F.lit("'>"))
    return table(spark, sf_dir, "pages").select("page_id", *[html.meta(page, n).alias(n.replace(":", "_")) for n in ("author", "description", "og:title")])


@query("h04_first_texts", "SELECT page_id, 'Basic ' || page_id AS value FROM pages")
def h04_first_texts(spark, sf_dir):
    """The text of the first selector that has any."""
    return _rich(spark, sf_dir).select("page_id", dom.some_text(F.col("dom"), [".none", "h6", ".plan h2", "h3"]).alias("value"))


@query("h16_documents", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE 'PDF: ' || page_id || '.pdf' END AS title, 3 AS word_count, 'pdf' AS source_type FROM pages")
def h16_documents(spark, sf_dir):
    """Document records out of what a parser of files gives."""
    key = F.col("page_id").cast("string")
    parsed = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://a.org/f/"), key, F.lit(".pdf")).alias("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), key)).otherwise("").alias("title"), F.lit("Ann").alias("author"), F.lit(2).alias("pages"), F.lit("three little words").alias("text"), F.lit(None).cast("array<array<array<string>>>").alias("tables"))
    out = extraction.document_records(parsed)
    value = lambda n: F.get_json_object("metadata", f"$.{n}")
    return out.select("page_id", "title", value("word_count").cast("int").alias("word_count"), value("source_type").alias("source_type"))


def _filled(spark, sf_dir, parts):
    key = F.col("page_id").cast("string")
    out = [F.lit(parts[0])]
    for x in parts[1:]:
        out += [key, F.lit(x)]
    return dom.with_nodes(table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://p.org/c/"), key).alias("url"), F.concat(*out).alias("html")))


@query("s18_contact_pages", "SELECT page_id, 'Ada' AS first_name, 'de B' || page_id AS last_name, 'VP' AS job_title, 'Acme' AS company, 'ada' || page_id || '@a.org' AS email, '+1' || page_id AS phone, 'https://p.org/c/' || page_id AS profile_url FROM pages")
def s18_contact_pages(spark, sf_dir):
    """Contacts of pages of their own."""
    pages = _filled(spark, sf_dir, ["<h1> Ada  de B", "</h1><p data-cy='contact-title'>VP</p><div data-cy='contact-company'><a>Acme</a></div><a href='mailto:ada", "@a.org'>m</a><a href='tel:+1", "'>t</a>"])
    c = extraction.contact_page(F.col("dom"), F.col("url"))
    return pages.select("page_id", c.alias("c")).select("page_id", *[F.col(f"c.{n}").alias(n) for n in ("first_name", "last_name", "job_title", "company", "email", "phone", "profile_url")])


@query("s17_contact_cards", "SELECT page_id, unnest(['Ada B' || page_id, 'Cy']) AS name, unnest(['https://p.org/in/a' || page_id, '']) AS profile_url, unnest(['VP', '']) AS headline FROM pages")
def s17_contact_cards(spark, sf_dir):
    """Contacts of cards of search results; a card without a name is none."""
    cards = ["<li class=r><a class=n href='/in/a", "'>Ada B", "</a><i class=h>VP</i></li><li class=r><b class=n2>Cy</b></li><li class=r><i class=h>none", "</i></li>"]
    found = extraction.contact_cards(F.col("dom"), F.col("url"), "li.r", {"name": ["a.n", ".n2"], "headline": [".h"]})
    return _exploded(_filled(spark, sf_dir, cards), found, "name", "profile_url", "headline")


@query("s19_profiles", "SELECT page_id, 'B' || page_id AS name, 'Paris' AS location FROM pages")
def s19_profiles(spark, sf_dir):
    """Contacts of profile pages, by selectors of theirs."""
    c = extraction.contact_page(F.col("dom"), F.col("url"), {"name": [".none", "h2"], "location": [".place"]})
    return _filled(spark, sf_dir, ["<h2>B", "</h2><p class=place>Paris</p>"]).select("page_id", c.alias("c")).select("page_id", "c.name", "c.location")


_MARK = "['wp-content', 'cdn.shopify.com', 'JQuery', 'lodash', 'bootstrap.css hubspot', 'ghost.io shopify', 'gtag(', 'tailwind.'][page_id % 8 + 1]"
_SIGNALS = ", ".join(f"('{n}', '{c}', '{s}')" for n, c, signals in html.TECHNOLOGIES for s in signals)


@query("j13_signatures", f"SELECT page_id, name, category, signal FROM (SELECT page_id, lower(html || {_MARK}) AS low FROM pages) JOIN (SELECT DISTINCT * FROM (VALUES {_SIGNALS}) AS v(name, category, signal)) ON contains(low, signal)")
def j13_signatures(spark, sf_dir):
    """Pages, with marks of systems and libraries put in by their number, joined with the relation of signatures."""
    mark = F.element_at(F.array(*map(F.lit, ["wp-content", "cdn.shopify.com", "JQuery", "lodash", "bootstrap.css hubspot", "ghost.io shopify", "gtag(", "tailwind."])), (F.col("page_id") % 8 + 1).cast("int"))
    known = html.signatures(spark).select("name", "category", F.explode("signals").alias("signal"))
    return signatures.matched(table(spark, sf_dir, "pages"), "page_id", signatures.searched(F.concat("html", mark)), known)


_WORDS = ["and", "the", "to"]
_HAS = " + ".join(f"CAST(list_contains({_HREFS}, '/{w}') AS INT)" for w in _WORDS)


@query("h34_auto_fields", f"SELECT page_id, CASE WHEN n < 2 THEN 'ai' ELSE 'css' END AS mode, n / 3.0::DOUBLE AS coverage, CASE WHEN n < 2 THEN t END AS title FROM (SELECT page_id, {_HAS} AS n, {_TITLE} AS t FROM pages)")
def h34_auto_fields(spark, sf_dir):
    """References of a page by selectors; where it has less than half of them, its title by a second extractor."""
    schema = [extraction.Field(w, f"a[href='/{w}']", "href") for w in _WORDS]
    second = lambda rows: rows.select("page_id", F.map_filter(F.create_map(F.lit("title"), html.title(F.col("html"))), lambda k, v: v.isNotNull()).alias("fields"))
    out = extraction.extracted(table(spark, sf_dir, "pages"), schema, second)
    return out.select("page_id", "mode", "coverage", F.col("fields")["title"].alias("title"))

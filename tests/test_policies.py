"""References against the standard library, pools and choices of proxies, uploads, sitemaps, patterns of pages, keyed streams."""

from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import functions as F

BASES = ["https://a.org/b/c?x=1", "http://a.org", "https://a.org/b/c/", "https://a.org/b/../c/d;p?q#f"]
REFERENCES = [
    "", "d", "./d", "../d", "../../d", "../../../d", "d/./e", "d/../e", "/x/../y", "/x/./y/", "?q=2", "#f", "?q#f", "//cdn.x.org/a.js", "https://o.org/z", "mailto:me@x.org", ".", "..", "./", "../", "g?y/../x", "g#s/../x", "/", "a//b", "d/",
]


def test_references(spark):
    from webfacts.functions import urls

    rows = [(b, r) for b in BASES for r in REFERENCES]
    out = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", urls.resolve_url(F.col("base"), F.col("ref")).alias("url")).collect()
    wrong = [(r.base, r.ref, r.url, urljoin(r.base, r.ref)) for r in out if r.url != urljoin(r.base, r.ref)]
    assert not wrong, wrong


def test_relative_normal_forms(spark):
    from webfacts.functions import urls

    rows = [("https://A.org/b/c", "../D/#x"), ("https://a.org/", "HTTP://x.org/"), ("https://a.org/", "https://X.org/y/?q")]
    got = [r.u for r in spark.createDataFrame(rows, "base string, ref string").select(urls.normalize_url(F.col("ref"), F.col("base")).alias("u")).collect()]
    assert got == ["https://a.org/D", "http://x.org/", "https://x.org/y?q"]


def test_literal_addresses(spark):
    from webfacts.functions import urls

    u = [
        ("https://Www.Example.COM/Blog/Team/?q=1#top", "https://www.example.com/Blog/Team?q=1", "www.example.com", "blog_url"), ("https://x.org/pricingx", "https://x.org/pricingx", "x.org", "page"),
        ("https://x.org/case-studies", "https://x.org/case-studies", "x.org", "resource"), ("https://x.org/about/team", "https://x.org/about/team", "x.org", "contact"), ("example.org/a", "example.org/a", "example.org", "page"),
    ]
    df = spark.createDataFrame([(x[0],) for x in u], "x string")
    got = df.select("x", urls.normalize_url(F.col("x")).alias("n"), urls.extract_domain(F.col("x")).alias("d"), urls.classify_url(F.col("x")).alias("c")).collect()
    assert [tuple(r) for r in got] == u
    mails = {"jo@corp.io": (True, True), "x@gmail.com": (True, False), "a@guerrillamailblock.com": (False, False), "a@trashmail.com": (True, True), "no-at.example": (False, False), "A.B@Firm.co.uk": (True, True)}
    out = spark.createDataFrame([(x,) for x in mails], "x string").select("x", urls.is_email(F.col("x")).alias("a"), urls.is_business_email(F.col("x")).alias("b")).collect()
    assert {r.x: (r.a, r.b) for r in out} == mails


def test_slugs_that_are_taken(spark):
    from webfacts.operators.jobs import slugs

    taken = spark.createDataFrame([("acme",), ("acme-2",), ("b-co-7",)], "slug string")
    names = spark.createDataFrame([(1, "Acme"), (2, "ACME"), (3, "acme"), (4, "B Co"), (5, "b_co")], "id long, name string")
    assert {r.id: r.slug for r in slugs(names, taken).collect()} == {1: "acme-1", 2: "acme-3", 3: "acme-4", 4: "b-co", 5: "b-co-1"}


def test_choice_of_proxies_follows_weights(spark):
    from webfacts.operators.proxies import chosen

    rows = [(i, p, f"u{p}", w, rests) for i in range(4000) for p, (w, rests) in enumerate([(3.0, False), (1.0, False), (9.0, True)])] + [(-1, 0, "a", 1.0, True), (-1, 1, "b", 1.0, True)]
    got = {r.request_id: r.url for r in chosen(spark.createDataFrame(rows, "request_id long, pos int, url string, weight double, rests boolean")).collect()}
    seen = Counter(v for k, v in got.items() if k >= 0)
    assert got[-1] == "a" and set(seen) == {"u0", "u1"} and 0.7 < seen["u0"] / 4000 < 0.8


def test_jitter_is_bounded_and_repeats(spark):
    from webfacts.operators.schedules import jitter

    df = spark.range(500).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + jitter(F.col("id"), 3)).alias("us"))
    got = [r.us for r in df.collect()]
    assert got == [r.us for r in df.collect()] and all(0 <= x <= 900_000_000 for x in got) and len(set(got)) > 200


def test_sitemap_index(spark):
    from webfacts.sources.lists import sitemap_urls

    loc = lambda *x: "".join(f"<url><loc>{u}</loc></url>" for u in x)
    files = [
        ("a", 0, "https://a/1.xml", "<sitemap>\n <loc>https://a/c1.xml</loc></sitemap><sitemap><loc>https://a/none.xml</loc></sitemap>"), ("a", None, "https://a/c1.xml", loc("https://a/x", "https://a/y.pdf")),
        ("a", 1, "https://a/2.xml", loc("https://a/late")), ("b", 0, "https://b/1.xml", ""), ("b", 1, "https://b/2.xml", loc("https://b/p", "https://b/p")),
    ]
    got = sorted(tuple(r) for r in sitemap_urls(spark.createDataFrame(files, "domain string, path_rank int, url string, xml string")).collect())
    assert got == [("a", "https://a/x"), ("b", "https://b/p")]


def test_upload_files(spark):
    from webfacts.sources.lists import accepted, upload_lines, uploaded_domains

    files = [
        (1, "﻿name,website\n\"Co, \"\"X\"\"\",a.org\r\nb,www.a.org\n,\n".encode()), (2, "caf\xe9.org\n".encode("latin-1")), (3, b"x" * (5 * 1024 * 1024 + 1)),
        (4, "\n".join(f"d{i}.org" for i in range(130)).encode()),
    ]
    lines = upload_lines(spark.createDataFrame(files, "upload_id int, content binary")).cache()
    assert [tuple(r.cells) for r in lines.where("upload_id = 1").orderBy("pos").collect()][:3] == [("name", "website"), ('Co, "X"', "a.org"), ("b", "www.a.org")]
    out = uploaded_domains(lines)
    assert {(r.domain, r.state) for r in out.where("upload_id < 3").collect()} == {("a.org", "valid"), ("www.a.org", "duplicate"), ("caf\xe9.org", "valid")}
    assert out.where("upload_id = 4 and state = 'valid'").count() == 130 and accepted(out).where("upload_id = 4").count() == 100


def test_crawl_limits(spark, tmp_path):
    from webfacts.sources.lists import crawl

    n = iter(range(100))

    def checkpoint(df):
        df.write.parquet(path := f"{tmp_path}/{next(n)}")
        return spark.read.schema(df.schema).parquet(path)

    edges = spark.createDataFrame([("https://www.a.org/", "https://a.org/1"), ("https://www.a.org/", "https://b.org/x"), ("https://a.org/1", "https://a.org/f.pdf"), ("https://a.org/1", "https://a.org/2"), ("https://a.org/1", "https://a.org/3"), ("https://a.org/3", "https://www.a.org/")], "src string, dst string")
    seeds = spark.createDataFrame([("https://www.a.org/",)], "url string")
    assert {r.url for r in crawl(edges, seeds, checkpoint).collect()} == {"https://www.a.org/", "https://a.org/1", "https://a.org/2", "https://a.org/3"}
    assert {r.url for r in crawl(edges, seeds, checkpoint, limit=2).collect()} == {"https://www.a.org/", "https://a.org/1", "https://a.org/2"}


def test_patterns_inside_better_ones(spark):
    from webfacts.functions import dom
    from webfacts.operators.extraction import ranked_patterns

    rows = "".join(f"<tr><td>{i}</td><td><ul><li>a<li>b<li>c</ul></td></tr>" for i in range(4))
    html = f"<body><table><tr><th>n</th><th>l</th></tr>{rows}</table><ul>{'<li>x</li>' * 20}</ul><dl><dt>a<dd>b<dt>c<dd>d</dl></body>"
    out = dom.with_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).select(ranked_patterns(F.col("dom")).alias("p")).first().p
    assert [(x.kind, x.rows) for x in out] == [("repeated", 20), ("table", 4), ("definitions", 2)]


def test_inserts(spark, tmp_path):
    from webfacts.streaming import feeds

    rows = [("a", 429), ("a", 503), ("a", 200), ("b", 200)]
    spark.createDataFrame(rows, "domain string, status int").write.parquet(f"{tmp_path}/in/1.parquet")
    stream, sent = spark.readStream.schema("domain string, status int").parquet(f"{tmp_path}/in/*"), []
    facts = stream.selectExpr("status AS id", "1 AS job_id", "domain", "'page' AS data_type", "CAST(NULL AS STRING) AS url")
    feeds.micro_batches(feeds.inserts(facts), f"{tmp_path}/c3", lambda b, _: sent.extend(r.value for r in b.collect())).start().awaitTermination(120)
    assert len(sent) == 4 and '{"id":429,"job_id":1,"domain":"a","data_type":"page"}' in sent

"""Queries over URL, e-mail and text expressions, on the columns of whole tables. Oracles spell out every fixed value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, texts, urls
from .registry import query
from .views import table

_PART = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?'"
_part = lambda k, x="x": f"regexp_extract({x}, {_PART}, {k})"
_NORM = f"(CASE WHEN {_part(1)} <> '' THEN lower({_part(1)}) || ':' ELSE '' END) || (CASE WHEN {_part(2)} <> '' THEN '//' || lower({_part(2)}) ELSE '' END) || (CASE WHEN rtrim({_part(3)}, '/') = '' THEN '/' ELSE rtrim({_part(3)}, '/') END) || {_part(4)}"
_DOMAIN = f"lower(regexp_replace(CASE WHEN {_part(2)} <> '' THEN {_part(2)} ELSE split_part({_part(3)}, '/', 1) END, '^www\\.', ''))"
_CLASS = rf"""CASE WHEN regexp_matches({_part(3)}, '(?i)/(pricing|plans?|packages?)\b') THEN 'pricing'
WHEN regexp_matches({_part(3)}, '(?i)/(contact|get-in-touch|demo|request|careers?|jobs?)\b') THEN 'contact'
WHEN regexp_matches({_part(3)}, '(?i)/((resources?|whitepapers?|webinars?|ebooks?|library|downloads?|guides?)\b|case-stud)') THEN 'resource'
WHEN regexp_matches({_part(3)}, '(?i)/((blog|insights?|news|articles?|posts?|stories)\b|\d{{4}}/\d{{2}}/)') THEN 'blog_url'
WHEN regexp_matches({_part(3)}, '(?i)/(team|about|leadership|people|our-team|staff)\b') THEN 'contact' ELSE 'page' END"""
_PAGE = rf"NOT (x = '' OR regexp_matches(x, '^(#|mailto:|tel:|javascript:)') OR regexp_matches(lower({_part(3)}), '\.(pdf|jpg|jpeg|png|gif|svg|ico|css|js|woff|woff2|ttf|eot|mp3|mp4|avi|mov|zip|gz|tar|xml|rss|atom)$'))"
_MAIL = r"(regexp_matches(x, '^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$') AND lower(split_part(x, '@', 2)) NOT IN ('mailinator.com', 'guerrillamail.com', 'tempmail.com', 'throwaway.email', 'temp-mail.org', '10minutemail.com', 'yopmail.com', 'sharklasers.com', 'guerrillamailblock.com'))"
_BUSINESS = f"({_MAIL} AND lower(split_part(x, '@', 2)) NOT IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'aol.com', 'icloud.com', 'mail.com', 'protonmail.com', 'zoho.com', 'yandex.com'))"

# addresses as they are written on pages, and with what lists and forms hold besides
_LINKS = r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS x FROM pages"""
_URLS = f"SELECT DISTINCT x FROM (SELECT url AS x FROM pages UNION ALL SELECT x FROM ({_LINKS}))"
_MAILS = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+')) AS x FROM documents"
_PROVIDERS = "SELECT lower(split_part(c_name, '#', 1)) || c_custkey || '@' || CASE c_custkey % 8 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'Mailinator.com' WHEN 2 THEN 'guerrillamailblock.com' WHEN 3 THEN 'trashmail.com' WHEN 4 THEN 'corp.io' WHEN 5 THEN 'nodot' WHEN 6 THEN 'YANDEX.com' ELSE 'temp-mail.org' END AS x FROM customer"
_LABELS = "SELECT c_custkey || ' $' || CAST(CAST(abs(c_acctbal) AS BIGINT) AS VARCHAR) || CASE c_custkey % 5 WHEN 0 THEN '/mo' WHEN 1 THEN ' billed Annually' WHEN 2 THEN ' per quarter' WHEN 3 THEN ' Case study, free guide' ELSE '  White  paper' END AS x FROM customer"


def _anchors(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href="([^"]*)" """.strip()), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(found).alias("x"))


def _addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("x")).union(_anchors(spark, sf_dir).select("x")).distinct()


def _mails(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+"), F.lit(0))).alias("x")
    host = F.element_at(F.array(*map(F.lit, ["gmail.com", "Mailinator.com", "guerrillamailblock.com", "trashmail.com", "corp.io", "nodot", "YANDEX.com", "temp-mail.org"])), (F.col("c_custkey") % 8 + 1).cast("int"))
    made = F.concat(F.lower(F.split_part("c_name", F.lit("#"), F.lit(1))), F.col("c_custkey").cast("string"), F.lit("@"), host)
    return table(spark, sf_dir, "documents").select(found).distinct().union(table(spark, sf_dir, "customer").select(made))


def _labels(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ["/mo", " billed Annually", " per quarter", " Case study, free guide", "  White  paper"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    amount = F.rint(F.abs("c_acctbal")).cast("bigint").cast("string")
    return table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(" $"), amount, tail).alias("x"))


for _name, _rows, _from, _expr, _sql in [
    ("u01_normalize_url", _addresses, _URLS, urls.normalize_url, _NORM),
    ("u03_extract_domain", _addresses, _URLS, urls.extract_domain, _DOMAIN),
    ("u04_ensure_scheme", _addresses, _URLS, urls.ensure_scheme, "CASE WHEN starts_with(x, 'http://') OR starts_with(x, 'https://') THEN x ELSE 'https://' || x END"),
    ("u05_is_page_url", _addresses, _URLS, urls.is_page_url, _PAGE),
    ("u07_classify_url", _addresses, _URLS, urls.classify_url, _CLASS),
    ("u10_search_domain", _addresses, _URLS, urls.search_domain, f"regexp_replace({_part(2)}, '^www\\.', '')"),
    ("u11_crawl_domain", _addresses, _URLS, urls.crawl_domain, f"replace(lower({_part(2)}), 'www.', '')"),
    ("u12_listed_domain", _addresses, _URLS, urls.listed_domain, "split_part(regexp_replace(trim(x, ' \"'''), '^(?i)https?://', ''), '/', 1)"),
    ("u13_is_domain", _addresses, _URLS, urls.is_domain, "length(x) >= 3 AND contains(x, '.') AND NOT contains(x, ' ') AND regexp_matches(x, '[A-Za-z]')"),
    ("u18_is_email", _mails, f"{_MAILS} UNION ALL {_PROVIDERS}", urls.is_email, _MAIL),
    ("u19_is_business_email", _mails, f"{_MAILS} UNION ALL {_PROVIDERS}", urls.is_business_email, _BUSINESS),
    ("x08_first_price", _labels, _LABELS, texts.first_price, "nullif(regexp_extract(x, '[$€£¥]\\s*[\\d,]+(\\.\\d{2})?', 0), '')"),
    ("x09_billing_cycle", _labels, _LABELS, lambda c: texts.first_keyword(c, texts.CYCLES), "CASE WHEN regexp_matches(x, '(?i)month|/mo|per month') THEN 'monthly' WHEN regexp_matches(x, '(?i)year|annual|/yr|per year') THEN 'annual' WHEN regexp_matches(x, '(?i)quarter|/qtr') THEN 'quarterly' ELSE 'unknown' END"),
    ("x11_resource_type", _labels, _LABELS, lambda c: texts.first_keyword(c, texts.RESOURCES), "CASE WHEN regexp_matches(x, '(?i)whitepaper|white\\s*paper') THEN 'whitepaper' WHEN regexp_matches(x, '(?i)case\\s*stud|success\\s*stor') THEN 'case_study' WHEN regexp_matches(x, '(?i)webinar|on-demand') THEN 'webinar' WHEN regexp_matches(x, '(?i)ebook|e-book|guide') THEN 'ebook' WHEN regexp_matches(x, '(?i)report|research') THEN 'report' WHEN regexp_matches(x, '(?i)infographic') THEN 'infographic' ELSE 'unknown' END"),
]:

    def _run(spark, sf_dir, rows=_rows, expr=_expr):
        return rows(spark, sf_dir).select("x", expr(F.col("x")).alias("value"))

    query(_name, f"SELECT x, {_sql} AS value FROM ({_from})")(_run)


@query("x01_collapse_blanks", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS value FROM documents")
def x01_collapse_blanks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.collapse_blanks(F.col("text")).alias("value"))


@query("u06_distinct_urls", f"SELECT norm, min(page_id) AS page_id FROM (SELECT page_id, {_NORM.replace('(x,', '(url,')} AS norm FROM pages WHERE {_PAGE.replace('(x,', '(url,').replace('x = ', 'url = ')}) GROUP BY norm")
def u06_distinct_urls(spark, sf_dir):
    """Normalised page URLs, each with its first page."""
    rows = table(spark, sf_dir, "pages").where(urls.is_page_url(F.col("url")))
    return rows.groupBy(urls.normalize_url(F.col("url")).alias("norm")).agg(F.min("page_id").alias("page_id"))


@query("u08_classified", f"SELECT page_id, {_CLASS.replace('(x,', '(url,')} AS data_type FROM pages")
def u08_classified(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.classify_url(F.col("url")).alias("data_type"))


@query("u09_class_histogram", f"SELECT {_CLASS.replace('(x,', '(url,')} AS data_type, count(*) AS n FROM pages GROUP BY 1")
def u09_class_histogram(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.classify_url(F.col("url")).alias("data_type")).agg(F.count("*").alias("n"))


@query("u14_article_links", rf"""SELECT page_id, x, rtrim({_part(3)}, '/') <> '' AND NOT regexp_matches(lower(rtrim({_part(3)}, '/')), '\.(doc|docx|zip|png|jpg|jpeg|gif|svg|webp|mp3|mp4|avi)$')
AND {_DOMAIN} = {_DOMAIN.replace('(x,', '(url,')} AS ok FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS x FROM pages)""")
def u14_article_links(spark, sf_dir):
    """Whether each link of a page may be an article of its site."""
    return _anchors(spark, sf_dir).select("page_id", "x", urls.is_article_link(F.col("x"), F.col("url")).alias("ok"))


@query("u23_phones", r"SELECT doc_id, phone, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}')) AS phone FROM documents) GROUP BY ALL")
def u23_phones(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(urls.phones(F.col("text"))).alias("phone"))
    return found.groupBy("doc_id", "phone").agg(F.count("*").alias("n"))


@query("u25_file_names", f"SELECT page_id, replace({_DOMAIN.replace('(x,', '(url,')}, '.', '_') || '_' || substr(CAST(page_id AS VARCHAR), 1, 8) || '.csv' AS name FROM pages")
def u25_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.file_name(urls.extract_domain(F.col("url")), F.col("page_id"), "csv").alias("name"))


@query("u28_key_hashes", "SELECT c_custkey, sha256(c_name) AS hash, substr(md5(c_name), 1, 12) AS short FROM customer")
def u28_key_hashes(spark, sf_dir):
    """Hashes of API keys and of proxies' addresses."""
    return table(spark, sf_dir, "customer").select("c_custkey", urls.key_hash(F.col("c_name")).alias("hash"), urls.proxy_hash(F.col("c_name")).alias("short"))


@query("x02_word_count", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents")
def x02_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.word_count(F.col("text")).cast("long").alias("words"))


@query("x03_truncated", "SELECT doc_id, substr(text, 1, 300) AS excerpt FROM documents")
def x03_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.truncated(F.col("text"), 300).alias("excerpt"))


@query("x04_reading_time", "SELECT doc_id, CAST(round_even(words / 238.0::DOUBLE, 1) AS DOUBLE) AS minutes FROM (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents)")
def x04_reading_time(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.reading_minutes(texts.word_count(F.col("text"))).alias("minutes"))


@query("x05_squeezed", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS value FROM documents")
def x05_squeezed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.squeezed(F.col("text")).alias("value"))


_TITLE = "nullif(trim(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)), '')"
_H1 = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query("h01_titles", f"SELECT page_id, coalesce({_TITLE}, {_H1}) AS title FROM pages")
def h01_titles(spark, sf_dir):
    """Page titles: the first title element's text, else the first heading's."""
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("h03_links", r"""SELECT DISTINCT page_id, x AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS x FROM pages) WHERE x <> '' AND NOT regexp_matches(x, '^(#|mailto:|tel:|javascript:)')""")
def h03_links(spark, sf_dir):
    """References of a page's anchors, each once, without those to fragments, mail, phones and scripts."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query("u20_emails", "SELECT doc_id, email, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b')) AS email FROM documents) GROUP BY ALL")
def u20_emails(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(urls.emails(F.col("text"))).alias("email"))
    return found.groupBy("doc_id", "email").agg(F.count("*").alias("n"))


_HOME = "'https://' || n_name"


@query("u16_homepages", f"""WITH l AS (SELECT n_name AS domain, c_custkey AS pos, {_HOME} || CASE c_custkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/a' ELSE '/b' END AS url FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 1 OR c_custkey % 3 > 0)
SELECT domain, pos, url FROM l UNION ALL SELECT n_name, -1, {_HOME} FROM nation WHERE n_name NOT IN (SELECT domain FROM l WHERE rtrim(url, '/') = 'https://' || domain)""")
def u16_homepages(spark, sf_dir):
    """Lists of addresses by domain, with the home page in front where it lacks."""
    from ..operators import jobs

    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("domain"))
    tail = F.element_at(F.array(F.lit("/"), F.lit("/a"), F.lit("/b")), (F.col("c_custkey") % 3 + 1).cast("int"))
    listed = table(spark, sf_dir, "customer").join(nations, "c_nationkey").where("c_nationkey % 2 = 1 or c_custkey % 3 > 0")
    listed = listed.select("domain", F.col("c_custkey").alias("pos"), F.concat(F.lit("https://"), "domain", tail).alias("url"))
    return jobs.with_homepage(listed, nations.select("domain"))


@query("u26_slugs", """WITH n AS (SELECT p_partkey AS id, p_brand || ' ' || p_size AS name, replace(replace(lower(p_brand || ' ' || p_size), ' ', '-'), '_', '-') AS base FROM part)
SELECT id, name, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n - 1 AS VARCHAR) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM n)""")
def u26_slugs(spark, sf_dir):
    from ..operators import jobs

    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("name"))
    return jobs.slugs(names, spark.createDataFrame([], "slug string"))

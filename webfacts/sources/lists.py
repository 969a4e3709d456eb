"""Sources as tables: sitemaps, uploaded lists of domains, search responses, video and proxy strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

# Names of columns that hold domains.
_HEADERS = ["url", "domain", "website", "site", "link", "urls", "domains"]
_RESULTS = "query string, results array<struct<url string, title string, snippet string, engine string, score double, published_date string>>"


def _locations(xml: Column, pattern: str = r"<loc>(.*?)</loc>") -> Column:
    return F.regexp_extract_all(xml, F.lit(f"(?s){pattern}"), F.lit(1))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(domain, url) of sitemap files (domain, path_rank, url, xml): the pages of each domain's first path that has any.

    A file that lists sitemaps has the pages of those; they are files with their
    own ``url`` and a null ``path_rank``.
    """
    files = files if "url" in files.columns else files.withColumn("url", F.lit(None).cast("string"))
    top = files.where("path_rank is not null").select("domain", "path_rank", "xml", _locations(F.col("xml"), r"<sitemap>\s*<loc>(.*?)</loc>").alias("below"))
    own = top.where(F.size("below") == 0).select("domain", "path_rank", "xml")
    named = top.select("domain", "path_rank", F.explode("below").alias("url")).distinct()
    lower = named.join(files.select("url", "xml"), "url").select("domain", "path_rank", "xml")
    found = own.unionByName(lower).select("domain", "path_rank", F.explode(_locations(F.col("xml"))).alias("url")).where(urls.is_page_url(F.col("url")))
    first = found.groupBy("domain").agg(F.min("path_rank").alias("path_rank"))
    return found.join(first, ["domain", "path_rank"]).select("domain", "url").distinct()


# Bounds of an upload, in bytes and in valid rows.
MOST_BYTES, MOST_ROWS = 5 * 1024 * 1024, 100


def upload_lines(files: DataFrame) -> DataFrame:
    """(upload_id, pos, cells) of uploaded files (upload_id, content: bytes): UTF-8 without its mark, else Latin-1; larger files than the bound give none.

    A quoted cell may hold commas and doubled quotes, but no line end.
    """
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    lines = F.split(F.regexp_replace(text, "^\ufeff", ""), r"\r\n|\n|\r")
    rows = files.where(F.length("content") <= MOST_BYTES).select("upload_id", F.posexplode(lines).alias("pos", "line"))
    cells = F.regexp_extract_all("line", F.lit(r'(?:^|,)((?:"(?:[^"]|"")*"|[^,"]*))'), F.lit(1))
    bare = F.transform(cells, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return rows.select("upload_id", "pos", bare.alias("cells"))


def accepted(uploaded: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Of ``uploaded_domains`` the first valid rows of an upload, as many as it may have."""
    n = F.row_number().over(Window.partitionBy("upload_id").orderBy("pos"))
    return uploaded.where("state = 'valid'").withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def paged_hits(hits: DataFrame, per_page: int = 10) -> DataFrame:
    """Hits (query_id, page, ...) up to each query's first page of fewer than ``per_page``; a page that lacks ends them too."""
    sizes = hits.groupBy("query_id", "page").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy("page")
    ended = F.coalesce(F.max((F.col("n") < per_page).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.row_number().over(order) == F.col("page")
    return hits.join(sizes.withColumn("_ok", (ended == 0) & whole).where("_ok").select("query_id", "page"), ["query_id", "page"])


def ingested(batches: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, facts) of pushed batches (job_id, org_id, user_id, domain, source, records: array of (data_type, url, title, metadata)).

    Batches of 1 to 500 records count; each makes a job that is completed from the start.
    """
    good = batches.where(F.size("records").between(1, 500))
    jobs = good.select(F.col("job_id").alias("id"), "domain", F.lit("extension").alias("template_id"), F.lit("completed").alias("status"), F.col("source").alias("strategy_used"), F.size("records").alias("pages_scraped"), "org_id", "user_id", as_of.alias("completed_at"))
    return jobs, good.select("job_id", "domain", "org_id", "user_id", F.explode("records").alias("r")).select("job_id", "domain", "r.*", "org_id", "user_id")


def uploaded_domains(lines: DataFrame, column: int = 0, guess: bool = True) -> DataFrame:
    """(upload_id, pos, raw, domain, state) of cells (upload_id, pos, cells): state is valid, duplicate or invalid.

    A first line with a known column name is a header; with ``guess`` one without a domain in its first cell is too,
    which is to be left out for lists known to have no other headers, whose first line may be an invalid one like any.
    Duplicates are those of a domain without ``www.`` and case that an earlier line of the upload has.
    """
    head = lines.where("pos = 0").select("upload_id", F.col("cells").alias("head"))
    named = F.array_position(F.transform("head", lambda c: F.lower(F.trim(c)).isin(_HEADERS)), True)
    first = urls.listed_domain(F.try_element_at("head", F.lit(column + 1)))
    head = head.select("upload_id", F.when(named > 0, named - 1).otherwise(column).cast("int").alias("at"), (F.coalesce(named > 0, F.lit(False)) | (F.lit(guess) & ~F.coalesce(urls.is_domain(first), F.lit(False)))).alias("has_header"))
    rows = lines.join(head, "upload_id").where(~F.col("has_header") | (F.col("pos") > 0))
    rows = rows.select("upload_id", "pos", F.trim(F.try_element_at("cells", F.col("at") + 1)).alias("raw")).where("raw <> ''")
    rows = rows.withColumn("domain", urls.listed_domain(F.col("raw"))).withColumn("ok", F.coalesce(urls.is_domain(F.col("domain")), F.lit(False)))
    key = F.regexp_replace(F.lower("domain"), r"^www\.", "")
    nth = F.row_number().over(Window.partitionBy("upload_id", "ok", key).orderBy("pos"))
    return rows.select("upload_id", "pos", "raw", "domain", F.when(~F.col("ok"), "invalid").when(nth == 1, "valid").otherwise("duplicate").alias("state"))


def search_hits(responses: DataFrame) -> DataFrame:
    """(pos, rank, url, title, score, domain) of search responses (pos, body), one row per result."""
    parsed = responses.select("pos", F.from_json("body", _RESULTS).alias("r"))
    return parsed.select("pos", F.posexplode("r.results").alias("rank", "h")).select("pos", "rank", "h.url", "h.title", "h.score", urls.search_domain(F.col("h.url")).alias("domain"))


def video_id(url: Column) -> Column:
    """The 11 characters that name a video in a watch, short or embed address; null otherwise."""
    return F.nullif(F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def crawl(edges: DataFrame, seeds: DataFrame, checkpoint, *, limit: int | None = None, same_domain: bool = True, most_rounds: int | None = None, guard: int = 10_000) -> DataFrame:
    """(url, depth) reachable from seeds (url) over edges (src, dst), and over pages that answered only.

    Links to other domains (unless ``same_domain`` is off) and to what is no
    page don't count. A round joins only the last frontier to the edges and
    takes off what is known; ``checkpoint`` writes a frame to shared storage and
    reads it back, so that plans and lost executors stay cheap. Rounds end when
    ``limit`` addresses besides the seeds are found (the first of the last round
    by name), when none is new, or at depth ``most_rounds``; after ``guard``
    rounds it is an error. As a round takes the whole frontier, one without new
    addresses ends the crawl, and no count of stalled batches is needed.
    """
    links = edges.where(urls.is_page_url(F.col("dst")))
    if same_domain:
        links = links.where(urls.crawl_domain(F.col("src")) == urls.crawl_domain(F.col("dst")))
    seen = frontier = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = found = 0
    while (most_rounds is None or depth < most_rounds) and (limit is None or found < limit):
        depth += 1
        new = frontier.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        if limit is not None:
            new = new.orderBy("url").limit(limit - found)
        frontier = checkpoint(new.withColumn("depth", F.lit(depth)))
        n = frontier.count()
        if not n:  # a round without anything new leaves nothing to go on from
            break
        found += n
        if depth > guard:
            raise RuntimeError(f"crawl did not end within {guard} rounds")
        seen = checkpoint(seen.unionByName(frontier))
    return seen


def closure(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth) reachable from seeds (url) over edges (src, dst) in up to ``depth`` steps, in one plan.

    A recursive common table expression: each level joins the one before it alone,
    each address of a level once, so cycles go round until the depth ends them.
    Null addresses lead nowhere. For deep graphs ``crawl`` is the better one, as it
    takes off what is known and cuts its plan each round.
    """
    spark = edges.sparkSession
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    found = spark.sql(
        f"""WITH RECURSIVE reached(url, depth) MAX RECURSION LEVEL {depth + 2} AS (
          SELECT DISTINCT url, 0 FROM {{seeds}} WHERE url IS NOT NULL
          UNION ALL SELECT DISTINCT l.dst, r.depth + 1 FROM reached r JOIN {{links}} l ON r.url = l.src WHERE r.depth < {depth})
        SELECT url, depth FROM reached""", seeds=seeds, links=links)  # fmt: skip
    return found.groupBy("url").agg(F.min("depth").alias("depth"))


def files(spark: SparkSession, path: str, most: int = 10 * 1024 * 1024) -> DataFrame:
    """(url, content_type, content) of downloaded files of up to ``most`` bytes in a folder, the type by the name's end."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return rows.select(F.col("path").alias("url"), F.when(kind == "pdf", "application/pdf").when(kind.isin("html", "htm"), "text/html").otherwise("application/octet-stream").alias("content_type"), "content")

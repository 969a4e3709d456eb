"""Tables of jobs, searches, users and their like: new rows, look-ups, lists, pages of lists, and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import records, schedules

# Rows of a page of a list, of a history, and the most that a tool returns.
PAGE, HISTORY, TOOL = 50, 100, 200
#: Columns by which a list may be sorted.
SORTABLE = ["created_at", "domain", "status"]


def appended(rows: DataFrame, new: DataFrame, **defaults: Column) -> DataFrame:
    """A table with new rows; columns that they lack have their default, or null."""
    for c in rows.columns:
        if c not in new.columns:
            new = new.withColumn(c, defaults.get(c, F.lit(None)).cast(rows.schema[c].dataType))
    return rows.unionByName(new.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))


def seeded(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A table with those of the new rows whose key it lacks."""
    return appended(rows, new.dropDuplicates([key]).join(rows.select(key), key, "left_anti"))


def created(jobs: DataFrame, requests: DataFrame, as_of: Column, default_org: Column | None = None) -> DataFrame:
    """Jobs with a pending one for each request; those without an organisation have the default one."""
    new = requests
    if "org_id" in requests.columns and default_org is not None:
        new = new.withColumn("org_id", F.coalesce("org_id", default_org))
    return appended(jobs, new, status=F.lit("pending"), created_at=as_of)


def tracked_search(searches: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Tracked searches with new ones (id, frequency, ...), which are active, have no runs and next run an interval from now."""
    zero = F.lit(0)
    return appended(searches, new.withColumn("next_run_at", schedules.next_run(F.col("frequency"), as_of)), is_active=F.lit(True), total_runs=zero, total_domains=zero, created_at=as_of)


def found(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(key) == value)


def is_cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cancelled) of ids; false for unknown ones."""
    known = jobs.where("status = 'cancelled'").select("id").distinct().withColumn("_hit", F.lit(True))
    return ids.select("id").join(known, "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("cancelled"))


def children(rows: DataFrame, parent: str, value: object) -> DataFrame:
    """The rows of a parent in the order of their making."""
    return rows.where(F.col(parent) == value).orderBy("created_at", "id")


def listed(rows: DataFrame, *order: Column, active: str | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Rows in an order that should be total, only the active ones if that column is given, without hidden columns."""
    return (rows if active is None else rows.where(F.col(active))).orderBy(*order).drop(*hidden)


def page(rows: DataFrame, number: int, sort: str = "created_at", descending: bool = True, size: int = PAGE, key: str = "id") -> DataFrame:
    """Page ``number`` (from 1) of a list by a sortable column, else by age; ties by key."""
    sort = sort if sort in SORTABLE else "created_at"
    order = [F.col(sort).desc() if descending else F.col(sort).asc(), F.col(key).desc() if descending else F.col(key).asc()]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def total(rows: DataFrame, where: Column) -> DataFrame:
    """One row: how many rows the pages of a list have together."""
    return rows.where(where).agg(F.count("*").alias("total"))


def history(rows: DataFrame, at: str, most: int = HISTORY) -> DataFrame:
    """The newest rows."""
    return rows.orderBy(F.desc(at), F.desc("id")).limit(most)


def tool_results(facts: DataFrame, data_type: str | None, limit: int) -> DataFrame:
    """The first records of a type, as many as asked for but 200 at most."""
    return (facts if data_type is None else facts.where(F.col("data_type") == data_type)).orderBy("id").limit(min(limit, TOOL))


def with_counts(jobs: DataFrame, facts: DataFrame) -> DataFrame:
    """Jobs (id, ...) with ``records``, the number of their facts (job_id)."""
    counts = facts.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("records"))
    return jobs.join(counts, "id", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def skipped(found_: DataFrame, recent: DataFrame, score: str = "score", pos: str = "pos") -> DataFrame:
    """Of discovered domains those that were scraped recently, each by its best row."""
    return records.best_by_score(found_.join(recent.select("domain").distinct(), "domain", "left_semi"), score=score, pos=pos)


def supplemented(first: DataFrame, rest: DataFrame, limit: int) -> DataFrame:
    """(domain, url, rank): a domain's first list, then what the second adds, up to ``limit`` of each domain, by url within a list."""
    more = rest.select("domain", "url").distinct().join(first.select("domain", "url"), ["domain", "url"], "left_anti")
    both = first.select("domain", "url").distinct().withColumn("list", F.lit(0)).unionByName(more.withColumn("list", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("domain").orderBy("list", "url"))
    return both.withColumn("rank", n).where(F.col("rank") <= limit).select("domain", "url", "rank")


def slugs(names: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """(id, name, slug): a slug of each name; one that is taken, or that an earlier name has, gets the next free number."""
    rows = names.withColumn("base", urls.slug(F.col("name")))
    used = taken.select("slug").distinct()
    # numbers already given to a base, 0 for the base itself
    bases = rows.select("base").distinct()
    number = F.when(F.col("slug") == F.col("base"), F.lit(0)).otherwise(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int"))
    stem = used.select("slug", F.explode(F.array("slug", F.regexp_replace("slug", r"-\d+$", ""))).alias("base")).distinct().join(bases, "base")
    given = stem.withColumn("n", number).where("n is not null").groupBy("base").agg(F.collect_set("n").alias("given"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(key))
    rows = rows.withColumn("nth", nth).join(given, "base", "left").withColumn("given", F.coalesce("given", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(0), F.col("nth") + F.size("given")), lambda i: ~F.array_contains("given", i))
    at = F.element_at(free, F.col("nth"))
    return rows.select(key, "name", F.when(at == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), at.cast("string"))).alias("slug"))


def visible(rows: DataFrame, org: object, column: str = "org_id") -> DataFrame:
    """Rows of one organisation; none without one."""
    return rows.where(F.col(column) == org) if org is not None else rows.where(F.lit(False))


def writable(new: DataFrame, org: object, column: str = "org_id") -> DataFrame:
    """New rows with ``allowed``: whether they are of the writer's own organisation."""
    return new.withColumn("allowed", F.coalesce(F.col(column) == F.lit(org), F.lit(False)))


def organisation_proxies(jobs: DataFrame, organisations: DataFrame) -> DataFrame:
    """(id, proxy_url) of jobs (id, org_id); null where an organisation has none."""
    return jobs.select("id", "org_id").join(organisations.select("org_id", F.nullif("proxy_url", F.lit("")).alias("proxy_url")), "org_id", "left").select("id", "proxy_url")


def touched(rows: DataFrame, uses: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose ``column`` is the last time (at) of their uses (key, at), if later."""
    last = uses.groupBy(key).agg(F.max("at").alias("_at"))
    return rows.join(last, key, "left").withColumn(column, F.greatest(column, "_at")).drop("_at").select(*rows.columns)


def contact_facts(contacts: DataFrame, domain: str) -> DataFrame:
    """(domain, data_type, url, title) of contacts (first_name, last_name, name, linkedin_url, profile_url) of a people search; blanks count as missing."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.nullif(F.trim(F.concat_ws(" ", some("first_name"), some("last_name"))), F.lit(""))
    return contacts.select(F.lit(domain).alias("domain"), F.lit("contact").alias("data_type"), F.coalesce(some("linkedin_url"), some("profile_url")).alias("url"), F.coalesce(name, some("name")).alias("title"))


def captured_facts(rows: DataFrame) -> DataFrame:
    """(id, data_type, url, title) of captured rows (id, generic, values: an ordered map as an array of (name, value)).

    Contacts as ``contact_facts`` has them; generic rows are ``table_data`` without
    an address, titled by their first two values that are not blank.
    """
    value = lambda n: F.nullif(F.get(F.filter("values", lambda x: x["name"] == n), F.lit(0))["value"], F.lit(""))
    filled = F.filter(F.transform("values", lambda x: x["value"]), lambda v: v != "")
    person = F.coalesce(F.nullif(F.concat_ws(" ", value("first_name"), value("last_name")), F.lit("")), value("name"))
    return rows.select(
        "id", F.when(F.col("generic"), "table_data").otherwise("contact").alias("data_type"), F.when(~F.col("generic"), F.coalesce(value("linkedin_url"), value("profile_url"))).alias("url"),
        F.when(F.col("generic"), F.nullif(F.array_join(F.slice(filled, 1, 2), " \u2014 "), F.lit(""))).otherwise(person).alias("title"))


def crawl_plan(pages: DataFrame, most: int = 500) -> DataFrame:
    """The first ``most`` distinct addresses of each job (job_id, pos, url), by place."""
    first = records.first_by(pages, ["job_id", "url"], F.col("pos").asc())
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("pos", "url"))
    return first.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def with_homepage(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Addresses (domain, pos, url) of domains, with the home page in front (pos -1) where a domain lacks it."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    home = domains.select("domain", F.lit(-1).alias("pos"), F.concat(F.lit("https://"), "domain").alias("url"))
    has = pages.select("domain", bare(F.col("url")).alias("_bare"))
    return pages.select("domain", "pos", "url").unionByName(home.join(has, (home["domain"] == has["domain"]) & (bare(home["url"]) == has["_bare"]), "left_anti").select("domain", F.col("pos").cast(pages.schema["pos"].dataType).alias("pos"), "url"))


def second_phase(listings: DataFrame, visited: DataFrame, captured: DataFrame) -> DataFrame:
    """Captured pages (url, ...) of articles that listings (job_id, article_urls) name and that the job hasn't visited (job_id, url), each once."""
    named = listings.select("job_id", F.explode("article_urls").alias("url")).distinct()
    return named.join(visited.select("job_id", "url"), ["job_id", "url"], "left_anti").join(captured, "url")

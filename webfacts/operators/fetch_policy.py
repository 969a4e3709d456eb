"""Decisions over a fetch log: blocks, escalation, waits, back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, texts

# Tiers from cheap to dear, statuses of a block, bounds.
TIERS = ["lightpanda", "playwright", "playwright_proxy"]
BLOCK_STATUS, MIN_HTML = [403, 429, 503], 20


def is_blocked(status: Column, html_length: Column) -> Column:
    return status.isin(BLOCK_STATUS) | (html_length < MIN_HTML)


def escalation_reason(blocked: Column, captcha: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", F.when(blocked, "blocked_flag"), F.when(captcha, "captcha")), F.lit("")), F.lit("none"))


def next_tier(tier: Column, order: list[str] = TIERS) -> Column:
    """The tier after this one; null for the last and for unknown ones."""
    tiers = F.array(*map(F.lit, order))
    at = F.array_position(tiers, tier)
    return F.when(at > 0, F.try_element_at(tiers, (at + 1).cast("int")))


# Cost of a request by tier, former names of tiers, milliseconds between requests to a domain.
COSTS = {"lightpanda": 0.001, "playwright": 0.003, "playwright_proxy": 0.0035}
FORMER = {"basic_http": "lightpanda", "headless_browser": "playwright", "headless_proxy": "playwright_proxy"}
RATES = {"linkedin.com": 3000, "*.linkedin.com": 3000, "default": 0}


def should_escalate(blocked: Column, captcha: Column) -> Column:
    return blocked | captcha


def fetch_results(pages: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Pages (key, url, html) with their fetch (key, status_code, tier_used): also cost_usd, blocked and captcha_detected."""
    both = pages.join(log, key)
    return both.select(
        key, "url", "html", "status_code", "tier_used", tier_cost(F.col("tier_used")).alias("cost_usd"),
        is_blocked(F.col("status_code"), F.length("html")).alias("blocked"), html.has_captcha(F.col("html")).alias("captcha_detected"))


def tier_order(cheapest: bool = True, proxy: bool = True) -> list[str]:
    """The tiers at hand: without a light browser the second is the first, without proxies there is no third."""
    return [t for t in TIERS if (t != TIERS[0] or cheapest) and (t != TIERS[2] or proxy)]


def tier_cost(tier: Column) -> Column:
    return texts.lookup(tier, COSTS)


def current_tier(name: Column) -> Column:
    """A tier by its present name, also where a former one is given; null for other names."""
    return F.coalesce(texts.lookup(name, FORMER), F.when(name.isin(TIERS), name))


def fetcher(tier: Column) -> Column:
    """The tier that fetches: unknown ones go to the full browser."""
    return F.coalesce(F.when(tier.isin(TIERS), tier), F.lit(TIERS[1]))


def rate_limit(domain: Column) -> Column:
    """Milliseconds between requests: of the domain itself, else of the first pattern it fits, else the default."""
    out = F.when(domain.isin([k for k in RATES if "*" not in k]), texts.lookup(domain, RATES))
    for pattern, ms in RATES.items():
        if "*" in pattern:
            out = out.when(domain.like(pattern.replace("*", "%")), ms)
    return out.otherwise(RATES["default"])


def initial_tier(domain: Column, authenticated: Column, requests: Column, last_strategy: Column, cheapest: bool = True) -> Column:
    """The tier to begin with: by the session where a domain has such, else the one that last went well, else the cheapest.

    A session is good for 50 requests; a null session is none.
    """
    guarded = (domain == "linkedin.com") | domain.endswith(".linkedin.com")
    session = F.when(guarded & F.coalesce(authenticated, F.lit(False)), F.when(F.coalesce(requests, F.lit(0)) < 50, TIERS[1]).otherwise(TIERS[2]))
    return F.coalesce(session, current_tier(last_strategy), F.lit(tier_order(cheapest)[0]))


def retry_delay(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before the try after ``attempt`` (from 0): doubled each time up to a bound."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def outcome(jobs: DataFrame, facts: DataFrame) -> DataFrame:
    """(job_id, status, pages_scraped, error_message) of jobs (job_id, errors) by their records: without any, a job has failed, with its reason."""
    counts = facts.groupBy("job_id").agg(F.count("*").alias("pages_scraped"))
    rows = jobs.join(counts, "job_id", "left").withColumn("pages_scraped", F.coalesce("pages_scraped", F.lit(0)))
    none, errors = F.col("pages_scraped") == 0, F.coalesce("errors", F.array().cast("array<string>"))
    said = F.when(F.size(errors) > 0, F.concat(F.lit("No data extracted. Errors: "), F.array_join(errors, "; "))).otherwise("No data extracted from domain (empty site or blocked)")
    return rows.select("job_id", F.when(none, "failed").otherwise("completed").alias("status"), "pages_scraped", F.when(none, said).alias("error_message"))


def cancelled(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Jobs, cancelled where their id is among the keys and they are pending or running."""
    hit = keys.select("id").distinct().withColumn("_hit", F.lit(True))
    stop = F.col("_hit") & F.col("status").isin("pending", "running")
    return jobs.join(hit, "id", "left").withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status"))).drop("_hit")


def is_stale(status: Column, last_activity: Column, created: Column, as_of: Column, minutes: int = 10) -> Column:
    return (status == "running") & (F.coalesce(last_activity, created) < as_of - F.make_dt_interval(mins=F.lit(minutes)))


# Seconds to wait between tiers when a server limits the rate, and before giving up.
WAITS, LAST_WAIT = {"lightpanda": 120, "playwright": 600}, 600


def escalation_wait(tier: Column, following: Column, status: Column, proxy: bool = True) -> Column:
    """Seconds before the next tier is tried: none unless the server said 429 or 503; a bound before giving up if there is a proxy."""
    waits = F.when(tier == "lightpanda", WAITS["lightpanda"]).when(tier == "playwright", WAITS["playwright"]).otherwise(0)
    return F.when(following.isNull(), LAST_WAIT if proxy else 0).when(status.isin(429, 503), waits).otherwise(0)


def recovered(jobs: DataFrame, as_of: Column, minutes: int = 10, retries: int = 2) -> DataFrame:
    """Stale running jobs (id, retry_count, active_at) with next_status: pending for another try, failed after the last."""
    stale = jobs.where((F.col("status") == "running") & (F.col("active_at") < as_of - F.make_dt_interval(mins=F.lit(minutes))))
    again = F.coalesce("retry_count", F.lit(0)) < retries
    return stale.select("id", F.when(again, "pending").otherwise("failed").alias("next_status"), (F.coalesce("retry_count", F.lit(0)) + again.cast("int")).alias("retry_count"))

"""Intent signals: predicates over recent facts, for all organisations in one join instead of a loop."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Look-back in days and the most matches that a signal reports.
DAYS = {"job_change": 1, "funding_round": 7, "tech_stack_change": 7, "hiring_spike": 7}
MOST = {"job_change": 100, "funding_round": 50, "tech_stack_change": 50}
_RULE = "type string, filters struct<job_title_contains string, technology string, spike_threshold int>"


def _field(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def _holds(value: Column, part: Column) -> Column:
    return F.contains(F.lower(value), F.lower(part))


def rules(signals: DataFrame) -> DataFrame:
    """(signal_id, org_id, kind, title, technology, threshold) of signals (signal_id, org_id, trigger_config)."""
    rule = F.from_json("trigger_config", _RULE)
    return signals.select("signal_id", "org_id", rule.alias("r")).select(
        "signal_id", "org_id", F.col("r.type").alias("kind"), F.coalesce("r.filters.job_title_contains", F.lit("")).alias("title"),
        F.coalesce("r.filters.technology", F.lit("")).alias("technology"), (F.coalesce("r.filters.spike_threshold", F.lit(3)) * 2).alias("threshold"))


def matches(signals: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """(signal_id, kind, id, domain, scraped_at) of facts (id, org_id, domain, data_type, metadata, scraped_at) that a signal's rule picks.

    The newest matches up to the signal's bound, ties by id. Signals of other kinds match nothing.
    """
    facts = facts.select("id", "org_id", "domain", "data_type", "metadata", "scraped_at").where(F.col("scraped_at") > as_of - F.expr("INTERVAL 7 DAYS"))
    both = facts.join(rules(signals), "org_id")
    recent = F.col("scraped_at") > as_of - F.expr("INTERVAL 1 DAY")
    hit = (
        F.when(F.col("kind") == "job_change", (F.col("data_type") == "contact") & recent & _holds(_field("job_title"), F.col("title")))
        .when(F.col("kind") == "funding_round", (_field("type") == "funding") | (_field("category") == "funding"))
        .when(F.col("kind") == "tech_stack_change", (F.col("data_type") == "tech_stack") & (_holds(_field("platform"), F.col("technology")) | _holds(_field("technology"), F.col("technology"))))
    )
    most = F.element_at(F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv]), F.col("kind"))
    rank = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("scraped_at"), "id"))
    return both.where(hit).withColumn("_n", rank).where(F.col("_n") <= most).select("signal_id", "kind", "id", "domain", "scraped_at")


def spikes(signals: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """(signal_id, domain, n): domains with at least twice the threshold of job postings in a week."""
    posts = facts.where((F.col("data_type") == "job_posting") & (F.col("scraped_at") > as_of - F.expr("INTERVAL 7 DAYS")))
    counts = posts.groupBy("org_id", "domain").agg(F.count("*").alias("n"))
    return counts.join(rules(signals).where("kind = 'hiring_spike'"), "org_id").where("n >= threshold").select("signal_id", "domain", "n")


def evaluate(signals: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """(signal_id, kind, match_count, trigger) of the signals that fire; ``trigger`` says why."""
    found = matches(signals, facts, as_of).select("signal_id", "kind", F.lit(1).alias("one"))
    found = found.unionByName(spikes(signals, facts, as_of).select("signal_id", F.lit("hiring_spike").alias("kind"), F.lit(1).alias("one")))
    n = F.col("match_count").cast("string")
    said = (
        F.when(F.col("kind") == "job_change", F.concat(F.lit("Found "), n, F.lit(" contacts with job title containing '"), "title", F.lit("'")))
        .when(F.col("kind") == "funding_round", F.concat(F.lit("Found "), n, F.lit(" funding announcements")))
        .when(F.col("kind") == "tech_stack_change", F.concat(F.lit("Found "), n, F.lit(" companies using "), "technology"))
        .otherwise(F.concat(F.lit("Found "), n, F.lit(" companies with hiring spikes")))
    )
    counted = found.groupBy("signal_id", "kind").agg(F.count("*").alias("match_count"))
    return counted.join(rules(signals).select("signal_id", "title", "technology"), "signal_id").select("signal_id", "kind", "match_count", said.alias("trigger"))


# The signal types with their names and categories.
TYPES = [
    ("job_change", "Job Change Detected", "people"), ("funding_round", "Funding Round Announced", "company"), ("tech_stack_change", "Tech Stack Change", "technology"),
    ("pricing_change", "Pricing Page Change", "behavior"), ("hiring_spike", "Hiring Spike", "company"),
]


def catalog(spark: SparkSession, category: str | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, category) of enabled signal types, of one category if given, by category and name."""
    rows = spark.createDataFrame(TYPES, "id string, name string, category string")
    rows = rows.where(~F.col("id").isin(list(disabled))) if disabled else rows
    return (rows if category is None else rows.where(F.col("category") == category)).orderBy("category", "name")


def payloads(signals: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """(signal_id, payload): JSON of the matches, their count, the kind and the trigger's text of each signal that fires.

    The matches of a kind are bounded (``MOST``); of spikes they are domains.
    """
    found = matches(signals, facts, as_of)
    one = F.struct("id", "domain", F.col("scraped_at").cast("string").alias("scraped_at"))
    lists = found.groupBy("signal_id").agg(F.array_sort(F.collect_list(one)).alias("matches"))
    spiked = spikes(signals, facts, as_of).groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct(F.lit(None).cast("long").alias("id"), "domain", F.col("n").cast("string").alias("scraped_at")))).alias("matches"))
    fired = evaluate(signals, facts, as_of).join(lists.unionByName(spiked), "signal_id")
    return fired.select("signal_id", F.to_json(F.struct("matches", "match_count", F.col("kind").alias("signal_type"), "trigger")).alias("payload"))


def events(signals: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """(channel, event): the JSON that each firing signal (with a name) publishes on its organisation's channel."""
    fired = payloads(signals, facts, as_of).join(signals.select("signal_id", "org_id", "name"), "signal_id")
    body = F.struct(F.lit("signal_fired").alias("event_type"), F.col("signal_id").cast("string").alias("signal_id"), F.col("name").alias("signal_name"), F.col("payload").alias("matched_data"), as_of.cast("string").alias("timestamp"))
    return fired.select(F.concat(F.lit("intent:org:"), F.col("org_id").cast("string")).alias("channel"), F.to_json(body).alias("event"))


def dry_run(signals: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """(signal_id, would_fire, match_count, message) of every signal, without acting on it."""
    fired = evaluate(signals, facts, as_of).select("signal_id", "match_count")
    n = F.coalesce("match_count", F.lit(0))
    said = F.when(n > 0, F.concat(F.lit("Signal would fire with "), n.cast("string"), F.lit(" matches"))).otherwise("Signal would not fire - no matches found")
    return signals.select("signal_id").join(fired, "signal_id", "left").select("signal_id", (n > 0).alias("would_fire"), n.alias("match_count"), said.alias("message"))


def condition(tree: dict, columns: dict[str, Column]) -> Column:
    """A tree of conditions as one expression: {operator: AND or OR, conditions: [trees or {field, op, value}]}.

    Operators are =, !=, <, <=, >, >=, contains and in; an empty list holds. A field that is null fulfils none.
    """
    if "field" in tree:
        x, value = columns[tree["field"]], tree["value"]
        tests = {
            "=": lambda: x == value, "!=": lambda: x != value, "<": lambda: x < value, "<=": lambda: x <= value, ">": lambda: x > value, ">=": lambda: x >= value,
            "contains": lambda: _holds(x, F.lit(value)), "in": lambda: x.isin(list(value)),
        }
        return F.coalesce(tests[tree["op"]](), F.lit(False))
    parts = [condition(x, columns) for x in tree.get("conditions", [])]
    if not parts:
        return F.lit(True)
    return functools.reduce((lambda a, b: a & b) if tree.get("operator", "AND").upper() == "AND" else (lambda a, b: a | b), parts)


def price_changes(snapshots: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(domain, at, plan, change, percent): plans added, removed or dearer by more than ``threshold`` percent from one snapshot of a domain to the next.

    snapshots: (domain, at, plan, price), a row per plan of each time a domain was seen.
    """
    seen = snapshots.groupBy("domain", "at").agg(F.map_from_entries(F.collect_list(F.struct("plan", "price"))).alias("now"))
    seen = seen.withColumn("before", F.lag("now").over(Window.partitionBy("domain").orderBy("at"))).where("before is not null")
    all_ = F.array_sort(F.array_union(F.map_keys("now"), F.map_keys("before")))
    rows = seen.select("domain", "at", "now", "before", F.explode(all_).alias("plan")).select("domain", "at", "plan", F.try_element_at("now", F.col("plan")).alias("new"), F.try_element_at("before", F.col("plan")).alias("old"), F.map_contains_key("now", F.col("plan")).alias("has"), F.map_contains_key("before", F.col("plan")).alias("had"))
    percent = F.round((F.col("new") - F.col("old")) * 100.0 / F.col("old"), 2)
    change = F.when(~F.col("had"), "added").when(~F.col("has"), "removed").when(percent > threshold, "increase")
    return rows.withColumn("change", change).where("change is not null").select("domain", "at", "plan", "change", F.when(F.col("change") == "increase", percent).alias("percent"))

"""Text expressions of extraction: blanks, words, prices, keywords, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords in the order in which they are tried.
CYCLES = [("monthly", r"(?i)month|/mo|per month"), ("annual", r"(?i)year|annual|/yr|per year"), ("quarterly", r"(?i)quarter|/qtr")]
RESOURCES = [
    ("whitepaper", r"(?i)whitepaper|white\s*paper"), ("case_study", r"(?i)case\s*stud|success\s*stor"), ("webinar", "(?i)webinar|on-demand"),
    ("ebook", "(?i)ebook|e-book|guide"), ("report", "(?i)report|research"), ("infographic", "(?i)infographic"),
]

# Labels of record types; others are their names in title case.
LABELS = {
    "blog_url": "Blog URLs", "article": "Articles", "contact": "Contacts", "tech_stack": "Tech Stack", "resource": "Resources", "pricing": "Pricing", "page": "Pages", "document": "Documents", "extracted": "Extracted",
}
# Job titles with their functions, in the order in which parts of a title are tried.
FUNCTIONS = {
    "ceo": "Executive", "coo": "Executive", "cto": "Technology", "cfo": "Finance", "cio": "Technology", "cmo": "Marketing", "cpo": "Product", "cro": "Sales", "chro": "Human Resources",
    "vp marketing": "Marketing", "vp sales": "Sales", "vp engineering": "Technology", "vp product": "Product", "vp finance": "Finance", "vp operations": "Operations", "vp hr": "Human Resources",
    "director of marketing": "Marketing", "director of sales": "Sales", "director of engineering": "Technology", "director of demand gen": "Marketing", "director of demand generation": "Marketing",
    "director of product": "Product", "director of hr": "Human Resources", "director of finance": "Finance", "director of operations": "Operations", "director of it": "Technology",
    "head of marketing": "Marketing", "head of sales": "Sales", "head of engineering": "Technology", "head of product": "Product", "head of hr": "Human Resources", "head of growth": "Marketing",
    "head of content": "Marketing", "head of design": "Design", "head of data": "Technology", "marketing manager": "Marketing", "sales manager": "Sales", "engineering manager": "Technology",
    "product manager": "Product", "project manager": "Operations", "hr manager": "Human Resources", "finance manager": "Finance", "it manager": "Technology", "account executive": "Sales",
    "software engineer": "Technology", "data scientist": "Technology", "recruiter": "Human Resources", "accountant": "Finance", "controller": "Finance", "general counsel": "Legal",
}
# Accepted languages and time zones of regions.
REGIONS = {
    "us": ("en-US,en;q=0.9", "America/New_York"), "eu": ("en-GB,en;q=0.9,de;q=0.8", "Europe/London"), "uk": ("en-GB,en;q=0.9", "Europe/London"), "de": ("de-DE,de;q=0.9,en;q=0.8", "Europe/Berlin"),
    "asia": ("en;q=0.9,ja;q=0.8", "Asia/Tokyo"), "in": ("en-IN,en;q=0.9,hi;q=0.8", "Asia/Kolkata"), "au": ("en-AU,en;q=0.9", "Australia/Sydney"),
}


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0))


def first_price(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"[$€£¥]\s*[\d,]+(\.\d{2})?", 0), F.lit(""))


def first_keyword(text: Column, keywords: list[tuple[str, str]]) -> Column:
    out = None
    for name, pattern in keywords:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")


def full_name(first: Column, last: Column) -> Column:
    return F.nullif(F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))), F.lit(""))


def coerced_number(text: Column) -> Column:
    """A number as text if it is one without thousands marks and dollar signs, else the text."""
    bare = F.regexp_replace(text, "[,$]", "")
    return F.coalesce(bare.try_cast("bigint").cast("string"), bare.try_cast("double").cast("string"), text)


def lookup(key: Column, values: dict[str, object]) -> Column:
    """The value of a key; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def reading_minutes(words: Column) -> Column:
    """At 238 words a minute, to a tenth, halves to the even one."""
    return F.bround(words / 238.0, 1)


def squeezed(text: Column) -> Column:
    """At most one blank line in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def plain(html: Column, most: int = 30_000) -> Column:
    """Text of a page without scripts and styles, one piece of text a line; what is cut off is marked."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    pieces = F.transform(F.split(out, r"(?s)<[^>]*>"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    text = F.array_join(F.filter(pieces, lambda x: x != ""), "\n")
    for entity, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[... truncated]"))).otherwise(text)


def fenced_json(text: Column) -> Column:
    """JSON out of an answer that may stand in a fence of backticks; null if it is none."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n|^```", ""), r"```$", "")
    bare = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")
    return F.when(F.try_parse_json(bare).isNotNull(), bare)


def names(full: Column) -> Column:
    """(first, last): the first word, and the others joined by one blank; '' where there is none."""
    parts = F.filter(F.split(full, r"(?U)\s+"), lambda x: x != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.array_join(F.slice(parts, 2, 100), " "), F.lit("")).alias("last"))


def job_function(title: Column) -> Column:
    """The function of a title, else of the first known title that it contains; null for none."""
    low = F.trim(F.lower(title))
    return F.coalesce(lookup(low, FUNCTIONS), *[F.when(low.contains(k), v) for k, v in FUNCTIONS.items()])


def label(data_type: Column) -> Column:
    return F.coalesce(lookup(data_type, LABELS), F.initcap(F.replace(data_type, F.lit("_"), F.lit(" "))))


def elapsed_ms(status: Column, since: Column, as_of: Column) -> Column:
    """Milliseconds since a running job began; null for others."""
    return F.when(status == "running", F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(since.cast("timestamp")))


def age(at: Column, as_of: Column) -> Column:
    """How long ago, in the largest whole unit up to days, then month and day; ``never`` for null."""
    seconds = F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.unix_micros(at.cast("timestamp")) / 1e6
    ago = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))
    out = F.when(at.isNull(), "never").when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86_400, ago(3600, "h")).when(seconds < 604_800, ago(86_400, "d"))
    return out.otherwise(F.date_format(at, "MMM dd"))


def region_language(region: Column) -> Column:
    return lookup(F.lower(region), {k: v[0] for k, v in REGIONS.items()})


def region_zone(region: Column) -> Column:
    return F.coalesce(lookup(F.lower(region), {k: v[1] for k, v in REGIONS.items()}), F.lit("America/New_York"))


def default_title(title: Column, url: Column, kind: str = "PDF") -> Column:
    """The title, else the kind and the last part of the address."""
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit(f"{kind}: "), F.element_at(F.split(url, "/"), -1)))

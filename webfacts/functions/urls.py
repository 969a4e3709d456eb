"""URL, domain and e-mail expressions. Four notions of a URL's domain exist; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?"

# Extensions of files that are not pages.
SKIPPED = ["pdf", "jpg", "jpeg", "png", "gif", "svg", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov", "zip", "gz", "tar", "xml", "rss", "atom"]
# Extensions of files that are not articles.
NO_ARTICLE = ["doc", "docx", "zip", "png", "jpg", "jpeg", "gif", "svg", "webp", "mp3", "mp4", "avi"]
# URL classes, tried in this order on the path.
CLASSES = [
    ("pricing", r"(?i)/(pricing|plans?|packages?)\b"),
    ("contact", r"(?i)/(contact|get-in-touch|demo|request|careers?|jobs?)\b"),
    ("resource", r"(?i)/((resources?|whitepapers?|webinars?|ebooks?|library|downloads?|guides?)\b|case-stud)"),
    ("blog_url", r"(?i)/((blog|insights?|news|articles?|posts?|stories)\b|\d{4}/\d{2}/)"),
    ("contact", r"(?i)/(team|about|leadership|people|our-team|staff)\b"),
]
# Throw-away and free mail providers.
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "protonmail.com", "zoho.com", "yandex.com"]
DISPOSABLE = ["mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "temp-mail.org", "10minutemail.com", "yopmail.com", "sharklasers.com", "guerrillamailblock.com"]
# A telephone number as it is written in the United States.
PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def part(url: Column, k: int) -> Column:
    """Scheme (1), host (2), path (3) or query with its mark (4); '' where absent."""
    return F.regexp_extract(url, _SPLIT, k)


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Lower-case scheme and host, no fragment, no slash at the path's end but for the root; against a base unless it is http(s)."""
    if base is not None:
        url = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(resolve_url(base, url))
    path = F.regexp_replace(part(url, 3), "/+$", "")
    scheme, host = F.lower(part(url, 1)), F.lower(part(url, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path == "", "/").otherwise(path), part(url, 4))


def _without_dots(base: Column, path: Column) -> Column:
    """A reference's path against a base's (RFC 3986, 5.2.4); blank segments of a relative one go, and a root stays a root."""
    above = F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0)))
    whole = F.concat(above, F.split(path, "/"))
    # the first and the last segment may be blank
    inner = F.filter(F.transform(whole, lambda x, i: F.when((x != "") | (i == 0) | (i == F.size(whole) - 1), x)), lambda x: x.isNotNull())
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(inner)
    none = F.array().cast("array<string>")
    kept = F.aggregate(segments, none, lambda seen, x: F.when(x == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).when(x == ".", seen).otherwise(F.concat(seen, F.array(x))))
    ended = F.concat(kept, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))
    joined = F.array_join(ended, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_url(base: Column, href: Column) -> Column:
    """A reference against an absolute base (RFC 3986, 5.2); a blank one is the base itself."""
    scheme = F.concat(part(base, 1), F.lit(":"))
    root = F.concat(scheme, F.lit("//"), part(base, 2))
    rest = F.concat(part(href, 4), part(href, 5))
    query = F.when(part(href, 4) != "", part(href, 4)).otherwise(part(base, 4))
    return (
        F.when(href == "", base).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(part(href, 3) == "", F.concat(root, part(base, 3), query, part(href, 5))).otherwise(F.concat(root, _without_dots(part(base, 3), part(href, 3)), rest))
    )


def extract_domain(url: Column) -> Column:
    """Host, else the first path segment; one leading ``www.`` goes, then lower case."""
    host = F.when(part(url, 2) != "", part(url, 2)).otherwise(F.split_part(part(url, 3), F.lit("/"), F.lit(1)))
    return F.lower(F.regexp_replace(host, r"^www\.", ""))


def search_domain(url: Column) -> Column:
    """Host without a leading ``www.``, its case kept."""
    return F.regexp_replace(part(url, 2), r"^www\.", "")


def crawl_domain(url: Column) -> Column:
    """Host in lower case without ``www.`` anywhere."""
    return F.replace(F.lower(part(url, 2)), F.lit("www."), F.lit(""))


def listed_domain(value: Column) -> Column:
    """A domain as typed into a list: no blanks, quotes, scheme or path."""
    return F.split_part(F.regexp_replace(F.trim(value, F.lit(" \"'")), "^(?i)https?://", ""), F.lit("/"), F.lit(1))


def is_domain(value: Column) -> Column:
    return (F.length(value) >= 3) & value.contains(".") & ~value.contains(" ") & value.rlike("[A-Za-z]")


def ensure_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def is_page_url(url: Column) -> Column:
    """Worth fetching: no fragment, mail, phone or script reference and no file of a skipped extension."""
    return ~((url == "") | url.rlike("^(#|mailto:|tel:|javascript:)") | F.lower(part(url, 3)).rlike(rf"\.({'|'.join(SKIPPED)})$"))


def classify_url(url: Column) -> Column:
    """The first class whose pattern the path holds, else ``page``."""
    path, out = part(url, 3), None
    for name, pattern in CLASSES:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise("page")


def is_email(value: Column) -> Column:
    return value.rlike(EMAIL) & ~F.lower(F.split_part(value, F.lit("@"), F.lit(2))).isin(DISPOSABLE)


def is_business_email(value: Column) -> Column:
    return is_email(value) & ~F.lower(F.split_part(value, F.lit("@"), F.lit(2))).isin(FREE_MAIL)


def is_article_link(link: Column, source: Column) -> Column:
    """On the source's domain, with a path, and no file of an extension that articles don't have."""
    path = F.regexp_replace(part(link, 3), "/+$", "")
    return (path != "") & ~F.lower(path).rlike(rf"\.({'|'.join(NO_ARTICLE)})$") & (extract_domain(link) == extract_domain(source))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def file_name(domain: Column, job_id: Column, ending: str) -> Column:
    """A file name of a domain's dots as underscores and the first 8 characters of a job's id."""
    return F.concat(F.replace(domain, F.lit("."), F.lit("_")), F.lit("_"), F.substring(job_id.cast("string"), 1, 8), F.lit(f".{ending}"))


def slug(name: Column) -> Column:
    """Lower case, blanks and underscores as hyphens."""
    return F.translate(F.lower(name), " _", "--")


def key_hash(key: Column) -> Column:
    """Of an API key: SHA-256 in hex."""
    return F.sha2(key, 256)


def proxy_hash(url: Column) -> Column:
    """Of a proxy's address: the first 12 hex digits of its MD5."""
    return F.substring(F.md5(url), 1, 12)


def emails(text: Column) -> Column:
    """All addresses in a text."""
    return F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"), F.lit(0))

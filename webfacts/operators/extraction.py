"""Records out of pages with nodes (see ``functions.dom``): people, plans, resources, articles, fields of a schema, tables.

Every function takes the column of nodes and returns a column, so that all
records of a page come from one parse and no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import html, texts, urls

# Selectors, each list in the order in which it is tried.
CARDS = [".team-member", ".staff-card", ".person", ".bio-card", ".team-card", ".leadership-card", ".member-card", ".about-team .card"]
CARD_NAMES = ["h3", "h4", ".name", ".member-name", "strong"]
CARD_TITLES = [".title", ".position", ".role", ".job-title", "p"]
PLANS = [".pricing-card", ".plan", ".tier", ".price-box", ".pricing-table > div", ".pricing-column"]
PLAN_NAMES = ["h2", "h3", "h4", ".plan-name", ".tier-title", ".name"]
RESOURCES = [".resource", ".resource-card", ".content-item", ".card", "article", ".download-item", "li"]
RESOURCE_TITLES = ["h2", "h3", "h4", ".title", "a"]
CATEGORIES = ["a[rel='tag']", ".category a", ".tag a", ".post-categories a", ".entry-categories a"]
CONTENT = [".entry-content", ".post-content", ".post-body", ".article-content", ".blog-content", "article", "main", "#left_content", "#content", ".content", "#main-content", ".main-content", "body"]
MAIN = ["main", "article", "[role='main']", "#content", ".content", ".post-content", ".entry-content", ".main-content", "#main-content", "body"]
NOISE = "nav, footer, header, aside, .sidebar, .ads, script, style"
FAVICONS = ["link[rel='icon'][type='image/png']", "link[rel='icon'][type='image/svg+xml']", "link[rel='icon']", "link[rel='shortcut icon']"]
GENERIC_MAIL = ["info", "support", "sales", "help", "admin", "contact", "hello", "noreply", "no-reply", "webmaster", "privacy", "legal"]
BLOG = {
    "link": ["a.entry-title", "h2.entry-title a", ".post-title a", "article a[rel='bookmark']", ".entry-header a"],
    "title": ["h1.entry-title", ".post-title", "h1.wp-block-post-title", ".entry-title"],
    "date": ["time.entry-date", ".post-date", "time[datetime]", ".published", ".entry-date"],
    "author": [".author", ".entry-author", ".vcard .fn", "a[rel='author']", ".byline .author"],
    "content": [".entry-content", ".post-content", ".the-content", "article .content"],
}
LISTING = ["article a", "h2 a", ".post-title a", ".entry-title a", "a[rel='bookmark']"]
# What gives a content system away, in the order in which they are tried, and selectors of each template.
SYSTEMS = {
    "wordpress": ["wp-content", "wp-includes", "wordpress", "wp-json", "wp-admin"],
    "hubspot": ["js.hs-scripts.com", "hs-script-loader", "hubspot", ".hs-", "hbspt"],
    "webflow": ["webflow.com", "wf-page", "wf-section", "w-dyn-list"],
}
TEMPLATES = {
    "wordpress": BLOG,
    "hubspot": {
        "link": [".blog-listing a", ".hs-blog-post a", ".post-listing-wrapper a", "a.blog-post-link"],
        "title": ["h1", ".blog-post-title", ".hs-blog-post-title"],
        "author": [".author-name", ".blog-post-author", ".hs-author-name"],
    },
    "webflow": {
        "link": [".w-dyn-item a", ".collection-item a", ".blog-link"],
        "title": ["h1", ".blog-title", ".post-title"],
    },
    "directory": {"link": [], "title": []},
    "generic": {
        "link": ["article a", "h2 a", "h3 a", ".post a", ".entry a"],
        "title": ["h1", "title", ".entry-title", ".post-title"],
    },
}

_PERSON = ["first_name", "last_name", "job_title", "email", "linkedin_url", "source"]
_LD = "array<struct<`@type`: string, name: string, jobTitle: string, email: string, sameAs: string>>"


def _person(source: str, **values: Column) -> Column:
    return F.struct(*[(F.lit(source) if c == "source" else values.get(c, F.lit(None).cast("string"))).alias(c) for c in _PERSON])


def _name(value: Column) -> dict[str, Column]:
    parts = F.split(value, " ", 2)
    return {"first_name": F.get(parts, F.lit(0)), "last_name": F.get(parts, F.lit(1))}


def _opened(dom: Column, node: Column) -> Column:
    return F.struct(D.below(dom, node).alias("own"), D.raw_text(dom, node).alias("text"))


def people_from_data(dom: Column) -> Column:
    """Persons of embedded JSON-LD, single or in a list; what does not parse gives none."""
    scripts = F.transform(D.select(dom, "script[type='application/ld+json']"), lambda x: F.from_json(D.raw_text(dom, x, "#code"), _LD))
    items = F.filter(F.flatten(F.filter(scripts, lambda x: x.isNotNull())), lambda x: x["@type"] == "Person")
    return F.transform(items, lambda x: _person("json_ld", **_name(F.coalesce(x["name"], F.lit(""))), job_title=x["jobTitle"], email=x["email"], linkedin_url=x["sameAs"]))


def people_from_cards(dom: Column) -> Column:
    """Named cards of the first selector that has any."""

    def one(own: Column) -> Column:
        profile = F.get(F.filter(D.select(own, "a[href]"), lambda a: a["attrs"]["href"].contains("linkedin.com/in/")), F.lit(0))
        person = lambda name: _person("team_page", **_name(name), job_title=D.some_text(own, CARD_TITLES), linkedin_url=profile["attrs"]["href"])
        return D.let(D.some_text(own, CARD_NAMES), person)

    return D.first_yielding(dom, CARDS, lambda card: D.let(D.below(dom, card), one), lambda x: x["first_name"].isNotNull())


def people_from_text(dom: Column) -> Column:
    """Addresses in the body's text that are personal, then profile links written in it."""
    text = F.coalesce(D.raw_text(dom, D.first(dom, "body")), F.lit(""))
    mails = F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"), F.lit(0))
    # an end of mixed case is text run into the address
    mails = F.filter(mails, lambda x: ~F.lower(x).rlike(f"^({'|'.join(GENERIC_MAIL)})@") & x.rlike(r"\.([a-z]+|[A-Z]+)$"))
    profiles = F.regexp_extract_all(text, F.lit(r"https?://(?:www\.)?linkedin\.com/in/[\w-]+"), F.lit(0))
    return F.concat(F.transform(mails, lambda x: _person("email_pattern", email=x)), F.transform(profiles, lambda x: _person("linkedin_pattern", linkedin_url=x)))


def merged(people: Column) -> Column:
    """People merged in order: by e-mail, else by full name, both without case; the first one's empty fields are filled."""
    key = lambda x: F.lower(F.coalesce(x["email"], F.lit("")))
    name = lambda x: F.lower(F.trim(F.concat_ws(" ", x["first_name"], x["last_name"])))
    keyed = F.transform(people, lambda x: F.struct(key(x).alias("k"), name(x).alias("n"), x.alias("p")))

    def add(seen: Column, x: Column) -> Column:
        mail = F.when(x["k"] != "", F.array_position(F.transform(seen, lambda y: y["k"]), x["k"])).otherwise(0)
        called = F.when(x["n"] != "", F.array_position(F.transform(seen, lambda y: y["n"]), x["n"])).otherwise(0)
        at = F.when(mail > 0, mail).otherwise(called)
        filled = lambda y: F.struct(*[F.when(F.coalesce(y["p"][c], F.lit("")) != "", y["p"][c]).otherwise(x["p"][c]).alias(c) for c in _PERSON])
        changed = F.transform(seen, lambda y, i: F.when(i == at - 1, F.struct(y["k"].alias("k"), y["n"].alias("n"), filled(y).alias("p"))).otherwise(y))
        return F.when(at > 0, changed).otherwise(F.concat(seen, F.array(x)))

    none = F.array().cast(f"array<struct<k: string, n: string, p: struct<{', '.join(f'{c}: string' for c in _PERSON)}>>>")
    return F.transform(F.aggregate(keyed, none, add), lambda x: x["p"])


def people(dom: Column) -> Column:
    """People of a page: of data and cards, of its text only without those; merged."""
    known = F.concat(people_from_data(dom), people_from_cards(dom))
    return merged(D.first_filled([known, people_from_text(dom)]))


# Where a contact's page has its parts.
CONTACT_PAGE = {"name": ["h1"], "job_title": ["[data-cy='contact-title']"], "company": ["[data-cy='contact-company'] a"], "email": ["a[href^='mailto:']"], "phone": ["a[href^='tel:']"]}
_CONTACT = ["first_name", "last_name", "name", "job_title", "company", "location", "headline", "email", "phone", "profile_url"]


def _contact(own: Column, address: Column, selectors: dict[str, list[str]]) -> Column:
    """A contact of the texts of selectors; e-mail and phone are what their links lead to. Without a name it is null."""

    def value(part: str) -> Column:
        if part not in selectors:
            return F.lit("")
        if part in ("email", "phone"):
            scheme = {"email": "mailto:", "phone": "tel:"}[part]
            return F.coalesce(*[F.replace(D.first(own, s)["attrs"]["href"], F.lit(scheme), F.lit("")) for s in selectors[part]], F.lit(""))
        return F.coalesce(D.some_text(own, selectors[part]), F.lit(""))

    def made(name: Column) -> Column:
        both = texts.names(name)
        values = {"first_name": both["first"], "last_name": both["last"], "name": name, "profile_url": address}
        return F.when(name != "", F.struct(*[values.get(c, value(c) if c not in values else None).alias(c) for c in _CONTACT]))

    return D.let(value("name"), made)


def contact_page(dom: Column, url: Column, selectors: dict[str, list[str]] | None = None) -> Column:
    """The contact of a page of its own, a profile or a detail page; null without a name."""
    return _contact(dom, url, CONTACT_PAGE if selectors is None else selectors)


def contact_cards(dom: Column, url: Column, cards: str, selectors: dict[str, list[str]]) -> Column:
    """The contacts of a page of search results; a card's address is that of the first link on its name."""

    def one(own: Column) -> Column:
        links = [D.first(own, s)["attrs"]["href"] for s in selectors["name"]]
        return D.let(F.coalesce(*links), lambda href: _contact(own, F.coalesce(urls.resolve_url(url, href), F.lit("")), selectors))

    return F.filter(F.transform(D.select(dom, cards), lambda card: D.let(D.below(dom, card), one)), lambda x: x.isNotNull())


def plans(dom: Column) -> Column:
    """Price plans: cards with a name of the first selector that has two cards or more."""

    def one(card: Column) -> Column:
        own, text = card["own"], card["text"]
        items = F.transform(F.filter(D.select(D.below(own, D.first(own, "ul")), "li"), lambda x: F.length(D.raw_text(own, x)) > 3), lambda x: F.trim(D.raw_text(own, x)))
        return F.struct(
            D.some_text(own, PLAN_NAMES).alias("plan_name"), texts.first_price(text).alias("price"), texts.first_keyword(text, texts.CYCLES).alias("billing_cycle"),
            F.coalesce(F.slice(items, 1, 10), F.array()).alias("features"), text.rlike("(?i)free trial|try free").alias("has_free_trial"), D.some_text(own, ["button, .cta, a.btn"]).alias("cta_text"),
        )

    return D.first_yielding(dom, PLANS, lambda card: D.let(_opened(dom, card), one), lambda x: F.length(x["plan_name"]) >= 2, least=2)


def resources(dom: Column, url: Column) -> Column:
    """Resources of a known kind, of the first selector that has any, and links to files to download; each URL once."""
    names = ["url", "title", "resource_type", "description", "gated", "download_url"]

    def one(item: Column) -> Column:
        own, text = item["own"], item["text"]
        href, file = D.first(own, "a")["attrs"]["href"], D.first(own, "a[href$='.pdf'], a[download]")["attrs"]["href"]
        values = [
            D.let(href, lambda x: F.when(F.coalesce(x, F.lit("")) != "", urls.resolve_url(url, x)).otherwise(url)), D.some_text(own, RESOURCE_TITLES), texts.first_keyword(text, texts.RESOURCES),
            F.trim(F.substring(text, 1, 200)), F.size(D.select(own, "form, input[type='email'], .form-wrapper")) > 0, D.let(file, lambda x: urls.resolve_url(url, x)),
        ]
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    items = D.first_yielding(dom, RESOURCES, lambda item: D.let(_opened(dom, item), one), lambda x: (F.length(x["title"]) >= 5) & (x["resource_type"] != "unknown"))

    def link(a: Column) -> Column:
        to, text = urls.resolve_url(url, a["attrs"]["href"]), F.trim(D.raw_text(dom, a))
        kind = texts.first_keyword(F.concat(text, F.lit(" "), to), texts.RESOURCES)
        values = [to, F.when(text != "", text), kind, F.lit(None).cast("string"), F.lit(False), to]
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    files = F.filter(D.select(dom, "a[href$='.pdf'], a[download], a[href*='download']"), lambda a: F.coalesce(a["attrs"]["href"], F.lit("")) != "")
    found = F.concat(items, F.transform(files, link))
    return D.let(found, lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y["url"]), x["url"]) == i + 1))


def categories(dom: Column) -> Column:
    """Texts of category and tag links, each once."""
    found = [F.transform(D.select(dom, s), lambda x: F.trim(D.raw_text(dom, x))) for s in CATEGORIES]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x != ""))


def content(dom: Column, most: int = 50_000) -> Column:
    """The text of the first content element with over 100 characters, cut to ``most``."""
    return F.substring(D.some_text(dom, CONTENT, "length(t) > 100"), 1, most)


def rich_metadata(dom: Column, url: Column) -> Column:
    """A map of title, Open Graph, card and standard meta tags, favicon and canonical address; no empty values, the last of a kind wins."""

    def entry(x: Column) -> Column:
        a = x["attrs"]
        key = F.when(a["property"].startswith("og:"), F.concat(F.lit("og_"), F.replace(F.replace(a["property"], F.lit("og:"), F.lit("")), F.lit(":"), F.lit("_"))))
        key = key.when(a["name"].startswith("twitter:"), F.concat(F.lit("twitter_"), F.replace(F.replace(a["name"], F.lit("twitter:"), F.lit("")), F.lit(":"), F.lit("_"))))
        key = key.when(a["name"].isin("description", "keywords", "author"), a["name"])
        return F.struct(key.alias("key"), a["content"].alias("value"))

    def one(key: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))

    icon = F.coalesce(*[D.first(dom, s)["attrs"]["href"] for s in FAVICONS])
    icon = D.let(icon, lambda x: F.when(x.startswith("http"), x).otherwise(urls.resolve_url(url, x)))
    found = F.concat(
        one("title", F.trim(D.raw_text(dom, D.first(dom, "title")))), F.filter(F.transform(D.select(dom, "meta"), entry), lambda x: x["key"].isNotNull()),
        one("favicon", icon), one("canonical_url", D.first(dom, "link[rel='canonical']")["attrs"]["href"]),
    )
    last = D.let(found, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["key"] == x["key"])))
    return F.map_from_entries(F.filter(last, lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def article(dom: Column, selectors: dict[str, list[str]] = BLOG) -> Column:
    """title, author, date (its ``datetime``, else its text), word_count and excerpt by lists of selectors."""
    body = D.some_text(dom, selectors["content"])
    at = F.coalesce(*[D.first(dom, s) for s in selectors["date"]])
    day = D.let(at, lambda x: F.coalesce(F.when(x["attrs"]["datetime"] != "", x["attrs"]["datetime"]), D.text_of(dom, x)))
    return D.let(body, lambda text: F.struct(
        D.some_text(dom, selectors["title"]).alias("title"), D.some_text(dom, selectors["author"]).alias("author"), day.alias("date"),
        texts.word_count(text).alias("word_count"), F.substring(text, 1, 300).alias("excerpt"),
    ))


def article_links(dom: Column, url: Column, selectors: dict[str, list[str]] = BLOG) -> Column:
    """Absolute addresses of the articles that a listing names, each once."""
    found = F.concat(*[F.transform(D.select(dom, s), lambda x: x["attrs"]["href"]) for s in selectors["link"]])
    return F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: urls.resolve_url(url, x)))


def template(page: Column) -> Column:
    """The first content system of which a page (HTML) has a mark, else ``generic``; the directory one is never found."""
    low, out = F.lower(page), None
    for name, signals in SYSTEMS.items():
        hit = F.lit(False)
        for x in signals:
            hit = hit | low.contains(x)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise("generic"), F.lit("generic"))


def templated(dom: Column, url: Column, name: Column) -> Column:
    """(title, author, links) of a page by the selectors of its template (see ``template``)."""

    def one(selectors: dict[str, list[str]]) -> Column:
        none = F.lit(None).cast("string")
        text = lambda kind: D.some_text(dom, selectors[kind]) if selectors.get(kind) else none
        links = article_links(dom, url, selectors) if selectors.get("link") else F.array().cast("array<string>")
        return F.struct(text("title").alias("title"), text("author").alias("author"), links.alias("links"))

    out = None
    for key, selectors in TEMPLATES.items():
        out = F.when(name == key, one(selectors)) if out is None else out.when(name == key, one(selectors))
    return out


def fixed_metadata(dom: Column, url: Column) -> Column:
    """url, title, description, Open Graph title, description and image, canonical address and author; '' for what lacks, the last of a kind wins."""

    def last(attribute: str, name: str) -> Column:
        found = F.filter(D.select(dom, "meta"), lambda x: F.lower(x["attrs"][attribute]) == name)
        return F.coalesce(F.try_element_at(found, F.lit(-1))["attrs"]["content"], F.lit(""))

    values = {
        "url": url, "title": F.coalesce(F.trim(D.raw_text(dom, D.first(dom, "title"))), F.lit("")), "description": last("name", "description"),
        "og_title": last("property", "og:title"), "og_description": last("property", "og:description"), "og_image": last("property", "og:image"),
        "canonical": F.coalesce(D.first(dom, "link[rel='canonical']")["attrs"]["href"], F.lit("")), "author": last("name", "author"),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def preferred_metadata(meta: Column, text: Column) -> Column:
    """Of ``fixed_metadata`` and the page's Markdown: what a reader gets, Open Graph and canonical values first."""
    some = lambda a, b: F.coalesce(F.nullif(meta[a], F.lit("")), meta[b])
    words = texts.word_count(text)
    return F.struct(
        some("canonical", "url").alias("url"), some("og_title", "title").alias("title"), meta["author"].alias("author"), some("og_description", "description").alias("description"),
        meta["og_image"].alias("og_image"), words.alias("word_count"), texts.reading_minutes(words).alias("reading_time_minutes"))


def paged_markdown(title: Column, author: Column, pages: Column, words: Column, text: Column, tables_: Column) -> Column:
    """A parsed document (tables: rows of cells, the first the header) as Markdown; tables of one row are left out."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    head = F.array(
        F.when(some(title), F.concat(F.lit("# "), title)), F.when(some(author), F.concat(F.lit("*Author: "), author, F.lit("*"))),
        F.when(some(title) | some(author), F.concat(F.lit("*Pages: "), pages.cast("string"), F.lit(" | Words: "), words.cast("string"), F.lit("*"))), F.when(some(title) | some(author), F.lit("---")),
        F.when(some(text), text), F.when(F.size(tables_) > 0, F.lit("\n---\n## Extracted Tables\n")),
    )
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def one(t: Column, i: Column) -> Column:
        first = t[0]
        padded = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(first) - F.size(r), F.lit(0)))), F.lit(1), F.size(first))
        rows = F.transform(F.slice(t, F.lit(2), F.size(t)), lambda r: line(padded(r)))
        made = F.concat(F.array(F.concat(F.lit("### Table "), (i + 1).cast("string")), line(first), line(F.transform(first, lambda _: F.lit("---")))), rows, F.array(F.lit("")))
        return F.when(F.size(t) >= 2, made).otherwise(F.array().cast("array<string>"))

    return F.array_join(F.concat(F.array_compact(head), F.flatten(F.transform(F.coalesce(tables_, F.array().cast("array<array<array<string>>>")), one))), "\n\n")


def document_records(parsed: DataFrame) -> DataFrame:
    """(page_id, data_type, url, title, metadata) of parsed files (page_id, url, title, author, pages, text, tables): their text as Markdown with its tables."""
    words = texts.word_count(F.col("text"))
    whole = paged_markdown(F.col("title"), F.col("author"), F.col("pages"), words, F.col("text"), F.col("tables"))
    meta = F.struct(F.lit("pdf").alias("source_type"), F.col("pages").alias("page_count"), "author", "tables", words.alias("word_count"), whole.alias("text_content"))
    return parsed.select("page_id", F.lit("document").alias("data_type"), "url", texts.default_title(F.col("title"), F.col("url")).alias("title"), F.to_json(meta).alias("metadata"))


def ranked_patterns(dom: Column) -> Column:
    """Tables, definition lists, grids and lists of repeated elements of a page by score, but for those inside one of at least their score: (kind, at, rows, score)."""

    def of(kind: str, selector: str, score: Callable[[Column], Column], least: int) -> Column:
        made = F.transform(D.select(dom, selector), lambda x: D.let(D.below(dom, x), lambda own: F.struct(F.lit(kind).alias("kind"), x["at"].alias("at"), x["last"].alias("last"), score(own).alias("s"))))
        return F.transform(F.filter(made, lambda x: x["s"]["rows"] >= least), lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), x["last"].alias("last"), x["s"]["rows"].alias("rows"), x["s"]["score"].alias("score")))

    def scored(selector: str, each: float) -> Callable[[Column], Column]:
        return lambda own: D.let(F.size(D.select(own, selector)), lambda n: F.struct(n.alias("rows"), (n * each).alias("score")))

    def table_score(own: Column) -> Column:
        return D.let(_table(own), lambda t: F.struct(F.size(t["rows"]).alias("rows"), t["score"].alias("score")))

    found = F.concat(
        of("table", "table", table_score, 2), of("definitions", "dl", scored("dt", 7.0), 2), of("grid", "[role='grid'], [role='table']", scored("[role='row']", 8.0), 3),
        of("repeated", "ul, ol", scored("li", 6.5), 3),
    )
    inside = lambda x, y: (y["at"] < x["at"]) & (x["last"] <= y["last"]) & (y["score"] >= x["score"])
    kept = D.let(found, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: inside(x, y))))
    order = lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).otherwise(a["at"] - b["at"])
    return F.transform(F.array_sort(kept, order), lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), x["rows"].alias("rows"), x["score"].alias("score")))


@dataclass(frozen=True)
class Field:
    """A field of an extraction schema; ``attribute`` is ``text`` or an attribute's name."""

    name: str
    selector: str
    attribute: str = "text"
    kind: str = "string"
    transform: str = ""
    required: bool = False


def specification(schema: list[Field], listed: bool = False, description: str = "") -> str:
    """A schema as the JSON that says what is to be extracted, one object or a list of them."""
    properties = {f.name: {"type": f.kind} for f in schema}
    if listed:
        return json.dumps({"type": "array", "items": {"type": "object", "properties": properties}, "description": description or "Extract one object per item."})
    return json.dumps({"type": "object", "properties": properties, "description": description or "Extract these fields from the content."})


def _value(own: Column, field: Field) -> Column:
    node = D.first(own, field.selector)
    text = F.array_join(F.transform(F.filter(D.below(own, node), lambda x: x["tag"] == "#text"), lambda x: F.trim(x["text"])), "")
    raw = text if field.attribute == "text" else node["attrs"][field.attribute]
    raw = {"strip": F.trim, "lower": F.lower, "upper": F.upper}.get(field.transform, lambda x: x)(raw)
    if field.kind == "number":
        return texts.coerced_number(F.trim(raw))
    if field.kind == "boolean":
        return F.lower(raw).isin("true", "yes", "1", "on").cast("string")
    if field.kind == "list":
        return F.to_json(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return raw


def fields(dom: Column, schema: list[Field]) -> Column:
    """A map from the names of fields to their values as text (lists as JSON); fields without a value are left out."""
    entries = F.array(*[F.struct(F.lit(f.name).alias("key"), _value(dom, f).alias("value")) for f in schema])
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))


def listed_fields(dom: Column, items: str, schema: list[Field]) -> Column:
    """Such a map per item; items without any value are left out."""
    return F.filter(F.transform(D.select(dom, items), lambda x: fields(D.below(dom, x), schema)), lambda x: F.size(x) > 0)


def missing(found: Column, schema: list[Field]) -> Column:
    """Required fields that a map of ``fields`` lacks."""
    required = F.array(*[F.lit(f.name) for f in schema if f.required]).cast("array<string>")
    return F.array_except(required, F.map_keys(found))


def coverage(found: Column, schema: list[Field]) -> Column:
    """The share of a schema's fields that a map of ``fields`` has; 1 for a schema without fields."""
    names = F.array(*[F.lit(f.name) for f in schema]).cast("array<string>")
    return F.size(F.array_intersect(F.map_keys(found), names)) / F.lit(float(len(schema))) if schema else F.lit(1.0)


def extracted(pages: DataFrame, schema: list[Field], second: Callable[[DataFrame], DataFrame], *, mode: str = "auto", least: float = 0.5) -> DataFrame:
    """(page_id, mode, fields, coverage) of pages (page_id, html): fields by selectors, and where these cover too little, by another extractor.

    ``second`` makes (page_id, fields), a map of texts, of pages (page_id, html); it
    gets only pages whose coverage is below ``least``, and its fields come over
    those found by selectors. Mode "css" never calls it, mode "ai" gives it every
    page. A page that it gives nothing for keeps what it had. page_id is a key.
    """
    if mode not in ("css", "ai", "auto"):
        raise ValueError(f"unknown mode {mode}")
    none = F.create_map().cast("map<string,string>")
    rows = pages.select("page_id", "html")
    if mode == "ai":
        rows = rows.withColumn("fields", none)
    else:
        rows = D.with_nodes(rows.withColumn("_raw", F.col("html")), "_raw", keep=["page_id", "html"])
        rows = rows.select("page_id", "html", F.coalesce(fields(F.col("dom"), schema), none).alias("fields"))
    rows = rows.withColumn("coverage", coverage(F.col("fields"), schema))
    weak = F.lit(mode == "ai") | (F.lit(mode == "auto") & (F.col("coverage") < least))
    done = rows.where(~weak).select("page_id", F.lit("css").alias("mode"), "fields", "coverage")
    if mode == "css":
        return done
    more = second(rows.where(weak).select("page_id", "html")).select("page_id", F.col("fields").alias("_more"))
    both = rows.where(weak).drop("html").join(more, "page_id", "left").withColumn("_more", F.coalesce("_more", none))
    both = both.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("_more", k)), "_more"))
    return done.unionByName(both.select("page_id", F.lit("ai").alias("mode"), "fields", coverage(F.col("fields"), schema).alias("coverage")))


def _cells(dom: Column, row: Column, selector: str) -> Column:
    return D.let(D.below(dom, row), lambda own: F.transform(D.select(own, selector), lambda x: D.text_of(own, x)))


def headers(names: Column) -> Column:
    """Column names: ``Column`` for blanks, and the number of its occurrence after a repeated one."""
    filled = F.transform(names, lambda x: F.when(x == "", "Column").otherwise(x))

    def numbered(x: Column, before: Column) -> Column:
        n = F.size(F.filter(before, lambda y: y == x))
        return F.when(n > 1, F.concat(x, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(x)

    return D.let(filled, lambda all_: F.transform(all_, lambda x, i: numbered(x, F.slice(all_, 1, i + 1))))


def _table(own: Column) -> Column:
    top = F.coalesce(D.first(own, "thead tr"), D.first(own, "tr"))
    parts = D.let(top, lambda head: F.struct(
        headers(_cells(own, head, "th, td")).alias("names"),
        F.filter(F.transform(F.filter(D.select(own, "tr"), lambda x: (x["at"] != head["at"]) & ~D.matches(own, x, "thead tr")), lambda x: _cells(own, x, "td, th")), lambda x: F.size(x) > 0).alias("rows"),
    ))
    score = lambda t: F.size(t["rows"]) * F.when(F.forall(t["rows"], lambda x: F.size(x) == F.size(t["names"])), 15.0).otherwise(10.0)
    return D.let(parts, lambda t: F.struct(t["names"].alias("headers"), t["rows"].alias("rows"), score(t).alias("score")))


def tables(dom: Column) -> Column:
    """Tables of two rows or more: headers, rows, score; the first row, or that of the head, names the columns."""
    found = F.transform(D.select(dom, "table"), lambda table: D.let(D.below(dom, table), _table))
    return F.array_sort(F.filter(found, lambda x: F.size(x["rows"]) >= 2), lambda a, b: F.signum(b["score"] - a["score"]).cast("int"))


def definitions(dom: Column) -> Column:
    """Definition lists of two or more terms with one definition each: terms, definitions, score."""

    def one(own: Column) -> Column:
        parts = [F.transform(D.select(own, tag), lambda x: D.text_of(own, x)) for tag in ("dt", "dd")]
        return F.struct(parts[0].alias("terms"), parts[1].alias("definitions"), (F.size(D.select(own, "dt")) * 7.0).alias("score"))

    found = F.transform(D.select(dom, "dl"), lambda x: D.let(D.below(dom, x), one))
    return F.filter(found, lambda x: (F.size(x["terms"]) >= 2) & (F.size(x["terms"]) == F.size(x["definitions"])))


def grids(dom: Column) -> Column:
    """Elements with the role of a grid or table and three rows or more: rows of cells, score."""

    def one(own: Column) -> Column:
        rows = F.transform(D.select(own, "[role='row']"), lambda x: _cells(own, x, "[role='gridcell'], [role='cell'], [role='columnheader'], [role='rowheader']"))
        return D.let(rows, lambda r: F.struct(r.alias("rows"), (F.size(r) * 8.0).alias("score")))

    found = F.transform(D.select(dom, "[role='grid'], [role='table']"), lambda x: D.let(D.below(dom, x), one))
    return F.filter(found, lambda x: F.size(x["rows"]) >= 3)


def repeated(pages: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, up, tag, classes, n, score): elements of one parent, tag and set of classes, ``least`` or more, with an element each on average.

    A page's elements are grouped by keys, so a page of any size is spread and pre-aggregated.
    """
    nodes = pages.select("page_id", F.explode("dom").alias("x")).where(~F.col("x.tag").startswith("#"))
    classes = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col("x.attrs")["class"], F.lit("")), r"\s+"), lambda c: c != ""))), " ")
    groups = nodes.groupBy("page_id", F.col("x.up").alias("up"), F.col("x.tag").alias("tag"), classes.alias("classes"))
    found = groups.agg(F.count("*").alias("n"), F.sum("x.kids").alias("kids")).where((F.col("n") >= least) & (F.col("kids") >= F.col("n")))
    return found.select("page_id", "up", "tag", "classes", "n", (F.col("n") * 5 * 1.3).alias("score"))


def markdown(dom: Column) -> Column:
    """The main content as Markdown without navigation and the like: headings, paragraphs, bullets, links, emphasis.

    Every node's opening and closing marks are put in the order of the document and joined.
    """
    blocks = "p div section article main body ul ol table tr blockquote pre figure".split()
    heads = ["h1", "h2", "h3", "h4", "h5", "h6"]
    strong, weak = ("b", "strong"), ("i", "em")

    def marks(x: Column, start: bool) -> Column:
        tag, empty = x["tag"], F.lit("")
        out = F.when(tag.isin(blocks), "\n\n").when(tag.isin(*strong), "**").when(tag.isin(*weak), "*")
        if start:
            out = out.when(tag == "#text", F.regexp_replace(x["text"], r"(?U)\s+", " ")).when(tag == "br", "\n").when(tag == "li", "\n- ").when(tag == "a", "[")
            return out.when(tag.isin(heads), F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "))).otherwise(empty)
        out = out.when(tag.isin(heads), "\n\n").when(tag.isin("td", "th"), " | ")
        return out.when(tag == "a", F.concat(F.lit("]("), F.coalesce(x["attrs"]["href"], empty), F.lit(")"))).otherwise(empty)

    def joined(own: Column) -> Column:
        step = lambda x, at, kind, order, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), order.alias("order"), text.alias("text"))
        starts = F.transform(own, lambda x: step(x, x["at"], 0, F.lit(0), marks(x, True)))
        ends = F.transform(F.filter(own, lambda x: ~x["tag"].startswith("#")), lambda x: step(x, x["last"], 1, -x["at"], marks(x, False)))
        text = F.array_join(F.transform(F.array_sort(F.concat(starts, ends)), lambda x: x["text"]), "")
        return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))

    node = F.coalesce(*[D.first(dom, s) for s in MAIN])
    return D.let(D.below(dom, node), lambda own: D.let(D.select(own, NOISE), lambda noise: joined(
        F.filter(own, lambda x: ~F.exists(noise, lambda y: (y["at"] <= x["at"]) & (x["at"] <= y["last"])))
    )))


def page_records(pages: DataFrame, types: list[str], raw_only: bool = False) -> DataFrame:
    """(page_id, data_type, url, title, metadata) of pages (page_id, url, html, dom): all records that a page gives, metadata as JSON.

    Pages of under 100 characters and those with an error's title give none;
    others a ``page`` record, and with ``raw_only`` nothing more. Of ``types``,
    articles need 200 words, tech_stack the home page, the others the URL's class.
    """
    dom, url = F.col("dom"), F.col("url")
    base = pages.where(F.length("html") >= 100).select("page_id", "url", "html", "dom", html.title(F.col("html")).alias("title"), urls.classify_url(url).alias("class"), F.rtrim(urls.part(url, 3), F.lit("/")).alias("path"))
    base = base.where(~html.is_error_title(F.col("title"))).withColumn("meta", rich_metadata(dom, url)).withColumn("content", content(dom))
    base = base.withColumn("words", texts.word_count(F.col("content")))

    def record(kind: str, title: Column, metadata: Column, to: Column = url) -> Column:
        return F.struct(F.lit(kind).alias("data_type"), to.alias("url"), title.alias("title"), metadata.cast("string").alias("metadata"))

    def joined(**own: Column) -> Column:
        """The page's metadata as JSON with the record's own, which replace those of the same names."""
        head = F.to_json(F.map_filter(F.col("meta"), lambda k, _: ~k.isin(list(own))))
        body = F.to_json(F.struct(*[v.alias(k) for k, v in own.items()]), {"ignoreNullFields": "false"})
        return F.when(F.length(head) <= 2, body).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(body, F.lit(2), F.length(body))))

    def of(x: Column, *names: str) -> Column:
        return joined(**{n: x[n] for n in names})

    def one(kind: str, ok: Column, metadata: Column, title: Column = F.col("title")) -> Column:
        return F.filter(F.array(F.when(ok, record(kind, title, metadata))), lambda x: x.isNotNull())

    def many(kind: str, found: Column, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.when(F.col("class") == kind, found).otherwise(F.slice(found, 1, 0)), make)

    links = F.filter(article_links(dom, url, {"link": LISTING}), lambda x: urls.is_article_link(x, url))
    said = F.col("meta")
    parts = {
        "blog_url": lambda: one("blog_url", F.col("class") == "blog_url", D.let(links, lambda x: joined(blog_landing_url=url, article_urls=x, total_articles=F.size(x)))),
        "article": lambda: one("article", F.col("words") >= 200, joined(author=said["author"], categories=categories(dom), word_count=F.col("words"), excerpt=said["description"], content=F.col("content"))),
        "contact": lambda: many("contact", people(dom), lambda x: record("contact", texts.full_name(x["first_name"], x["last_name"]), of(x, *_PERSON))),
        "resource": lambda: many("resource", resources(dom, url), lambda x: record("resource", x["title"], of(x, "resource_type", "description", "gated", "download_url"), x["url"])),
        "pricing": lambda: many("pricing", plans(dom), lambda x: record("pricing", x["plan_name"], of(x, "plan_name", "price", "billing_cycle", "features", "has_free_trial", "cta_text"))),
        "tech_stack": lambda: one("tech_stack", F.col("path").isin("", "/index.html"), D.let(html.technologies(F.col("html")), lambda t: of(t, "platform", "js_libraries", "analytics", "marketing_tools", "frameworks")), F.concat(F.lit("Tech Stack: "), urls.extract_domain(url))),
    }
    page = one("page", F.lit(True), F.to_json(F.struct("meta", "content", F.col("words").alias("word_count"))))
    wanted = [] if raw_only else [parts[t]() for t in parts if t in types]
    return base.select("page_id", F.explode(F.concat(page, *wanted)).alias("r")).select("page_id", "r.*")

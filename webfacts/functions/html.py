"""HTML expressions that stay in the JVM: titles, meta tags, text, markers, technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Markers of challenge pages, tried without regard to case.
CAPTCHA = [
    r"<script[^>]+src=[\"'][^\"']*recaptcha", r"class=[\"'][^\"']*g-recaptcha", r"data-sitekey=", r"<script[^>]+src=[\"'][^\"']*hcaptcha", r"class=[\"'][^\"']*h-captcha",
    r"<title[^>]*>\s*Just a moment", r"cf-challenge-running|challenge-form", r"class=[\"'][^\"']*cf-turnstile", r"px-captcha|_pxCaptcha", r"<script[^>]+src=[\"'][^\"']*datadome",
]

# Technologies, each with its category and the strings that give it away.
TECHNOLOGIES = [
    ("WordPress", "cms", ["wp-content", "wp-includes", "wordpress", "wp-json"]),
    ("HubSpot", "cms", ["js.hs-scripts.com", "hubspot", ".hs-", "hbspt"]),
    ("Webflow", "cms", ["webflow.com", "wf-page", "wf-section"]),
    ("Drupal", "cms", ["/sites/default/", "drupal.settings"]),
    ("Squarespace", "cms", ["squarespace.com", "sqsp", "static.squarespace"]),
    ("Wix", "cms", ["wix.com", "wixsite.com", "parastorage.com"]),
    ("Shopify", "cms", ["cdn.shopify.com", "shopify", "myshopify.com"]),
    ("Ghost", "cms", ["ghost.io", "ghost-", "content/themes"]),
    ("Contentful", "cms", ["contentful.com", "ctfassets.net"]),
    ("Google Analytics", "analytics", ["google-analytics.com", "gtag(", "ga.js", "googletagmanager.com"]),
    ("Segment", "analytics", ["cdn.segment.com", "analytics.js", "segment.io"]),
    ("Mixpanel", "analytics", ["mixpanel.com", "mixpanel.init"]),
    ("Amplitude", "analytics", ["amplitude.com", "cdn.amplitude.com"]),
    ("Heap", "analytics", ["heap-", "heapanalytics.com"]),
    ("Hotjar", "analytics", ["hotjar.com", "static.hotjar.com"]),
    ("Plausible", "analytics", ["plausible.io"]),
    ("Marketo", "marketing", ["munchkin.marketo.net", "mktoforms"]),
    ("Pardot", "marketing", ["pardot.com", "pi.pardot.com", "go.pardot.com"]),
    ("Drift", "marketing", ["drift.com", "driftt.com", "js.driftt.com"]),
    ("Intercom", "marketing", ["intercom.io", "intercomsettings", "widget.intercom.io"]),
    ("HubSpot Marketing", "marketing", ["js.hs-analytics.net", "forms.hubspot.com"]),
    ("Mailchimp", "marketing", ["mailchimp.com", "list-manage.com", "chimpstatic.com"]),
    ("ActiveCampaign", "marketing", ["activecampaign.com", "trackcmp.net"]),
    ("Salesforce", "marketing", ["salesforce.com", "force.com"]),
    ("ZoomInfo", "marketing", ["zoominfo.com", "ws.zoominfo.com"]),
    ("6sense", "marketing", ["6sense.com", "j.6sc.co"]),
    ("Clearbit", "marketing", ["clearbit.com", "x.clearbitjs.com"]),
    ("React", "framework", ["react.", "reactdom", "__next_data__", "_next/"]),
    ("Vue.js", "framework", ["vue.js", "__vue__", "v-if=", "vuejs"]),
    ("Angular", "framework", ["angular", "ng-version", "ng-app"]),
    ("Next.js", "framework", ["__next_data__", "_next/static", "next/dist"]),
    ("Gatsby", "framework", ["gatsby", "/page-data/"]),
    ("Nuxt", "framework", ["__nuxt", "nuxt.js"]),
    ("Svelte", "framework", ["svelte", "__svelte"]),
    ("Cloudflare", "cdn", ["cf-ray", "cloudflare"]),
    ("Fastly", "cdn", ["fastly", "x-served-by"]),
    ("Akamai", "cdn", ["akamai", "akamaitech"]),
    ("AWS CloudFront", "cdn", ["cloudfront.net", "x-amz-cf"]),
    ("Vercel", "cdn", ["vercel", "x-vercel-"]),
    ("Netlify", "cdn", ["netlify", "x-nf-request-id"]),
    ("jQuery", "js_library", ["jquery", "jquery.min.js"]),
    ("Bootstrap", "js_library", ["bootstrap.min", "bootstrap.css"]),
    ("Tailwind CSS", "js_library", ["tailwindcss", "tailwind."]),
    ("Lodash", "js_library", ["lodash", "lodash.min"]),
]
_FIELDS = {"js_libraries": "js_library", "analytics": "analytics", "marketing_tools": "marketing", "frameworks": "framework", "cdn": "cdn"}


def _element(html: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)), F.lit(""))


def title(html: Column) -> Column:
    """The title element's text, else the first heading's; null if both lack."""
    return F.coalesce(_element(html, "title"), bare_text(_element(html, "h1")))


def bare_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, blanks collapsed; null for none."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), F.lit(""))


def content(html: Column, most: int = 50_000) -> Column:
    """The text of the article, else main, else body element: the first with over 100 characters, cut to ``most``."""
    texts = [bare_text(_element(html, tag)) for tag in ("article", "main", "body")]
    return F.substring(F.coalesce(*[F.when(F.length(x) > 100, x) for x in texts]), 1, most)


def meta(html: Column, name: str) -> Column:
    """The content of the meta tag of that name, else property, whatever the order of its attributes."""
    found = []
    for attribute in ("name", "property"):
        tag = F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b{attribute}\s*=\s*["']{name}["'])[^>]*>""", 0)
        found.append(F.nullif(F.trim(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)), F.lit("")))
    return F.coalesce(*found)


def links(html: Column) -> Column:
    """References of anchors in order, each once; those to fragments, mail, phones and scripts are left out."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike("^(#|mailto:|tel:|javascript:)")))


def has_captcha(html: Column) -> Column:
    return F.coalesce(html.rlike("(?i)" + "|".join(CAPTCHA)), F.lit(False))


def is_error_title(value: Column) -> Column:
    """Whether a title names an error; 404 does as a status (first, after a mark or a word like ``page``), not within a number or after a name."""
    return F.coalesce(F.lower(value).rlike(r"error|not found|(^|[^\w\s#$\x{20ac}]|\b(http|status|code|page))\s*404(?![\w,.]*\d)"), F.lit(False))


def technologies(html: Column, headers: Column | None = None) -> Column:
    """A struct: platform, the last content system in the list that shows, and a list of names of each other category.

    ``headers`` is a map; its values count as the page's text does.
    """
    low = F.lower(F.coalesce(html, F.lit("")))
    if headers is not None:
        low = F.concat_ws("\n", low, F.lower(F.array_join(F.map_values(F.coalesce(headers, F.create_map().cast("map<string,string>"))), "\n")))
    names = {}
    for name, category, signals in TECHNOLOGIES:
        hit = low.contains(signals[0])
        for s in signals[1:]:
            hit = hit | low.contains(s)
        names.setdefault(category, []).append(F.when(hit, F.lit(name)))
    parts = [F.coalesce(*names["cms"][::-1]).alias("platform")]
    parts += [F.array_compact(F.array(*names[category])).alias(field) for field, category in _FIELDS.items()]
    return F.struct(*parts)


def signatures(spark: SparkSession) -> DataFrame:
    """(name, category, signals) of the known technologies."""
    return spark.createDataFrame(TECHNOLOGIES, "name string, category string, signals array<string>")

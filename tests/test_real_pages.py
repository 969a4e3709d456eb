"""Selectors over all given pages, against a plain walk of the same HTML."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from webfacts.functions import dom as D

DATA = "/root/testdata/sf0.001/pages.parquet"
WANTED = {
    "h1": lambda above, tag, at: tag == "h1",
    "nav li > a[href]": lambda above, tag, at: tag == "a" and "href" in at and above[-1][0] == "li" and any(t == "nav" for t, _ in above),
    ".ad": lambda above, tag, at: at.get("class") == "ad",
    "article p": lambda above, tag, at: tag == "p" and any(t == "article" for t, _ in above),
    "body > *": lambda above, tag, at: bool(above) and above[-1][0] == "body",
    "a[href^='/t'], footer, div.ad": lambda above, tag, at: tag == "a" and at.get("href", "").startswith("/t") or tag == "footer" or tag == "div" and at.get("class") == "ad",
}


class _Walk(HTMLParser):
    """For each selector, the texts of what it selects, in document order; a paragraph ends where the next block starts."""

    def __init__(self):
        super().__init__()
        self.above, self.found = [], {s: [] for s in WANTED}

    def handle_starttag(self, tag, attrs):
        if self.above and self.above[-1][0] == "p" and tag in ("p", "div", "ul", "h1", "footer"):
            self.above.pop()
        texts = []
        for s, ok in WANTED.items():
            if ok(self.above, tag, dict(attrs)):
                self.found[s].append(texts)
        if tag not in ("meta", "br"):
            self.above.append((tag, texts))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.above):
            while self.above.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.above and self.above[-1][0] not in ("script", "style"):
            for _, texts in self.above:
                texts.append(data)


def _plain(html):
    walk = _Walk()
    walk.feed(html)
    walk.close()
    return [[" ".join("".join(x).split()) for x in walk.found[s]] for s in WANTED]


def test_selectors_on_all_pages(spark):
    pages = spark.read.parquet(DATA).select("page_id", "html")
    wanted = {r.page_id: _plain(r.html) for r in pages.collect()}
    dom = F.col("dom")
    texts = [F.transform(D.select(dom, s), lambda x: D.text_of(dom, x)).alias(str(i)) for i, s in enumerate(WANTED)]
    firsts = [D.some_text(dom, [".none", s]).alias(f"f{i}") for i, s in enumerate(WANTED)]
    rows = D.with_nodes(pages).select("page_id", *texts, *firsts).collect()
    assert {r.page_id: [list(r[str(i)]) for i in range(len(WANTED))] for r in rows} == wanted
    # the first selected node alone counts, also where it has no text
    assert all(r[f"f{i}"] == ((wanted[r.page_id][i] or [""])[0] or None) for r in rows for i in range(len(WANTED)))
    assert all(sum(len(w[i]) for w in wanted.values()) for i in range(len(WANTED)))  # each selector has something to find

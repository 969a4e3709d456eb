"""Documents as node tables: a page is an array of nodes in document order, and selectors are expressions over it.

A node is (at, last, up, kids, depth, tag, classes, attrs, text): its number,
that of its last descendant and of its parent (-1 at the top), how many elements
are right below it, its level. ``b`` lies in ``a`` if a.at < b.at <= a.last, so nested
selection is a comparison of numbers and a subtree is a slice. Only the
splitting of HTML into nodes runs in Python, a slice of an Arrow batch at a time,
as the nodes of a whole batch take many times its bytes. What is
asked of nodes is written as SQL lambdas, which cost one call of the JVM each
where columns put together operator by operator cost dozens.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "array<struct<at int, last int, up int, kids int, depth int, tag string, classes array<string>, attrs map<string,string>, text string>>"
_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("last", pa.int32()), ("up", pa.int32()), ("kids", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

# Fixed values of HTML: elements without an end; elements whose start ends an open one of the kinds beside them.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
    "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"},
} | dict.fromkeys("p div ul ol dl table section article h1 h2 h3 h4 h5 h6 form blockquote pre header footer nav aside main".split(), {"p"})
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


# an ampersand that starts no reference with its semicolon, and what may stand for it while a page is split
_BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]  # no characters by Unicode


class _Splitter(HTMLParser):
    """The nodes of pages put one after the other, a list for each of their parts, so that a node is no object of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.ats, self.lasts, self.ups, self.kids, self.depths, self.tags, self.texts = [], [], [], [], [], [], []
        self.classes, self.class_ends, self.keys, self.values, self.key_ends = [], [0], [], [], [0]
        self.starts: list[int | None] = []
        self.base, self.open, self.mark = 0, [], None

    def page(self, html: str | None) -> None:
        """Adds a page; null for null. Unclosed elements end with their parent, stray ends are ignored.

        A character reference ends with a semicolon; without one it is text, in addresses as in titles.
        """
        self.base, self.open = len(self.tags), []
        self.starts.append(None if html is None else self.base)
        if html is None:
            return
        self.mark = next((m for m in _MARKS if m not in html), None) if _BARE.search(html) else None
        self.reset()
        self.feed(_BARE.sub(self.mark, html) if self.mark else html)
        self.close()
        self._end(0)

    def arrow(self) -> pa.Array:
        """An array of nodes for each page."""
        at = [pa.array(x, pa.int32()) for x in (self.ats, self.lasts, self.ups, self.kids, self.depths)]
        classes = pa.ListArray.from_arrays(pa.array(self.class_ends, pa.int32()), pa.array(self.classes, pa.string()))
        attrs = pa.MapArray.from_arrays(pa.array(self.key_ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        nodes = pa.StructArray.from_arrays([*at, pa.array(self.tags, pa.string()), classes, attrs, pa.array(self.texts, pa.string())], fields=list(_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array([*self.starts, len(self.tags)], pa.int32()), nodes)

    def _own(self, text: str | None) -> str | None:
        return text.replace(self.mark, "&") if text and self.mark else text

    def _add(self, tag: str, attrs=(), text: str | None = None) -> None:
        at = len(self.tags) - self.base
        if self.open and text is None:
            self.kids[self.base + self.open[-1]] += 1
        self.ats.append(at)
        self.lasts.append(at)
        self.ups.append(self.open[-1] if self.open else -1)
        self.kids.append(0)
        self.depths.append(len(self.open))
        self.tags.append(tag)
        self.texts.append(text)
        for k, v in attrs:
            self.keys.append(k)
            self.values.append(v)
            if k == "class":
                self.classes += _BLANKS.split(v)
        self.class_ends.append(len(self.classes))
        self.key_ends.append(len(self.keys))

    def _tag(self, at: int) -> str:
        return self.tags[self.base + at]

    def _end(self, upto: int) -> None:
        for at in self.open[upto:]:
            self.lasts[self.base + at] = len(self.tags) - self.base - 1
        del self.open[upto:]

    def handle_starttag(self, tag, attrs):
        tag, attrs = self._own(tag), [(self._own(k), self._own(v)) for k, v in attrs]
        while self.open and self._tag(self.open[-1]) in ENDS.get(tag, ()):
            self._end(len(self.open) - 1)
        self._add(tag, {k: v or "" for k, v in reversed(attrs)}.items())
        if tag not in VOID:
            self.open.append(len(self.tags) - self.base - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        tag = self._own(tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self._tag(self.open[k]) == tag:
                return self._end(k)

    def handle_data(self, data):
        code = self.open and self._tag(self.open[-1]) in ("script", "style")
        self._add("#code" if code else "#text", text=self._own(data))


#: Bytes of HTML whose nodes are made and handed on together (a page at least), whatever rows an Arrow batch has.
AT_ONCE = 1 << 20


def _slices(html: pa.Array, most: int = AT_ONCE):
    """(start, length) of slices of a batch, each of up to ``most`` bytes or one page."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(html).fill_null(0).to_pylist()):
        if i > start and size + n > most:
            yield start, i - start
            start, size = i, 0
        size += n
    if len(html) > start:
        yield start, len(html) - start


def with_nodes(pages: DataFrame, html: str = "html", name: str = "dom", keep: list[str] | None = None) -> DataFrame:
    """Adds the nodes of ``html`` to ``keep`` (all columns but ``html`` and ``name``, if not given); each page is parsed once."""
    keep = [c for c in pages.columns if c not in (html, name)] if keep is None else keep

    def run(batches):
        part = splitter = None
        for batch in batches:
            for start, n in _slices(batch.column(0)):
                part, splitter = batch.slice(start, n), _Splitter()
                for x in part.column(0):
                    splitter.page(x.as_py())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], splitter.arrow()], [*keep, name])
            batch = part = splitter = None  # before the next batch is read

    rows = pages.select(F.col(html).alias("_html"), *keep)
    schema = rows.drop("_html").withColumn(name, F.lit(None).cast(NODES)).schema
    return rows.mapInArrow(run, schema)


_SIMPLE = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")
_STEP = re.compile(r"(>)|([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has(x: str, kind: str, name: str, attribute: str, how: str, value: str) -> str:
    if kind == ".":
        return f"array_contains({x}.classes, {_quoted(name)})"
    own, value = f"{x}.attrs[{_quoted('id' if kind == '#' else attribute)}]", _quoted(name if kind == "#" else value)
    if kind != "#" and not how:
        return f"{own} IS NOT NULL"
    return {"=": f"coalesce({own} = {value}, false)", "*=": f"coalesce(contains({own}, {value}), false)", "^=": f"coalesce(startswith({own}, {value}), false)", "$=": f"coalesce(endswith({own}, {value}), false)"}[how or "="]


def _steps(selector: str) -> list[tuple[bool, str, str]]:
    """(child of the step before, tag, conditions) of each step of a selector of tags, classes, ids and attributes."""
    out, child = [], False
    for token in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector.replace(">", " > ")):
        found = _STEP.fullmatch(token)
        if not found:
            raise ValueError(f"unknown selector: {selector!r}")
        if found[1]:
            child = True
        else:
            out.append((child, found[2] or "*", found[3] or ""))
            child = False
    return out


def _fits(dom: str, steps: list, level: int = 0) -> str:
    """SQL for whether the node ``x0`` (``x1`` and so on for those around it) fits the last of the steps within ``dom``."""
    x, y = f"x{level}", f"x{level + 1}"
    child, tag, conditions = steps[-1]
    ok = [f"{x}.tag = {_quoted(tag)}" if tag != "*" else f"NOT startswith({x}.tag, '#')"]
    ok += [_has(x, *c) for c in _SIMPLE.findall(conditions)]
    if len(steps) > 1:
        right = [f"{y}.depth = {x}.depth - 1"] if child else []
        ok.append(f"exists({dom}, {y} -> {' AND '.join([f'{y}.at < {x}.at', f'{x}.at <= {y}.last', *right, _fits(dom, steps[:-1], level + 1)])})")
    return " AND ".join(ok)


def _selected(dom: str, selector: str) -> str:
    """SQL for the nodes of ``dom`` that the selector (one or several, comma-joined) selects."""
    ways = [_fits(dom, _steps(one.strip())) for one in selector.split(",")]
    return f"filter({dom}, x0 -> {' OR '.join(f'({w})' for w in ways)})"


def _of(text: str, **values: Column) -> Column:
    """A SQL expression over values, which it names ``s.`` and their name."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.call_function("transform", one, F.expr(f"s -> {text}")), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def select(dom: Column, selector: str) -> Column:
    """All nodes that the selector selects, in document order."""
    return _of(_selected("s.d", selector), d=dom)


def matches(dom: Column, node: Column, selector: str) -> Column:
    """Whether a node is one that the selector selects within ``dom``; null for a null node."""
    return _of(f"exists({_selected('s.d', selector)}, y -> y.at = s.x.at)", d=dom, x=node)


def first(dom: Column, selector: str) -> Column:
    """The first selected node; null if there is none."""
    return _of(f"get({_selected('s.d', selector)}, 0)", d=dom)


def _below(dom: str, node: str) -> str:
    return f"slice({dom}, {node}.at - get({dom}, 0).at + 2, {node}.last - {node}.at)"


def below(dom: Column, node: Column) -> Column:
    """The nodes in ``node``, itself not included; ``dom`` may be such a subtree itself."""
    return _of(_below("s.d", "s.x"), d=dom, x=node)


def _raw(dom: str, node: str, tag: str = "#text") -> str:
    return f"array_join(transform(filter({_below(dom, node)}, t -> t.tag = {_quoted(tag)}), t -> t.text), '')"


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, {_quoted('(?U)' + chr(92) + 's+')}, ' '))"


def raw_text(dom: Column, node: Column, tag: str = "#text") -> Column:
    """Text in a node as it stands; that of scripts and styles has the tag ``#code``."""
    return _of(_raw("s.d", "s.x", tag), d=dom, x=node)


def text_of(dom: Column, node: Column) -> Column:
    """Text in a node with blanks collapsed; null for a null node."""
    return _of(_collapsed(_raw("s.d", "s.x")), d=dom, x=node)


def some_text(dom: Column, selectors: list[str], ok: str = "t <> ''") -> Column:
    """The text of the first selector whose first node has any, collapsed, or one that is ``ok``; null if none has. Later ones are not looked for."""
    texts = [f"transform(array(get({_selected('s.d', s)}, 0)), n -> {_collapsed(_raw('s.d', 'n'))})" for s in selectors]
    return _of(f"coalesce({', '.join(f'get(filter({t}, t -> {ok}), 0)' for t in texts)})", d=dom)


def first_filled(lists: list[Column]) -> Column:
    """The first of the arrays that is not empty; an empty one if all are."""
    return F.flatten(F.slice(F.filter(F.array(*lists), lambda x: F.size(x) > 0), 1, 1))


def first_yielding(dom: Column, selectors: list[str], make: Callable[[Column], Column], ok: Callable[[Column], Column], least: int = 1) -> Column:
    """What ``make`` gives for the nodes of the first selector that has ``least`` of them and a result that is ``ok``; those results."""
    ranked = [f"transform(flatten(filter(array({_selected('s.d', x)}), n -> size(n) >= {least})), n -> named_struct('rank', {rank}, 'node', n))" for rank, x in enumerate(selectors)]
    made = F.transform(_of(f"concat({', '.join(ranked)})", d=dom), lambda x: F.struct(x["rank"].alias("rank"), make(x["node"]).alias("value")))
    kept = let(F.filter(made, lambda x: ok(x["value"])), lambda all_: F.filter(all_, lambda x: x["rank"] == F.array_min(F.transform(all_, lambda y: y["rank"]))))
    return F.transform(kept, lambda x: x["value"])

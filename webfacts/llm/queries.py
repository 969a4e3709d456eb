"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _op2_sql() -> str:
    """The same scan in SQL, on the words of grams themselves."""
    from .license_scan import PHRASES, TEMPLATES

    words = lambda x: f"list_filter(regexp_split_to_array(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    given = ", ".join("('{}', '{}')".format(n, x.replace("'", "''")) for n, x in TEMPLATES.items())
    stands = lambda p: " AND ".join(f"w[i + {d + 1}] = '{x}'" for d, x in enumerate(p.split(" ")))
    places = ", ".join(f"list_filter(range(0, len(w)), lambda i: {stands(p)}) AS p{n}" for n, p in enumerate(PHRASES))
    both = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    labels = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{x}' END" for n, x in enumerate(PHRASES.values()))
    own = f"list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL)))"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT r, doc_id, len(w) AS n_words, {places} FROM d),
t AS (SELECT name, {words("x")} AS w FROM (VALUES {given}) AS v(name, x)),
tg AS (SELECT name, len(w) AS n, j, w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] AS gram FROM (SELECT name, w, unnest(range(0, len(w) - 2)) AS j FROM t)),
dg AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
v AS (SELECT r, name, n, i - j AS diagonal, min(i) AS a, max(i) AS z, list(j) AS under FROM dg JOIN tg USING (gram) GROUP BY ALL),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, name ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY r, name ORDER BY diagonal) AS run FROM f),
s AS (SELECT r, name, min(a) AS a, max(z) + 3 AS z, len(list_distinct(flatten(list(flatten(list_transform(under, lambda j: [j, j + 1, j + 2])))))) AS m, n FROM g GROUP BY r, name, n, run),
k AS (SELECT r, name, a, z, m, m::DOUBLE / n AS c FROM s WHERE m::DOUBLE / n >= 0.7),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY m DESC, c DESC, name, a, z) AS n FROM k),
q(r, n, kept) AS (SELECT DISTINCT r, 0::BIGINT, []::STRUCT(name VARCHAR, a BIGINT, z BIGINT, c DOUBLE)[] FROM o UNION ALL SELECT q.r, q.n + 1,
  CASE WHEN len(list_filter(q.kept, lambda y: y.name <> o.name AND y.a < o.z AND o.a < y.z)) > 0 THEN q.kept ELSE list_append(q.kept, {{'name': o.name, 'a': o.a::BIGINT, 'z': o.z::BIGINT, 'c': o.c}}) END
  FROM q JOIN o ON o.r = q.r AND o.n = q.n + 1),
e AS (SELECT r, list_max(list_transform(kept, lambda y: y.c)) AS best, list_distinct(list_transform(kept, lambda y: y.name)) AS more FROM q JOIN (SELECT r, max(n) AS n FROM o GROUP BY r) USING (r, n))
SELECT doc_id, n_words, len({both}) AS n_base, list_min({both}) AS first_word, list_max({both}) AS last_word, array_to_string({own}, ',') AS base_labels,
array_to_string(list_sort(list_distinct({own} || coalesce(more, []))), ',') AS labels, CASE WHEN len({both}) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN e USING (r)"""


ORACLE["op2_license_scan"] = _op2_sql()


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents by a chosen-path join."""
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of documents by diagonal voting."""
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents")).drop("spans")


@query
def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with host verdicts, a document's source being its host."""
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents")).drop("host")


@query
def op7_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of near equal bytes, equal texts together."""
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents by Kneser-Ney character models."""
    from .language_id import identify

    out = identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.selectExpr("doc_id", "held_out", "lang_pred", "lang_score AS score", "bits", "rejected")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents by supervised subword embeddings."""
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")).drop("text")


@query
def op5_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


#: Share of the corpus's tokens, epochs that a leaf may give, seed.
MIXED, EPOCHS, SEED = 0.5, 2, 7


def _op9_sql() -> str:
    """The same budgets and prefixes in SQL."""
    from .mixing import TARGETS

    def level(n: int, name: str, parent: list[str], above: str) -> str:
        keys = ", ".join([*parent, name])
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        before = f"OVER ({by} ORDER BY supply / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        weights = " ".join(f"WHEN '{x}' THEN {w}" for l, x, w in TARGETS if l == name)
        on = " AND ".join(f"s.{p} = a.{p}" for p in parent) or "true"
        return f"""
s{n} AS (SELECT {keys}, sum(supply) AS supply, CASE {name} {weights} ELSE 1.0 END::DOUBLE AS weight FROM tree GROUP BY {keys}),
n{n} AS (SELECT s.*, a.above FROM s{n} s JOIN {above} a ON {on}),
r{n} AS (SELECT *, (above - coalesce(sum(supply) {before}, 0.0)) / (sum(weight) OVER ({by}) - coalesce(sum(weight) {before}, 0.0)) AS rate FROM n{n}),
f{n} AS (SELECT *, rate * weight >= supply AS whole FROM r{n}),
l{n} AS (SELECT *, max(CASE WHEN NOT whole THEN {{'a': -(supply / weight), 'rate': rate}} END) OVER ({by}) AS top FROM f{n}),
b{n} AS (SELECT {keys}, CASE WHEN whole THEN supply ELSE least(supply, top.rate * weight) END AS above FROM l{n})"""

    number = "regexp_extract(source, '(\\d+)$', 1)"
    order = lambda x: f"substr(md5('{SEED}|' || {x} || '|' || key), 1, 15)"
    return f"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN {number} <> '' THEN 'd' || (CAST({number} AS BIGINT) % 4) ELSE source END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens, md5(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS key FROM documents),
e AS (SELECT *, coalesce(lang, '~') AS language, coalesce(source, '~') AS source_name, coalesce(domain, '~') AS node FROM d),
leaves AS (SELECT node, language, source_name, sum(n_tokens)::DOUBLE AS own FROM e GROUP BY ALL),
tree AS (SELECT node AS domain, language, source_name, own * {EPOCHS} AS supply FROM leaves),
a0 AS (SELECT least((SELECT sum(own) FROM leaves) * {MIXED}::DOUBLE, sum(supply)) AS above FROM tree),
{level(0, "domain", [], "a0")}, {level(1, "language", ["domain"], "b0")}, {level(2, "source_name", ["domain", "language"], "b1")},
p AS (SELECT l.*, b.above AS budget, floor(b.above / own)::INT AS whole, b.above - floor(b.above / own) * own AS rest FROM leaves l JOIN b2 b ON l.node = b.domain AND l.language = b.language AND l.source_name = b.source_name),
o AS (SELECT e.*, budget, whole, rest, {order("whole")} AS place FROM e JOIN p USING (node, language, source_name)),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY node, language, source_name ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o),
c AS (SELECT node, language, source_name, min(place) FILTER (upto >= rest) AS cut FROM u GROUP BY ALL)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, whole + CASE WHEN rest > 0 AND place <= coalesce(cut, 'g') THEN 1 ELSE 0 END)) AS INT) AS epoch, budget AS leaf_budget
FROM o JOIN c USING (node, language, source_name)"""


ORACLE["op9_mixing"] = _op9_sql()


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus's tokens to target weights over a tree of domains, languages and sources, of leaves that give two epochs at most."""
    from .mixing import mix, targets

    out = mix(_table(spark, sf_dir, "documents"), share=MIXED, epochs=EPOCHS, seed=SEED, weights=targets(spark))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "leaf_budget")


@query
def op3_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of documents by context-tree weighting."""
    from .lm_scoring import score

    return score(_table(spark, sf_dir, "documents"))


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors by iterative quantisation."""
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op11_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 1024 tokens by concatenation."""
    from .concat_cut import pack

    return pack(_table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned by the bytes that they cover."""
    from .token_alignment import align

    return align(_table(spark, sf_dir, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, damaged, and repaired by the cheapest edits."""
    from .conversation_repair import repair

    return repair(_table(spark, sf_dir, "conversations"), damage=True)

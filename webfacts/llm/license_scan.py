"""License scans by diagonal voting, in DataFrame operations only.

A text's rolling word k-grams that occur in license templates are joined to
their positions there. A hit at word i of a text and word j of a template votes
for the diagonal i - j; an insertion or deletion moves a passage to a
neighbouring diagonal, so diagonals that lie close together are merged. A merged
run is a span if the hits, compared word by word and not by hash alone, cover
enough of the template's words, and if no span of another template that stays
lies over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

# Phrases that must be found wherever their words stand in a row, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public license notices, in their usual wording.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-work": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain",
}

#: Templates of up to so many characters in all are broadcast, and their grams tested for in each row; more are joined by shuffle.
BROADCAST_CHARS = 1_000_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased; none for null."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # only the first and last piece can be empty
    return F.filter(F.split(folded, _BREAKS), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """(at, gram, own) of every run of k words: its place, its hash and its words; none for fewer words."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), _hash(words, i, k).alias("gram"), F.slice(words, i + 1, k).alias("own")))


def _hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.element_at(words, i + (d + 1)) for d in range(k)])


def _wanted_grams(words: Column, k: int, wanted: list[int]) -> Column:
    """``_grams``, but only those whose hash is among ``wanted``; the others are never made."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda i: _hash(words, i, k).isin(wanted)), lambda i: F.struct(i.alias("at"), _hash(words, i, k).alias("gram"), F.slice(words, i + 1, k).alias("own")))


def templates(spark: SparkSession, texts: dict[str, str] | None = None, k: int = 3) -> DataFrame:
    """(gram, gram_words, template, template_at, template_words) of every k-gram; a template of fewer than k words has none."""
    rows = [F.struct(F.lit(name).alias("template"), F.lit(text).alias("text")) for name, text in (TEMPLATES if texts is None else texts).items()]
    df = spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<template:string,text:string>>"))).withColumn("words", words_of(F.col("text")))
    df = df.select("template", F.size("words").alias("template_words"), F.explode(_grams(F.col("words"), k)).alias("g"))
    return df.select("g.gram", F.col("g.own").alias("gram_words"), "template", F.col("g.at").alias("template_at"), "template_words")


def _hits_of(words: Column, wanted: DataFrame | None, k: int) -> Column:
    if wanted is None:
        return _grams(words, k)
    return _wanted_grams(words, k, [r[0] for r in wanted.select("gram").distinct().collect()])  # a few per template word


def spans(rows: DataFrame, wanted: DataFrame, *, k: int = 3, slack: int = 3, coverage: float = 0.7) -> DataFrame:
    """License passages of (row, hits): row, template, start_word, end_word, matched, coverage; ``wanted`` are ``templates``.

    Hits of one template on diagonals at most ``slack`` apart make a run; it counts if the different
    template words under its hits are at least ``coverage`` of the template's. Runs are settled best
    first, by matched words, then coverage, then the first name and place: one stays unless it shares
    words of the text with one of another template that stays.
    """
    hits = rows.select("row", F.explode("hits").alias("g")).select("row", "g.at", "g.gram", "g.own")
    # the words themselves confirm a hit, so that no two grams that share a hash are taken for one
    hits = hits.join(wanted, "gram").where("own = gram_words")
    hits = hits.select("row", "template", "template_words", "at", "template_at", (F.col("at") - F.col("template_at")).alias("diagonal"))
    votes = hits.groupBy("row", "template", "template_words", "diagonal").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.collect_set("template_at").alias("under"))
    # neighbouring diagonals: a new run begins where the last one lies too far off
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(near)) > slack
    runs = votes.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(near))
    runs = runs.groupBy("row", "template", "template_words", "run").agg(
        F.min("first_at").alias("start_word"), (F.max("last_at") + k).alias("end_word"), F.array_distinct(F.flatten(F.collect_list("under"))).alias("under"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("under", lambda j: F.sequence(j, j + (k - 1))))))
    runs = runs.withColumn("matched", covered.cast("long")).withColumn("coverage", F.col("matched") / F.col("template_words"))
    runs = runs.where(F.col("coverage") >= coverage).select("row", "template", "start_word", "end_word", "matched", "coverage")
    # runs that hang together over shared words are held against each other
    before = Window.partitionBy("row").orderBy("start_word", "end_word", "template").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start_word") >= F.max("end_word").over(before), F.lit(True))
    chains = runs.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chains.groupBy("row", "chain").agg(F.collect_list(F.struct("template", "start_word", "end_word", "matched", "coverage")).alias("s"))

    # best first; what stays drops rivals that share words with it, and what is dropped drops none
    ranked = F.array_sort(F.transform("s", lambda x: F.struct((-x["matched"]).alias("m"), (-x["coverage"]).alias("c"), x["template"].alias("t"), x["start_word"].alias("a"), x["end_word"].alias("z"), x.alias("x"))))
    none = F.filter("s", lambda x: F.lit(False))
    rival = lambda kept, x: F.exists(kept, lambda y: (y["template"] != x["template"]) & (y["start_word"] < x["end_word"]) & (x["start_word"] < y["end_word"]))
    kept = F.aggregate(ranked, none, lambda kept, r: F.when(rival(kept, r["x"]), kept).otherwise(F.concat(kept, F.array(r["x"]))))
    return chains.select("row", F.explode(kept).alias("x")).select("row", "x.*")


def _stands(words: Column, parts: list[str]):
    def at(i: Column) -> Column:
        ok = F.lit(True)
        for d, part in enumerate(parts):
            ok = ok & (F.element_at(words, i + (d + 1)) == part)
        return ok

    return at


def phrase_places(words: Column) -> dict[str, Column]:
    """For each phrase, the word numbers where its words stand consecutively."""
    joined, found = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), {}
    for phrase in PHRASES:
        parts = phrase.split(" ")
        match = _stands(words, parts)
        places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), match)
        # most texts lack the phrase; the cheap test spares them the walk
        found[phrase] = F.when(joined.contains(f" {phrase} "), places).otherwise(F.array().cast("array<int>"))
    return found


def scan(docs: DataFrame, texts: dict[str, str] | None = None, *, k: int = 3, **options) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is 1 where a phrase stands, else the best span's coverage of its
    template, else 0. A null text is an empty one. Each row is judged by its own
    text, also where rows share a doc_id or have none; further columns are
    ignored. An empty table gives an empty result. A text is split once and may
    be of any length; what is kept of it are its hits.
    """
    texts = TEMPLATES if texts is None else texts
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        few = sum(map(len, texts.values())) <= BROADCAST_CHARS
        wanted = templates(spark, texts, k)  # as many rows as the templates have words
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        words = F.col("words")
        places = [v.alias(f"p{i}") for i, v in enumerate(phrase_places(words).values())]
        base = docs.select("doc_id", words_of(F.col("text")).alias("words"))
        base = base.select("doc_id", F.size("words").cast("long").alias("n_words"), F.struct(*places).alias("places"), _hits_of(words, wanted if few else None, k).alias("hits"))
        places = F.flatten(F.array(*[F.col(f"places.p{i}") for i in range(len(PHRASES))]))
        labels = F.filter(F.array(*[F.when(F.size(f"places.p{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
        base = base.select(
            "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("own"), "hits")
        base = scratch.cut(base.withColumn("row", F.monotonically_increasing_id()))
        found = spans(base.where(F.size("hits") > 0).select("row", "hits"), F.broadcast(wanted) if few else wanted, k=k, **options).groupBy("row").agg(
            F.max("coverage").alias("best"), F.array_sort(F.collect_set("template")).alias("more"),
            F.array_sort(F.collect_list(F.struct("start_word", "end_word", "template", "matched"))).alias("spans"))
        out = base.drop("hits").join(found, "row", "left")
        more = F.coalesce("more", F.array().cast("array<string>"))
        return scratch.keep(out.select(
            "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("own", more)), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"), "spans"))

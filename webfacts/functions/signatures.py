"""Signatures of technologies as a relation, found in texts by one pass of an automaton over each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals, and characters of them all together, that an automaton is broadcast for.
SIGNALS, CHARACTERS = 200_000, 10_000_000


def searched(html: Column, headers: Column | None = None) -> Column:
    """The text that signals are sought in: the page's, and the values of its headers (a map), in lower case; null for neither."""
    texts = [html]
    if headers is not None:
        texts.append(F.array_join(F.map_values(headers), "\n"))
    return F.lower(F.when(F.coalesce(*texts).isNotNull(), F.concat_ws("\n", *texts)))


def matched(pages: DataFrame, key: str, text: Column, signatures: DataFrame) -> DataFrame:
    """(key, name, category, signal): every signal of signatures (name, category, signal) that a page's text holds, once.

    Signals are lower case; null and empty ones match nothing. Signals of a checked
    number and size become an Aho-Corasick automaton, which goes with each task and
    reads a text once, however many signals there are. A larger relation is joined
    as it is. Rows of one key count as one page; pages without a text match nothing.
    """
    spark = pages.sparkSession
    signals = signatures.where("signal <> ''").select("name", "category", "signal").distinct()
    rows = pages.select(F.col(key).alias("_key"), text.alias("_text")).where("_text is not null")
    n, size = signals.agg(F.count("*"), F.coalesce(F.sum(F.length("signal")), F.lit(0))).first()
    if n > SIGNALS or size > CHARACTERS:
        found = rows.join(signals, F.contains("_text", "signal")).select("_key", "signal").distinct()
    else:
        known = spark.sparkContext.broadcast(sorted({r.signal for r in signals.select("signal").collect()}))
        kind = rows.schema["_key"].dataType.simpleString()

        def run(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for signal in known.value:
                automaton.add_word(signal, signal)
            automaton.make_automaton()
            for batch in batches:
                keys, hits = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    own = sorted({signal for _, signal in automaton.iter(text)}) if known.value else []
                    keys += [i] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(hits, pa.string())], ["_key", "signal"])

        found = rows.mapInArrow(run, f"_key {kind}, signal string").distinct()
    return found.join(signals, "signal").select(F.col("_key").alias(key), "name", "category", "signal")

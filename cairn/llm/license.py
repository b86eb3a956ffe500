"""Licence scan: exact set-similarity join of text blocks with templates, in DataFrame operations only.

A block is a run of as many words as a template has; it matches if it holds at least the threshold's share of the
template's distinct words. Documents are reduced to the places of template words, once. Tokens are ordered by how many
documents hold them, rarest first; a document meets a template only through the first |T| - need + 1 of the template's
tokens (prefix filter), if enough tokens from there on are left on both sides (length and positional filter). In what
remains, each place of a token counts for the blocks that it is the first of its kind in, so that running sums over the
sorted ends of these intervals give every block's overlap at a cost linear in the text. Templates are rows of tables:
the plan does not grow with them. Documents themselves are never shuffled.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import common as C

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    #: Lower-case words, separated by spaces.
    text: str
    #: Least share of the template's distinct words that a block must hold.
    threshold: float = 0.8
    #: Whether all words must stand in the template's order instead.
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def tokens(self) -> set[str]:
        return set(self.words)

    @property
    def size(self) -> int:
        return len(self.words) if self.phrase else len(self.tokens)

    @property
    def need(self) -> int:
        return self.size if self.phrase else math.ceil(self.threshold * self.size - 1e-9)


#: Phrases that count wherever their words stand consecutively.
BASE = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
#: Lines and notices of common public licences.
NOTICES = (
    Template("mit", "released under the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template("apache", "licensed under the apache license version 2 0"),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version",
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        0.9,
    ),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", 0.9),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.9),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: str = "text") -> Column:
    """Lower-case runs of letters, digits and non-ASCII characters; null text: none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def token_order(spots: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of rows of spots(held: distinct tokens) that hold them, rarest first."""
    counts = {r["w"]: r["n"] for r in spots.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of given rows, held in the plan as one literal."""
    names = [part.split()[0] for part in schema.split(", ")]
    values = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(values), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def template_tables(spark, templates: tuple[Template, ...], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """prefixes(w, t, earlier, rest, ...): each template by its prefix tokens, with the prefix tokens before and the tokens
    after; tokens(t, w, at): its tokens and, of phrases, their places."""
    rank = {w: i for i, w in enumerate(order)}
    prefixes, tokens = [], []
    for t, x in enumerate(templates):
        ranked = sorted(x.tokens, key=rank.__getitem__)
        least = len(ranked) if x.phrase else x.need
        for j, w in enumerate(ranked[: len(ranked) - least + 1]):
            prefixes.append((w, t, x.label, len(x.words), x.need, x.size, least, x.phrase, ranked[:j], ranked[j + 1 :]))
        tokens += [(t, w, [i for i, v in enumerate(x.words) if v == w] if x.phrase else []) for w in ranked]
    schema = "w string, t int, label string, m int, need int, size int, least int, phrase boolean, earlier array<string>, rest array<string>"
    return literal_table(spark, prefixes, schema), literal_table(spark, tokens, "t int, w string, at array<int>")


def blocks(spots: DataFrame, prefixes: DataFrame, tokens: DataFrame) -> DataFrame:
    """spots(rid, n_words, held, spots) -> (rid, t, label, phrase, first, last, share): runs of starts of qualifying blocks."""
    met = spots.select("rid", "n_words", "held", "spots", F.explode("held").alias("w")).join(F.broadcast(prefixes), "w")
    met = met.where((F.size(F.array_intersect("held", "earlier")) == 0) & (F.size(F.array_intersect("held", "rest")) + 1 >= F.col("least")))
    place = met.select("rid", "n_words", "t", "m", "need", "phrase", F.explode("spots").alias("x")).select("*", "x.p", "x.w").drop("x")
    place = place.join(F.broadcast(tokens), ["t", "w"]).repartition("rid", "t")
    place = place.withColumn("before", F.lag("p").over(Window.partitionBy("rid", "t", "w").orderBy("p")))
    last_start = F.greatest(F.col("n_words") - F.col("m"), F.lit(0))
    lo, hi = F.greatest(F.col("before") + 1, F.col("p") - F.col("m") + 1, F.lit(0)), F.least(F.col("p"), last_start)
    ordered = F.transform("at", lambda i: F.struct((F.col("p") - i).alias("lo"), (F.col("p") - i).alias("hi")))
    spans = place.select("rid", "t", "need", F.explode(F.when(F.col("phrase"), ordered).otherwise(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))).alias("x"))
    spans = spans.where("x.lo <= x.hi AND x.lo >= 0")
    ends = spans.select("rid", "t", "need", F.explode(F.array(F.struct(F.col("x.lo").alias("s"), F.lit(1).alias("d")), F.struct((F.col("x.hi") + 1).alias("s"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy("rid", "t", "need", F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy("rid", "t").orderBy("s")
    found = ends.withColumns({"n": F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("s").over(along) - 1}).where("n >= need")
    about = prefixes.select("t", "label", "phrase", "size").distinct()
    return found.join(F.broadcast(about), "t").select("rid", "t", "label", "phrase", F.col("s").alias("first"), "last", (F.col("n") / F.col("size").cast("double")).alias("share"))


def license_scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks).

    n_base counts all places where a base phrase stands, first_word and last_word are the smallest and largest of their
    starts (null if none). labels joins the labels of base phrases and of notices that a block of the document contains
    to their threshold; both label columns are distinct, sorted and comma-joined, empty if none. score is the largest
    containment that reached its threshold, else 0. blocks lists (label, first, last, share) of all runs of qualifying
    blocks: those that start at the words from first to last hold the same share; null if none.

    Null text is an empty one: no words, nothing found. One row for each input row, repeated or with null ids alike; a
    document with fewer words than a notice is one block. Texts of any length are read whole, at a cost linear in their
    words. Other columns are ignored. Empty tables give no rows. base: phrases; notices: templates of any kind.
    """
    spark = docs.sparkSession
    templates = (*base, *notices)
    vocabulary = sorted(set().union(*(t.tokens for t in templates)))
    worded = docs.select("doc_id", words_of().alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    rows = worded.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").alias("n_words"), spots.alias("spots"))
    rows = C.stash(rows.withColumn("held", F.array_distinct(F.transform("spots", lambda x: x["w"]))))
    prefixes, tokens = template_tables(spark, templates, token_order(rows, vocabulary))
    found = blocks(rows, prefixes, tokens).withColumn("base", F.col("t") < len(base))
    starts = F.when(F.col("base"), F.col("last") - F.col("first") + 1)
    found = found.groupBy("rid").agg(
        F.sum(starts).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("score"),
        F.collect_list(F.struct("label", "first", "last", "share")).alias("blocks"),
    )

    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit("")).alias(name)

    return rows.select("rid", "doc_id", "n_words").join(found, "rid", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined("base_labels"),
        joined("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "blocks",
    )

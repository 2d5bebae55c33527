"""License scans as an exact set-similarity join (built-in functions only).

Every template is a set of words, and a document is read as overlapping text blocks: for templates of up to ``L`` words
(``L`` a power of two) the blocks are the ``2 L`` words that begin at every multiple of ``L``, so any ``L`` consecutive words lie
in one block.  A document has a template's label if some block holds at least ``PERCENT`` hundredths of the template's
words, in any order and whatever stands between them.

The words of all templates are put in one global order, those in the fewest documents first (counted over the whole
table).  With ``need`` the words a block must share with a template:

* prefix filter: sets that share ``need`` words share one among the first ``size - need + 1`` of each, in the global order;
  only blocks around such a word are ever made, and they meet only templates that have it in their prefix;
* length filter: a block must have ``need`` words of templates at all;
* positional filter: behind a match at place ``i`` of the template and ``j`` of the block there must be room for the rest.

What passes is counted exactly.  No filter can lose a block that meets the threshold.  Templates are a parameter (some
texts), so their index goes to every task; documents are read twice, once to count and once to scan, and only the words of blocks
that pass the prefix filter leave their row.

Besides, *base places* are counted: where a phrase's words stand consecutively.  ``score`` is 1 with a base place, or else the
largest share of a template's words found in a block that meets the threshold, or else 0.

Defined results: a null or empty text has no words, no places (first and last null) and no labels; texts of any length are read
whole; repeated rows are judged one by one; an empty table gives no rows; a document's columns travel as one struct, so their
names can't clash with ours; a template without words is never found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 80
#: fixed values: phrase and label
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: label and text, of the public licenses' own notices
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial License"),
    ("creative-commons", "licensed under a Creative Commons License"),
    ("gpl", "licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, GAP), "")


def python_words(text: str) -> list[str]:
    """The same words of a template, which is a parameter."""
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``: a one-element array and a lambda."""
    return F.transform(F.array(value), body)[0]


def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, from 0; the words are walked through only if all of them are there."""
    own = python_words(phrase)
    there = F.lit(True)
    for w in sorted(set(own), key=len):
        there = there & F.array_contains(words, w)

    def stands(i):
        same = F.get(words, i) == own[0]
        for k, w in enumerate(own[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return same

    starts = F.sequence(F.lit(0), F.size(words) - len(own))
    return F.when(there & (F.size(words) >= len(own)), F.filter(starts, stands)).otherwise(F.array().cast("array<int>"))


class Scanner:
    """The templates in the global order of the words' frequency in ``docs``."""

    def __init__(self, docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> None:
        self.docs, self.text = docs, text
        kept = [(label, own) for label, t in (TEMPLATES if templates is None else templates) if (own := python_words(t))]
        known = sorted({w for _, own in kept for w in own})
        # documents that have each word, over the whole table; at most one row for each word of the templates
        held = docs.select(F.explode(F.array_intersect(literal(known), words_of(F.col(text)))).alias("word"))
        count = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()} if known else {}
        self.order = sorted(known, key=lambda w: (count.get(w, 0), w))
        rank = {w: k for k, w in enumerate(self.order)}
        #: (template, label, size, need, reach, words in order)
        self.templates = []
        for n, (label, own) in enumerate(kept):
            words = sorted(set(own), key=rank.__getitem__)
            reach = 1 << max(1, (len(own) - 1).bit_length())
            self.templates.append((n, label, len(words), -(-percent * len(words) // 100), reach, words))

    def index(self) -> DataFrame:
        """A row for each word of each template's prefix: ``reach``, ``word``, its place and the template."""
        rows = [(reach, w, i, label, size, need, words) for _, label, size, need, reach, words in self.templates for i, w in enumerate(words[: size - need + 1])]
        return self.docs.sparkSession.createDataFrame(rows, "reach int, word string, i int, label string, size int, need int, template array<string>")

    def blocks(self, words: Column) -> Column:
        """``reach``, ``block`` and its words of templates in the global order, of the blocks with a word of some prefix and enough words."""
        none = F.array().cast("array<struct<reach:int,block:int,words:array<string>>>")
        return F.concat(none, *[F.when(F.arrays_overlap(words, prefix), self._around(words, prefix, reach, least)).otherwise(none) for reach, prefix, least in self._classes()])

    def _classes(self) -> list[tuple[int, Column, int]]:
        """For each length of blocks: the words of the templates' prefixes and the least number of words needed."""
        out = []
        for reach in sorted({t[4] for t in self.templates}):
            own = [t for t in self.templates if t[4] == reach]
            out.append((reach, literal(sorted({w for t in own for w in t[5][: t[2] - t[3] + 1]})), min(t[3] for t in own)))
        return out

    def _around(self, words: Column, prefix: Column, reach: int, least: int) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(prefix, F.get(words, i)))
        both = F.transform(at, lambda i: F.array((i / reach).cast("int"), F.greatest(F.lit(0), (i / reach).cast("int") - 1)))  # a word is in two blocks
        made = lambda b: F.struct(F.lit(reach).alias("reach"), b.alias("block"), F.array_intersect(literal(self.order), F.slice(words, b * reach + 1, F.lit(2 * reach))).alias("words"))
        return F.filter(F.transform(F.array_distinct(F.flatten(both)), made), lambda x: F.size(x["words"]) >= least)

    def join(self, blocks: DataFrame) -> DataFrame:
        """``id``, ``label``, ``share`` for every template that a block holds; a pair may come more than once."""
        each = blocks.select("id", "reach", "words", F.posexplode("words").alias("j", "word"))
        met = each.join(F.broadcast(self.index()), ["reach", "word"])
        held = F.size("words")
        prefix = F.col("j") <= held - F.col("need")
        room = 1 + F.least(F.col("size") - 1 - F.col("i"), held - 1 - F.col("j")) >= F.col("need")
        counted = met.filter((held >= F.col("need")) & prefix & room).withColumn("both", F.size(F.array_intersect("words", "template")))
        return counted.filter(F.col("both") >= F.col("need")).select("id", "label", (F.col("both") / F.col("size")).alias("share"))


def scan(docs: DataFrame, text: str = "text", phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns, or those in ``keep``) and ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    phrases = PHRASES if phrases is None else phrases
    scanner = Scanner(docs, text, templates, percent)
    sent = carry(docs, text, keep)
    value = F.col("text") if "text" in sent.columns else F.col("row").getField(text)
    read = sent.select("row", words_of(value).alias("words"))
    found = read.select("row", F.size("words").cast("long").alias("n_words"), F.array(*[places(F.col("words"), p) for p, _ in phrases]).alias("places"), scanner.blocks(F.col("words")).alias("blocks"))
    # written once, so that a document's number stays what it is
    numbered = materialize(found.withColumn("id", F.monotonically_increasing_id()), "scanned")
    hits = scanner.join(numbered.filter(F.size("blocks") > 0).select("id", F.explode("blocks").alias("b")).select("id", "b.reach", "b.words"))
    own = hits.groupBy("id").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))  # labels: as many as there are templates at most
    all_places = F.flatten("places")
    named = F.array_distinct(F.concat(F.array().cast("array<string>"), *[F.when(F.size(F.col("places")[k]) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(phrases)]))
    out = numbered.drop("blocks").join(own, "id", "left").withColumn("base", named)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "row",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

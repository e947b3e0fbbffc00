"""License scans by an exact set-similarity join with license templates.

A block of a text (a line, or a paragraph of several lines) matches a template when it
holds at least `threshold` of the template's distinct words, however many it has besides.
The join is exact and prunes by three filters over one global order of words,
rarest first, by the number of documents that hold them:

* prefix: of a template's n words with at least o in the block, one of the n - o + 1
  rarest must be there, so only those are looked up;
* length: a block has at least o distinct words;
* position: after a shared word at place i of the template and j of the block's template
  words, what both have before and what both have after bounds the words shared.

Everything is DataFrame work. One scan takes the agreed columns and each document's own
template words; a second one splits into blocks only the documents in which a prefix word
occurs as a substring.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapfold.session import table, written

#: Phrases and the labels they give.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices in use, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit-conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    (
        "mit-warranty",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties"
        " of merchantability, fitness for a particular purpose and noninfringement",
    ),
    (
        "apache-header",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is"
        " basis, without warranties or conditions of any kind, either express or implied",
    ),
    (
        "gpl-warranty",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of"
        " merchantability or fitness for a particular purpose",
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: all ASCII but digits and letters


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaced(text: Column) -> Column:
    """Each word between two spaces of its own: ' a  b ' ; empty without words."""
    return F.regexp_replace(F.btrim(F.regexp_replace(_lower(text), SEPARATORS, " ")), " ", "  ")


def _count_of(spaced: Column, word: str) -> Column:
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(word)))) / len(word)).cast("long")


def _n_words(spaced: Column) -> Column:
    """Words of ' a  b ', through its spaces."""
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" ")))) / 2).cast("long")


def _template_words(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return sorted(set(words))


def _base(docs: DataFrame) -> DataFrame:
    """The agreed columns, and the text in lower case with every word between spaces."""
    out = docs.withColumn("_words", _spaced(F.coalesce("text", F.lit(""))))
    out = out.withColumn("_spaced", F.when(F.col("_words") == "", "").otherwise(F.concat(F.lit(" "), "_words", F.lit(" "))))
    spaced = F.col("_spaced")
    marks = {label: " " + phrase.replace(" ", "  ") + " " for phrase, label in PHRASES}
    counts = {label: _count_of(spaced, mark) for label, mark in marks.items()}
    out = out.withColumns({"n_words": _n_words(spaced)} | {f"_n_{label}": c for label, c in counts.items()})
    found = {label: F.col(f"_n_{label}") > 0 for label in marks}
    before = [F.when(found[x], _n_words(F.substring_index(spaced, m, 1))) for x, m in marks.items()]
    after = [F.when(found[x], F.col("n_words") - _n_words(F.substring_index(spaced, m, -1)) - len(m.split())) for x, m in marks.items()]
    return out.select(
        "*",
        functools.reduce(operator.add, [F.col(f"_n_{x}") for x in marks]).alias("n_base"),
        F.least(*before).alias("first_word"),
        F.greatest(*after).alias("last_word"),
        F.array_compact(F.array(*[F.when(found[x], x) for x in marks])).alias("_base"),
    )


def license_scan(docs: DataFrame, threshold: float = 0.9, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score is the share of the best matching template that its block holds, 0 without one.
    A null or empty text has no words, labels or places; repeated rows give repeated
    results; a null doc_id is a document like any other; further columns are ignored.
    """
    spark = docs.sparkSession
    words = {label: _template_words(text) for label, text in templates}
    vocabulary = sorted(set().union(*words.values()))
    source = docs.select(F.col("doc_id").cast("long"), "text")
    own = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.split("_words", "  "))
    agreed = ("doc_id", "n_words", "n_base", "first_word", "last_word", "_base")
    told = written(_base(source).select(F.xxhash64("doc_id", "text").alias("_id"), *agreed, own.alias("_own")))

    # the global order, rarest first; a row for each template word at most comes to the driver
    counts = {r.w: r.n for r in told.select(F.explode("_own").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = {label: sorted(ws, key=rank.get) for label, ws in words.items()}
    needed = {label: -(-len(ws) * round(threshold * 1000) // 1000) for label, ws in ordered.items()}
    prefixes = [(label, w, i) for label, ws in ordered.items() for i, w in enumerate(ws[: len(ws) - needed[label] + 1])]

    looked_up = sorted({w for _, w, _ in prefixes if w in counts})
    # an array of one, so that the text is lower-cased once for all words
    met = F.exists(F.array(F.lower("text")), lambda low: functools.reduce(operator.or_, [low.contains(w) for w in looked_up], F.lit(False)))
    candidates = source.filter(met).withColumn("_id", F.xxhash64("doc_id", "text"))
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", r"\n[\x20\x09-\x0D]*\n"), lambda p: p.contains("\n"))
    blocks = candidates.select("_id", F.explode(F.array_distinct(F.concat(lines, paragraphs))).alias("block"))
    blocks = blocks.select("_id", F.array_distinct(F.split(_spaced(F.col("block")), "  ")).alias("tokens"))
    names = F.array(*[F.lit(w) for w in sorted(vocabulary, key=rank.get)])
    # a block's template words in the global order: an intersection keeps the order of its first side
    blocks = blocks.select("_id", F.size("tokens").alias("size"), F.array_intersect(names, "tokens").alias("own")).filter(F.size("own") > 0)
    parts = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(w).alias("w"), F.lit(i).alias("i")) for label, w, i in prefixes])
    sides = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.lit(w) for w in ws]).alias("side"), F.lit(needed[label]).alias("needed")) for label, ws in ordered.items()])
    prefix = spark.range(1).select(F.inline(parts))
    side = spark.range(1).select(F.inline(sides))
    pairs = (
        blocks.select("_id", "size", "own", F.posexplode("own").alias("j", "w"))
        .join(F.broadcast(prefix), "w")
        .join(F.broadcast(side), "label")
        .filter(F.col("size") >= F.col("needed"))
        .filter(F.least("i", "j") + F.least(F.size("side") - F.col("i"), F.size("own") - F.col("j")) >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("own", "side"))
    matched = pairs.filter(shared >= F.col("needed")).groupBy("_id").agg(F.collect_set("label").alias("found"), F.max(shared / F.size("side")).alias("score"))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("found", F.array().cast("array<string>")))))
    return told.join(matched, "_id", "left").select(
        *agreed[:-1],
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_prefix_filter_join(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))

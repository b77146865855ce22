"""License scans as an exact set-similarity join, on DataFrame functions alone.

Texts are cut into overlapping blocks of words, so every run of ``STRIDE`` words lies whole in one block. A template is
found in a block that contains at least ``THRESHOLD`` of its distinct words. Words are ordered by how often the whole
corpus uses them, rarest first; then a qualifying block must hold one of the first few words of a template (prefix
filter), be large enough (length filter), and have enough words left behind the place where the two meet (positional
filter). Only blocks that pass are compared in full, so no match is lost and hardly any block is compared.

Phrases whose words stand consecutively are found beside them, word by word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import local_table

# Phrases and the label each gives wherever its words stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# One notice a template, and its label.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
#: A block starts at every ``STRIDE``-th word and has twice as many; a template of more words has longer blocks.
STRIDE = 32
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
KELVIN, DOTTED_I = "K", "İ"


def words_of(text: Column) -> Column:
    """Words of a whole text with A-Z in lower case.

    Two letters beyond ASCII would become ASCII in lower case; they are replaced by another non-ASCII letter, so
    words begin and end where they did and never turn into a phrase's word.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    for letter in (KELVIN, DOTTED_I):
        text = F.replace(text, F.lit(letter), F.lit("ĸ"))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"), words_of(text).alias("words"))


def phrase_places(words: Column, phrases: tuple = PHRASES) -> Column:
    """Sorted places (word number, label) where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases:
        parts = phrase.split()

        def stands_at(i: Column) -> Column:
            return reduce(lambda a, b: a & b, (F.get(words, i + k) == part for k, part in enumerate(parts)))

        first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
        places = F.transform(F.filter(first, stands_at), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        found.append(F.when(F.array_contains(words, parts[-1]), places))
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.array_sort(F.concat(*(F.coalesce(f, none) for f in found)))


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by how often all texts use each word, rarest first, ties by spelling."""
    used = docs.select(F.explode(words_of(F.col("text"))).alias("word")).filter(F.col("word").isin(vocabulary))
    counts = {r.word: r["count"] for r in used.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def needed(n: int, threshold: float) -> int:
    """Words of a template of n that a block must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def template_matches(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, version, block, label, containment``: every block and template that meet the threshold.

    Blocks are numbered from 0 in each text; ``version`` is the text's hash. Templates of more than ``STRIDE`` words
    are looked for in blocks of their own, whose stride is the next of ``STRIDE``, 2 ``STRIDE``, 4 ``STRIDE``, ... that
    has room for the whole template; these are numbered apart.
    """
    by_stride: dict[int, list] = {}
    for text, label in templates:
        stride = STRIDE
        while stride < len(text.split()):
            stride *= 2
        by_stride.setdefault(stride, []).append((text, label))
    found = [_matches(docs, tuple(group), threshold, stride) for stride, group in sorted(by_stride.items())]
    return reduce(DataFrame.unionByName, found)


def _matches(docs: DataFrame, templates: tuple, threshold: float, stride: int) -> DataFrame:
    sets = [(i, label, frozenset(text.split())) for i, (text, label) in enumerate(templates)]
    vocabulary = sorted(set().union(*(s for _, _, s in sets)))
    order = token_order(docs, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    prefixes, facts = [], []
    for i, label, members in sets:
        ranked = sorted(rank[w] for w in members)
        least = needed(len(ranked), threshold)
        facts.append((i, label, len(ranked), least, ranked))
        prefixes += [(r, i, len(ranked) - at, least) for at, r in enumerate(ranked[: len(ranked) - least + 1])]
    spark = docs.sparkSession
    opening = sorted({order[r] for r, *_ in prefixes})
    rows = _rows(docs).filter(F.arrays_overlap("words", F.array(*map(F.lit, opening))))
    # Words outside the templates can't be shared, so a block is the set of ranks of its template words.
    place = F.transform("words", lambda w, i: F.struct(i.alias("at"), F.array_position(F.array(*map(F.lit, order)), w).alias("rank")))
    hits = rows.select("id", "version", F.filter(place, lambda p: p["rank"] > 0).alias("hits"))
    spread = hits.select("id", "version", F.explode("hits").alias("h")).select(
        "id", "version", (F.col("h.rank") - 1).alias("rank"), F.floor(F.col("h.at") / stride).alias("tile")
    )
    in_blocks = spread.select("id", "version", "rank", F.explode(F.filter(F.array("tile", F.col("tile") - 1), lambda b: b >= 0)).alias("block"))
    blocks = in_blocks.groupBy("id", "version", "block").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    prefix = local_table(spark, "first long, template int, behind int, least int", prefixes)
    members = local_table(spark, "t int, label string, size int, least_words int, members array<bigint>", facts)
    # Length filter before the join, positional filter at the place where prefixes meet.
    smallest = min(f[3] for f in facts)
    tokens = blocks.filter(F.size("ranks") >= smallest).select("id", "version", "block", "ranks", F.posexplode("ranks").alias("nth", "token"))
    met = tokens.join(prefix, F.col("token") == F.col("first")).filter(
        (F.size("ranks") >= F.col("least")) & (F.least(F.col("behind"), F.size("ranks") - F.col("nth")) + F.col("nth") >= F.col("least"))
    )
    candidates = met.groupBy("id", "version", "block", "template").agg(F.first("ranks").alias("ranks"))
    shared = F.size(F.array_intersect("ranks", "members"))
    return (
        candidates.join(members, F.col("template") == F.col("t"))
        .select("id", "version", "block", "label", (shared / F.col("size")).alias("containment"), shared.alias("shared"), "least_words")
        .filter(F.col("shared") >= F.col("least_words"))
        .drop("shared", "least_words")
    )


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts places of phrases, ``first_word`` and ``last_word`` are the smallest and largest start (null
    without any). ``labels`` joins the phrases' labels and the templates', distinct, sorted, with commas. ``score``
    is 1 where a phrase stands, else the best containment found, else 0. Null text counts as empty.
    """
    rows = _rows(docs).select("id", "version", F.size("words").cast("long").alias("n_words"), phrase_places(F.col("words")).alias("places"))
    met = template_matches(docs, templates, threshold).groupBy(F.col("id").alias("i"), F.col("version").alias("v")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")
    )
    joined = rows.join(met, F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left")
    at = F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

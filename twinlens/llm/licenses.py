"""License scans: places of fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block (a line, or a paragraph between blank lines) meets a template when it contains at least ``threshold`` of the
template's distinct tokens. Tokens are ordered by how many texts of the corpus hold them, rarest first. A block can only
reach the threshold if it shares a token of the template's prefix in that order; length and position filters drop
most of the rest, and the overlap of what is left is counted. Templates are a fixed table, so every task gets them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import durable

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # what stands between words once A-Z are lower-case
BLANK_LINE = "\\n[ \\t\\r]*\\n"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening words of public licenses and notices, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the terms of the mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "spdx license identifier apache 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "spdx license identifier gpl 3 0 or later"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced or transmitted in any form without permission"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Two other letters have ASCII lower-case forms; texts with them take the slower way."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


def token_order(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template tokens, rarest first by the number of texts that hold them; ties by the alphabet.

    The count covers all texts; one row per token of the templates reaches the driver.
    """
    held = texts.select(F.explode(F.array_intersect(words_of(F.col("_low")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    counted = {r.word: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def phrase_places(words: Column, phrase: str) -> Column:
    """Numbers of the words where the phrase's words stand consecutively."""
    parts = phrase.split()
    fits = lambda at: _all(words[at + k] == part for k, part in enumerate(parts))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), fits)
    return F.when(F.size(words) >= len(parts), starts).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    whole = F.lit(True)
    for condition in conditions:
        whole = whole & condition
    return whole


def _needed(template: str, threshold: float) -> int:
    return math.ceil(threshold * len(set(template.split())) - 1e-9)


def template_matches(blocks: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Exact containment join: (_row, tokens) -> one row per block and template it meets: _row, label, containment.

    ``tokens`` are a block's distinct template tokens in any order, ``_block`` tells blocks of a row apart.
    """
    spark = blocks.sparkSession
    place = {w: k for k, w in enumerate(order)}
    prefixes, whole = [], []
    for number, (label, text) in enumerate(templates):
        tokens, need = sorted(set(text.split()), key=place.__getitem__), _needed(text, threshold)
        whole.append((number, label, tokens, len(tokens), need))
        prefixes += [(w, number, at, len(tokens), need) for at, w in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "token string, template int, at int, m int, need int")
    full = spark.createDataFrame(whole, "template int, label string, full array<string>, m int, need int")

    ordered = F.array_intersect(F.array(*map(F.lit, order)), F.col("tokens"))  # keeps the global order
    blocks = blocks.withColumn("tokens", ordered)
    first = blocks.select("_row", "_block", "tokens", F.posexplode("tokens").alias("pos", "token")).join(F.broadcast(prefix), "token")
    length = F.size("tokens")
    # what can still follow in both, counted from the shared token on
    rest = F.least(F.col("m") - F.col("at"), length - F.col("pos"))
    open_ = first.where((length >= F.col("need")) & (rest + F.least("at", "pos") >= F.col("need")))
    pairs = open_.select("_row", "_block", "tokens", "template").distinct().join(F.broadcast(full), "template")
    overlap = F.size(F.array_intersect("tokens", "full"))
    return pairs.where(overlap >= F.col("need")).select("_row", "label", (overlap / F.col("m")).alias("containment"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row.

    ``base_labels`` come from phrases, ``labels`` also from templates; both are distinct, sorted and comma-joined, and
    empty if there are none. ``score`` is 1 where a phrase stands, else the best containment that meets the threshold,
    else 0. A null or empty text has no words, labels or places. Repeated rows and null ids stay, other columns are
    ignored, an empty table gives no rows. Of equal tokens in a block one counts.
    """
    docs = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("_low"))
    vocabulary = _vocabulary(templates)
    order = token_order(docs, vocabulary)
    place = {w: k for k, w in enumerate(order)}
    leading = sorted(
        {w for _, t in templates for w in sorted(set(t.split()), key=place.__getitem__)[: len(set(t.split())) - _needed(t, threshold) + 1]}
    )

    texts = docs.withColumn("_words", words_of(F.col("_low")))
    words, texts = F.col("_words"), texts.withColumn("_row", F.monotonically_increasing_id())
    mentioned = F.col("_low").contains("license")
    base = {}
    for phrase, label in phrases.items():
        mentioned_phrase = F.when(mentioned | F.lit("license" not in phrase), phrase_places(words, phrase))
        base[label] = F.coalesce(mentioned_phrase, F.array().cast("array<int>"))
    texts = texts.withColumns({f"_{label}": places for label, places in base.items()})
    # a text without a leading token of any template has no block to look at
    blocks = F.concat(F.split("_low", "\n"), F.split("_low", BLANK_LINE))
    held = F.transform(blocks, lambda b: F.array_intersect(words_of(b), F.array(*map(F.lit, vocabulary))))
    fewest = min(_needed(t, threshold) for _, t in templates)
    held = F.filter(held, lambda tokens: (F.size(tokens) >= fewest) & F.arrays_overlap(tokens, F.array(*map(F.lit, leading))))
    touched = F.arrays_overlap("_words", F.array(*map(F.lit, leading)))
    all_places = F.concat(*(F.col(f"_{label}") for label in base))
    found = F.array_compact(F.array(*(F.when(F.size(f"_{label}") > 0, F.lit(label)) for label in base)))
    slim = durable(
        texts.select(
            "_row", "doc_id", F.size("_words").cast("long").alias("n_words"), all_places.alias("_places"),
            found.alias("_base"), F.when(touched, held).alias("_blocks"),
        ),
        "licenses",
    )

    some = slim.where(F.size("_blocks") > 0).select("_row", F.posexplode("_blocks").alias("_block", "tokens"))
    met = template_matches(some, order, templates, threshold)
    met = met.groupBy("_row").agg(F.collect_set("label").alias("_met"), F.max("containment").alias("_best"))
    joined = slim.drop("_blocks").join(met, "_row", "left")
    n = F.size("_places")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_met", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"),
        F.when(n > 0, F.array_min("_places")).cast("long").alias("first_word"),
        F.when(n > 0, F.array_max("_places")).cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )

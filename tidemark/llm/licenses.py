"""License scans by an exact set-similarity join of text blocks with license templates.

A block (a line of text, or as many words in a row as the template has twice, across line breaks)
matches a template if it holds at least ``threshold`` of the template's
distinct words. Words are ordered by how many documents hold them, rarest first. A block that
matches must share one of the first ``m - ceil(threshold * m) + 1`` of a template's ``m`` words
(prefix filter), must be long enough (length filter), and the shared word must stand early enough
in both for the rest to suffice (positional filter); what passes is verified on the whole sets.
Words outside all templates can't overlap, so a block is compared by its template words alone.
Of a matching window no more than the best of each template is told; windows are looked at only
around a word of the template's prefix, of which each one that matches holds some.
Everything runs as column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .orderhash import _let

# Phrases with their labels, and templates of license notices.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"),
           ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null and wordless texts."""
    plain = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(
        F.split(plain, " "))


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")

    def stands(i):
        here = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & (F.get(words, i + k) == part)
        return F.coalesce(here, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"),
                                                  i.cast("int").alias("at")))


def _best_window(words: Column, own: list[str], need: int, width: int) -> Column:
    """Most distinct words of ``own`` among ``width`` words in a row; 0 where fewer than ``need``.

    Only windows that hold one of the prefix words count; the others can't reach ``need``.
    """
    template = F.array(*map(F.lit, own))
    heads = own[:len(own) - need + 1]

    def overlap(part):
        return F.size(F.array_intersect(template, part))

    def around(at):
        first = F.greatest(at - (width - 1), F.lit(0))
        near = F.slice(words, first + 1, at + width - first)
        return _let(near, lambda n: F.when(overlap(n) >= need, F.array_max(F.transform(
            F.sequence(F.lit(0), at - first),
            lambda j: overlap(F.slice(n, j + 1, F.lit(width)))))).otherwise(0))

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1),
                      lambda i: F.get(words, i).isin(heads))
    best = F.coalesce(F.array_max(F.transform(places, around)), F.lit(0))
    return _let(best, lambda b: F.when(b >= need, b).otherwise(0))


def _windows(words: Column, vocabulary: Column, sets: list[tuple]) -> Column:
    """Label, block -1 and containment of the best window of each template that has one."""
    def one(w, has, label, own, need, width):
        # A window can't hold more of the template than the whole text does.
        held = F.size(F.array_intersect(F.array(*map(F.lit, own)), has)) >= need
        best = F.when(held, _best_window(w, own, need, width)).otherwise(0)
        return F.struct(F.lit(label).alias("label"), F.lit(-1).alias("block"),
                        (best / float(len(own))).alias("containment"))

    return _let(words, lambda w: _let(F.array_intersect(vocabulary, w), lambda has: F.filter(
        F.array(*(one(w, has, *s) for s in sets)), lambda m: m["containment"] > 0)))


def _distinct(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def _order(docs: DataFrame, templates) -> list[str]:
    """Template words by the number of documents that hold them, rarest first."""
    known = sorted({w for _, t in templates for w in t.split(" ")})
    plain = F.concat(F.lit(" "), F.regexp_replace(lower_ascii("text"), NON_WORD, " "), F.lit(" "))
    held = docs.select(plain.alias("p")).agg(*(
        F.count_if(F.contains("p", F.lit(f" {w} "))).alias(str(k)) for k, w in enumerate(known)))
    counts = held.first()  # one number for each template word
    return [w for _, w in sorted((counts[str(k)] or 0, w) for k, w in enumerate(known))]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES,
         threshold: float = 0.8) -> DataFrame:
    """License labels of every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, matches (label,
    block and containment of every matching line, and of each template's best window with block
    -1) and score, the largest containment, or 1 where
    a phrase stands. Rows with the same doc_id and text are one document; the same doc_id with
    different texts gives a row for each text. A null or empty text has no words and no labels.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    order = _order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    sets = []  # (label, words by rank, least overlap)
    for label, text in templates:
        own = sorted({*text.split(" ")}, key=rank.__getitem__)
        sets.append((label, own, math.ceil(threshold * len(own) - 1e-9)))
    spark = docs.sparkSession
    # One row for each prefix word of each template: a fixed, small number.
    prefixes = spark.createDataFrame(
        [(own[p], k, label, own, need, p) for k, (label, own, need) in enumerate(sets)
         for p in range(len(own) - need + 1)],
        "word string, template int, label string, own array<string>, need int, p int")
    heads = sorted({own[p] for _, own, need in sets for p in range(len(own) - need + 1)})
    vocabulary = F.array(*map(F.lit, order))

    counted = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.col("text"),
        words_of(F.col("text")).alias("words"))
    # Array work on whole texts only where a word of some phrase or prefix is there at all.
    some = F.arrays_overlap("words", F.array(*map(F.lit, sorted(
        {*heads, *(p.split(" ")[-1] for p, _ in phrases)}))))
    empty = F.array().cast("array<struct<label:string,at:int>>")
    base = F.when(some & (F.size("words") > 0), F.flatten(F.array(*(
        _labelled(_places(F.col("words"), phrase), label) for phrase, label in phrases)))
        ).otherwise(empty)
    # Template words of each block, rarest first, for blocks with a word of some prefix.
    held = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        i.alias("block"), F.array_intersect(vocabulary, words_of(line)).alias("has")))
    lines = F.when(some, F.filter(held, lambda b: F.arrays_overlap(
        b["has"], F.array(*map(F.lit, heads)))))
    narrow = counted.select(
        "doc_id", "mark", F.size("words").cast("bigint").alias("n_words"), base.alias("base"),
        lines.alias("lines"),
        F.when(some & (F.size("words") > 0), _windows(F.col("words"), vocabulary, [
            (label, own, need, 2 * len(text.split(" ")))
            for (label, own, need), (_, text) in zip(sets, templates)])).alias("windows"))
    blocks = narrow.select("doc_id", "mark", "n_words", "base", "windows",
                           F.explode_outer("lines").alias("b")) \
        .select("doc_id", "mark", "n_words", F.col("base").alias("base"), "windows",
                F.col("b.block").alias("block"), F.col("b.has").alias("has"))
    probes = blocks.select(
        "*", F.posexplode_outer(F.transform("has", lambda w: w)).alias("q", "word"))
    room = 1 + F.least(F.size("own") - F.col("p") - 1, F.size("has") - F.col("q") - 1)
    candidate = ((F.size("has") >= F.col("need")) & (room >= F.col("need")))
    found = probes.join(F.broadcast(prefixes), "word", "left").withColumn(
        "overlap", F.when(candidate, F.size(F.array_intersect("own", "has"))))
    match = F.when(F.col("overlap") >= F.col("need"), F.struct(
        "label", "block", (F.col("overlap") / F.size("own")).alias("containment")))
    per = found.groupBy("doc_id", "mark").agg(
        F.first("n_words").alias("n_words"), F.first("base").alias("base"),
        F.collect_set(match).alias("lines"), F.first("windows").alias("windows"))
    per = per.withColumn("matches", F.array_sort(F.when(
        F.col("windows").isNull(), F.col("lines")).otherwise(F.concat("lines", "windows")))
        ).drop("lines", "windows")
    names, places = F.col("base.label"), F.col("base.at")
    return per.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        _distinct(names).alias("base_labels"),
        _distinct(F.concat(names, F.col("matches.label"))).alias("labels"), "matches",
        F.when(F.size("base") > 0, 1.0).otherwise(
            F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s result."""
    return found.drop("matches")

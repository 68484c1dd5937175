"""Licence scans: exact set-similarity join of text blocks with licence templates.

Blocks are of two kinds. One starts at a line of a sentence and takes in the next
lines of this sentence until these hold as many words as the template, so that a
notice is met however it is wrapped; a blank line ends a sentence. The other is
any run of as many words as the template has, over all line and sentence ends. A
block meets a template if it holds at least ``threshold`` of the template's
distinct words. Tokens are ordered
by their document frequency over the whole corpus, rarest first. With
``need = ceil(threshold * n)`` a block that qualifies holds one of the template's
first ``n - need + 1`` tokens (prefix filter), has ``need`` distinct template
tokens at least (length filter), and at the first prefix token it shares enough
tokens are left in both (positional filter); what passes is verified on whole
sets. A whole text that fails is not cut into blocks. Templates are a parameter and small, so their inverted prefix index is a
literal in the plan and the join needs no shuffle: a line that stands in a third
of all documents costs no task more than another. Built of DataFrame functions
only.

Null texts count as empty; an empty text has no words, no labels and score 0;
repeated rows stay, each with its own result; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SENTENCE_END = r"\n[\x20\x09\x0B-\x0D]*\n|[.!?][\x20\x09-\x0D]+"
THRESHOLD = 0.8

# Phrases that always count, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices and the labels they give.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "reserved-notice": "no part of this publication may be reproduced without permission all rights reserved",
}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: ASCII characters that stand in no word.
BLANKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words (WORD) with A-Z lower-cased: what is in none becomes a blank, then runs between blanks; a regular expression takes some five times as long."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BLANKS, UPPER.lower() + " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def literal(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def frequencies(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Documents of the whole corpus that hold each template token."""
    found = df.select(F.explode(F.array_intersect(literal(vocabulary), words(F.col(text_col)))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def places(found: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand one after another."""
    parts = phrase.split()

    def at(word: Column, i: Column) -> Column:
        here = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & F.coalesce(F.get(found, i + k) == part, F.lit(False))
        return F.when(here, i.cast("long"))

    return F.filter(F.transform(found, at), lambda x: x.isNotNull())


def ordered(text: str, order: list[str], threshold: float) -> tuple[list[str], int, list[str]]:
    """(distinct tokens in global order, tokens needed, prefix) of a template."""
    tokens = sorted(set(text.split()), key=order.index)
    need = math.ceil(threshold * len(tokens) - 1e-9)
    return tokens, need, tokens[: len(tokens) - need + 1]


def met(held: Column, tokens: list[str], need: int, rarest: list[str]) -> Column:
    """The share of a template's tokens that a block holds, null below need; held: the block's template tokens in global order."""
    prefix = literal(rarest)
    first = F.element_at(F.array_intersect(prefix, held), 1)
    left = F.least(F.lit(len(tokens)) - F.array_position(prefix, first), F.size(held) - F.array_position(held, first)) + 1
    both = F.size(F.array_intersect(literal(tokens), held))
    passes = (F.size(held) >= need) & F.arrays_overlap(prefix, held)
    return F.when(passes, F.when(left >= need, F.when(both >= need, both / F.lit(float(len(tokens))))))


def sentences(text: Column, order: list[str]) -> Column:
    """array<array<struct<n, held>>>: words and template tokens of each line that has words, by sentence."""

    def lines(sentence: Column) -> Column:
        found = F.filter(F.transform(F.split(sentence, r"\n"), lambda x: words(x)), lambda w: F.size(w) > 0)
        return F.transform(found, lambda w: F.struct(F.size(w).alias("n"), F.array_intersect(literal(order), w).alias("held")))

    return F.transform(F.split(text, SENTENCE_END), lines)


def matched(cut: Column, found: Column, held: Column, templates: dict[str, str], threshold: float, order: list[str]) -> Column:
    """array<struct<label, containment>> of the templates that some block meets; cut: the sentences, found: all words, held: the text's template tokens."""

    def best(text: str, own: tuple[list[str], int, list[str]]) -> Column:
        size = len(text.split())
        meets = lambda x: F.get(F.transform(F.array(F.array_intersect(literal(order), x)), lambda h: met(h, *own)), F.lit(0))

        def block(lines: Column, line: Column, i: Column) -> Column:
            start = F.struct(F.lit(0).alias("n"), line["held"].alias("held"))
            longer = lambda acc, x: F.when(acc["n"] >= size, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), F.array_union(acc["held"], x["held"]).alias("held")))
            # Each line has a word, so the next ``size`` lines are enough.
            return F.when(F.size(line["held"]) > 0, meets(F.aggregate(F.slice(lines, i + 2, size), start, longer, lambda acc: acc["held"])))

        joined = F.array_max(F.transform(cut, lambda lines: F.array_max(F.transform(lines, lambda line, i: block(lines, line, i)))))
        runs = F.array_max(F.transform(found, lambda w, i: F.when(F.array_contains(literal(own[0]), w), meets(F.slice(found, i + 1, size)))))
        return F.when(met(held, *own).isNotNull(), F.greatest(joined, runs))

    of = [F.struct(F.lit(label).alias("label"), best(text, ordered(text, order, threshold)).alias("containment")) for label, text in templates.items()]
    return F.filter(F.array(*of), lambda x: x["containment"].isNotNull())


def scan(df: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, score (input columns of these names are replaced)."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for text in templates.values() for w in text.split()})
    count = frequencies(df, text_col, vocabulary)
    order = sorted(vocabulary, key=lambda t: (count.get(t, 0), t))
    sets = [ordered(text, order, threshold) for text in templates.values()]

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rest = [f"`{c}`" for c in df.columns if c not in names]
    rows = df.withColumn("__words", words(F.col(text_col)))
    none = F.array().cast("array<bigint>")
    base = {phrase: F.when(F.array_contains("__words", phrase.split()[0]), places(F.col("__words"), phrase)).otherwise(none) for phrase in PHRASES}
    rows = rows.withColumn("__held", F.array_intersect(literal(order), F.col("__words")))
    possible = reduce(or_, (met(F.col("__held"), *own).isNotNull() for own in sets), F.lit(False))
    rows = rows.withColumn("__cut", F.when(possible, sentences(F.col(text_col), order)))
    found = F.when(F.col("__cut").isNotNull(), matched(F.col("__cut"), F.col("__words"), F.col("__held"), templates, threshold, order))
    rows = rows.select(*rest, F.size("__words").cast("long").alias("__n"), F.array(*base.values()).alias("__places"), found.alias("__found"))
    labels = [F.when(F.size(F.get("__places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]
    rows = rows.select(*rest, "__n", F.flatten("__places").alias("__all"), F.array_sort(F.array_compact(F.array(*labels))).alias("__base"), F.coalesce(F.col("__found"), F.array().cast("array<struct<label:string,containment:double>>")).alias("__found"))
    best = F.coalesce(F.array_max(F.transform("__found", lambda x: x["containment"])), F.lit(0.0))
    return rows.select(
        *rest, F.col("__n").alias("n_words"), F.size("__all").cast("long").alias("n_base"), F.array_min("__all").alias("first_word"), F.array_max("__all").alias("last_word"), F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("__base", F.transform("__found", lambda x: x["label"])))), ",").alias("labels"), F.when(F.size("__base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _oracle() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = " UNION ALL ".join(f"SELECT doc, {label!r} AS label, i - 1 AS pos FROM w, UNNEST(range(1, len(ws) + 1)) AS u(i) WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES.items())
    values = ", ".join(f"({label!r}, {sorted(set(text.split()))!r})" for label, text in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS low FROM documents),
w AS (SELECT doc, doc_id, regexp_extract_all(low, '{word}') AS ws FROM d),
p AS ({phrases}),
b AS (SELECT doc, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM p GROUP BY doc),
t(label, tokens) AS (VALUES {values}),
k AS (SELECT doc, list_distinct(regexp_extract_all(UNNEST(regexp_split_to_array(low, '\n|[.!?][\x20\x09-\x0D]+')), '{word}')) AS block FROM d),
m AS (SELECT doc, label, len(list_intersect(block, tokens)) / len(tokens)::DOUBLE AS c FROM k, t WHERE len(list_intersect(block, tokens)) >= {THRESHOLD} * len(tokens) - 1e-9),
g AS (SELECT doc, list_distinct(list(label)) AS labels, max(c) AS c FROM m GROUP BY doc)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ',') AS labels,
  CASE WHEN b.doc IS NOT NULL THEN 1.0 ELSE coalesce(g.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc) LEFT JOIN g USING (doc)
"""


OP7_SQL = _oracle()

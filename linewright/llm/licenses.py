"""License scans: phrases, and an exact set-similarity join of text blocks with license templates, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import shielded, stored, table

#: Phrases that name a license by themselves, and its label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices by which works are put under public licenses, and their labels.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: The share of a template's distinct words that a block must have.
CONTAINMENT = 0.9
_OUT = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{_OUT}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in lower case (A-Z only)."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _inside(pattern: str) -> str:
    """A pattern of whole words, in either case of A-Z."""
    return rf"(?i)(?<![^{_OUT}])(?:{pattern})(?![^{_OUT}])"


def phrase_places(found: Column, phrase: str) -> Column:
    """The places (from 0) in an array of words where a phrase's words stand one after the other."""
    parts = phrase.split(" ")
    here = lambda i: F.get(found, i) == parts[0]
    follow = lambda i: F.forall(F.array(*(F.coalesce(F.get(found, i + k) == p, F.lit(False)) for k, p in enumerate(parts))), lambda x: x)
    every = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(F.filter(every, here), follow)


def template_sets(spark: SparkSession, templates: Sequence[tuple[str, str]], containment: float = CONTAINMENT) -> DataFrame:
    """Rows (template, label, span, token, size, need): the distinct words of each template, how many it has and how many a block must have; span is the least power of two, from 16, with room for all its words. Templates without words are left out."""
    rows = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(templates)], "template int, label string, text string").withColumn("words", words(F.col("text"))).where(F.size("words") > 0)
    sets = rows.select("template", "label", F.greatest(F.lit(16.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("words"))))).cast("int").alias("span"), F.array_distinct("words").alias("tokens"))
    size = F.size("tokens")
    return sets.select("template", "label", "span", F.explode("tokens").alias("token"), size.alias("size"), F.ceil(F.lit(containment) * size - 1e-9).cast("int").alias("need"))


def ranked(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (token, rank) of the words of templates, the rarest first by the number of documents that have them (ties by the word). A template word that no document has comes first."""
    vocabulary = [r["token"] for r in sets.select("token").distinct().collect()]
    known = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(known).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", "token")))  # one row for each word of the templates
    full = sets.select("token").distinct().join(F.broadcast(counts), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    return full.agg(order.alias("o")).select(F.posexplode("o").alias("rank", "o")).select("o.token", "rank")


def matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Rows (digest, label, containment, n_blocks): of each text (column `text`, no nulls) the labels of the templates of which some block has enough, with the greatest share and the number of such pairs of block and template.

    Blocks are windows of twice a template's span of words, one starting at every multiple of the span, so each passage of that length is inside
    one. Only words of templates matter for the share that a block has of one, so blocks are sets of these, ordered from the rarest on. A block and
    a template that share `need` words share one of the template's first size - need + 1 and of the block's first size - need + 1, and after their first
    common word enough must be left in both (positional filter); a block with fewer than `need` has none (length filter). Each pair is verified once, at its first common word.
    Texts are known by their digest, so copies are joined once.
    """
    spark = docs.sparkSession
    sets = template_sets(spark, templates, containment)
    spans = [r["span"] for r in sets.select("span").distinct().collect()]
    if not spans:
        return spark.createDataFrame([], "digest string, label string, containment double, n_blocks long")
    ranks = stored(ranked(docs, sets), "ranks")
    placed = stored(sets.join(F.broadcast(ranks), "token").withColumn("at", F.row_number().over(Window.partitionBy("template").orderBy("rank")) - 1), "templates")
    whole = placed.groupBy("template", "label", "span", "size", "need").agg(F.sort_array(F.collect_list("rank")).alias("ours"))
    prefixes = placed.where("at < size - need + 1").select("template", "span", "rank", "at", "size", "need")
    rare = [r["token"] for r in prefixes.join(ranks, "rank").select("token").distinct().collect()]
    near = docs.where(F.col("text").rlike(_inside("|".join(sorted(rare, key=lambda w: (-len(w), w)))))) if rare else docs.limit(0)
    each = near.select(F.md5(F.col("text").cast("binary")).alias("digest"), F.posexplode(words(F.col("text"))).alias("pos", "token")).join(F.broadcast(ranks), "token")
    windows = F.explode(F.array(*(F.struct(F.lit(s).alias("span"), (F.floor(F.col("pos") / s) - back).cast("int").alias("window")) for s in spans for back in (0, 1))))
    blocks = each.select("digest", "rank", windows.alias("w")).where("w.window >= 0").groupBy("digest", "w.span", "w.window").agg(F.sort_array(F.collect_set("rank")).alias("theirs"))
    least = prefixes.groupBy("span").agg(F.min("need").alias("least"))
    blocks = blocks.join(F.broadcast(least), "span").where(F.size("theirs") >= F.col("least"))
    starts = blocks.select("*", F.posexplode("theirs").alias("j", "rank")).where("j < size(theirs) - least + 1")
    hits = starts.join(F.broadcast(prefixes), ["span", "rank"]).where("size(theirs) >= need and j < size(theirs) - need + 1 and 1 + least(size - at - 1, size(theirs) - j - 1) >= need")
    pairs = hits.join(F.broadcast(whole.select("template", "label", "ours")), "template")
    common = F.array_intersect("ours", "theirs")
    verified = pairs.withColumn("common", common).where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("rank")))
    return verified.groupBy("digest", "label").agg(F.max(F.size("common") / F.col("size")).alias("containment"), F.count("*").alias("n_blocks"))


def scanned(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of `docs` (with `text`), each with __n_words, __n_base, __first_word, __last_word, __base_labels, __labels (arrays, sorted) and __score.

    A null text is an empty one. Base places are where a phrase's words stand one after the other. Labels are those of the phrases and of the templates that a block
    of the text contains; the score is 1 with a base label, else the greatest share of a template that was found, else 0. Repeated rows have equal results.
    """
    texts = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    named = F.col("__text").rlike(_inside("|".join(p.replace(" ", f"[{_OUT}]+") for p, _ in phrases)))
    at = F.struct(*(phrase_places(F.col("__words"), p).alias(f"p{k}") for k, (p, _) in enumerate(phrases)))
    rows = texts.withColumn("__n_words", F.regexp_count("__text", F.lit(WORD)).cast("long")).withColumn("__words", F.when(named, words(F.col("__text")))).withColumn("__at", F.when(named, at))
    every = F.flatten(F.array(*(F.col(f"__at.p{k}") for k in range(len(phrases)))))
    base = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"__at.p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())))
    empty = F.expr("cast(array() as array<string>)")
    rows = rows.withColumns({"__n_base": F.coalesce(F.size(every), F.lit(0)).cast("long"), "__first_word": F.array_min(every).cast("long"), "__last_word": F.array_max(every).cast("long"), "__base_labels": F.coalesce(base, empty), "__digest": F.md5(F.col("__text").cast("binary"))}).drop("__words", "__at", "__text")
    rows = rows.withColumn("__n_base", F.when(F.col("__first_word").isNull(), 0).otherwise(F.col("__n_base")).cast("long"))
    found = matches(docs.select("text").where("text is not null"), templates, containment)
    found = found.groupBy(F.col("digest").alias("__digest")).agg(F.collect_set("label").alias("__more"), F.max("containment").alias("__share"))
    joined = rows.join(found, "__digest", "left")
    labels = F.array_sort(F.array_union("__base_labels", F.coalesce("__more", empty)))
    return joined.withColumn("__labels", labels).withColumn("__score", F.when(F.size("__base_labels") > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0)))).drop("__digest", "__more", "__share")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of all `documents`."""
    docs, _ = shielded(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    out = scanned(docs)
    joined = lambda c: F.array_join(c, ",")
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_base").alias("n_base"), F.col("__first_word").alias("first_word"), F.col("__last_word").alias("last_word"), joined("__base_labels").alias("base_labels"), joined("__labels").alias("labels"), F.col("__score").alias("score"))


def _op12_sql() -> str:
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".encode("unicode_escape").decode().replace("\\\\", "\\")
    here = [f"list_filter(range(len(ws)), lambda i: {' AND '.join(f'ws[i + {k + 1}] = {literal(w)}' for k, w in enumerate(p.split()))})" for p, _ in PHRASES]
    given = ", ".join(f"({literal(label)}, {literal(text)})" for label, text in TEMPLATES)
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS ws FROM documents),
places AS (SELECT r, doc_id, ws, [{', '.join(here)}] AS here FROM texts),
base AS (SELECT r, doc_id, len(ws) AS n, flatten(here) AS places, list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN len(here[{k + 1}]) > 0 THEN {literal(label)} END" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL))) AS labels FROM places),
given AS (SELECT label, {split} AS tw FROM (VALUES {given}) AS v(label, text)),
templates AS (SELECT label, list_distinct(tw) AS ours, CAST(greatest(16, 2 ** ceil(log2(len(tw)))) AS BIGINT) AS span FROM given),
blocks AS (SELECT r, span, list_distinct(ws[k + 1:k + 2 * span]) AS theirs FROM (SELECT r, ws, span, unnest(range(0, greatest(len(ws), 1), span)) AS k FROM texts, (SELECT DISTINCT span FROM templates))),
found AS (SELECT r, label, max(len(list_intersect(ours, theirs)) / len(ours)) AS share FROM blocks JOIN templates USING (span) WHERE len(list_intersect(ours, theirs)) >= ceil({CONTAINMENT} * len(ours) - 1e-9) GROUP BY r, label),
more AS (SELECT r, list(label) AS labels, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, n AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base.labels, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(more.labels, [])))), ',') AS labels, CASE WHEN len(base.labels) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM base LEFT JOIN more USING (r)"""


OP12_SQL = _op12_sql()

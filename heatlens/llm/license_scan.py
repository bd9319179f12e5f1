"""License scans by diagonal voting, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Every run of k words in
a text is hashed and joined with the hashed runs of the templates. A hit at word ``d`` of the text and word
``t`` of a template votes for the diagonal ``d - t``, the place where the template would start:

- A phrase (a template of two or three words, k = 2) stands where its diagonal has all its votes.
- A passage (k = 4) may have lost or gained words, which moves the rest of it to a diagonal nearby. Diagonals at
  most ``SLIP`` apart are merged; the merged span is verified: it has to hold ``COVERAGE`` of the template's runs in no
  more than ``STRETCH`` times its words. Of passages that overlap the best covered one stays (all that tie), since licenses
  quote each other.

Hits are verified by their words, so equal hashes of different words vote for nothing. The joined side is
the templates, a table given by the caller that is broadcast up to ``BROADCAST_ROWS`` runs and shuffled beyond.
A document travels as one more hit, on the run of a word that no text has, so texts are read once and
documents without a hit stay.

Null text counts as empty: no words, no places. Rows that repeat a ``doc_id`` are judged by their own texts; rows that
repeat both are judged once and returned as often as they are. Other columns don't matter.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from heatlens.llm.common import BROADCAST_ROWS, staged, text_of
from heatlens.staging import small_table

PHRASE_RUN, PASSAGE_RUN = 2, 4
SLIP = 3
COVERAGE = 0.5
STRETCH = 1.5
# Repeated rows come back from a count, so many at a time.
REPEATS = 100_000
# NUL separates words, so no text has this one.
_ROW = "\x00"
_ROW_TEMPLATE = -1


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False


# Phrases that name a license.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Notices and opening passages of common licenses.
PASSAGES = (
    Template("mit", "Released under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _runs(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """``keep``, ``at`` and the next words ``w.0 .. w.3`` of every word of the array ``words``."""
    shifted = [F.col(words)] + [F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))) for i in range(1, PASSAGE_RUN)]
    named = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    zipped = df.select(*keep, named.alias("__zip"))
    # the plain form filters by size first, and splits the text once more for each word of a run
    return zipped.select(*keep, F.posexplode_outer("__zip").alias("at", "w"))


def _run_words(k: int | Column) -> Column:
    short = F.concat_ws(" ", "w.w0", "w.w1")
    return short if isinstance(k, int) else F.when(k == PHRASE_RUN, short).otherwise(F.concat_ws(" ", "w.w0", "w.w1", "w.w2", "w.w3"))


def _head() -> Column:
    return F.xxhash64("w.w0", "w.w1")


def _template_table(docs: DataFrame, templates: Sequence[Template]) -> tuple[DataFrame, DataFrame]:
    """The templates (``template, label, phrase, runs, length``), and their runs (``head, run, k, template, t``)."""
    given = small_table(
        docs.sparkSession, [(i, *t) for i, t in enumerate(templates)], "template int, label string, text string, phrase boolean"
    )
    k = F.when(F.col("phrase"), PHRASE_RUN).otherwise(PASSAGE_RUN)
    worded = given.select("template", "label", "phrase", k.alias("k"), words_of(F.col("text")).alias("words"))
    worded = worded.withColumn("runs", F.size("words") - F.col("k") + 1).filter("runs > 0")
    runs = _runs(worded, "words", "template", "k", "runs").filter("at < runs").select(
        _head().alias("head"), _run_words(F.col("k")).alias("run"), "k", "template", F.col("at").alias("t")
    )
    row = worded.sparkSession.range(1).select(
        F.xxhash64(F.lit(_ROW), F.lit(_ROW)).alias("head"), F.lit(f"{_ROW} {_ROW}").alias("run"),
        F.lit(PHRASE_RUN).alias("k"), F.lit(_ROW_TEMPLATE).alias("template"), F.lit(0).alias("t"),
    )
    return worded.select("template", "label", "phrase", "runs", F.size("words").alias("length")), runs.unionByName(row)


def _hits(docs: DataFrame, runs: DataFrame, bounded: bool) -> DataFrame:
    """``id, print, n_words, template, t, d``. The row's own hit has the template -1."""
    text = text_of()
    worded = docs.select(
        F.col("doc_id").alias("id"), F.sha2(text, 256).alias("print"), words_of(text).alias("words")
    ).withColumn("n_words", F.size("words").cast("long"))
    # two words that no text has come first, so word 0 of the text is at 2
    marked = worded.select("id", "print", "n_words", F.concat(F.array(F.lit(_ROW), F.lit(_ROW)), "words").alias("words"))
    spoken = _runs(marked, "words", "id", "print", "n_words").withColumn("head", _head())
    joined = spoken.join(F.broadcast(runs) if bounded else runs, "head").filter(_run_words(F.col("k")) == F.col("run"))
    return joined.select("id", "print", "n_words", "template", "t", (F.col("at") - 2).cast("long").alias("d"))


def _spans(diagonals: DataFrame, listed: DataFrame) -> DataFrame:
    """``id, print, span`` of verified places. ``diagonals``: ``id, print, template, diagonal, votes`` (template words)."""
    named = diagonals.join(F.broadcast(listed), "template")
    along = Window.partitionBy("id", "print", "template").orderBy("diagonal")
    steps = F.col("diagonal") - F.lag("diagonal").over(along)
    # a phrase is one diagonal, a passage may slip
    opens = F.col("phrase") | steps.isNull() | (steps > SLIP)
    merged = (
        named.withColumn("opens", F.when(opens, 1).otherwise(0))
        .withColumn("place", F.sum("opens").over(along))
        .groupBy("id", "print", "template", "label", "phrase", "runs", "length", "place")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("found"),
            F.min(F.col("diagonal") + F.array_min("votes")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("votes")).alias("last"),
        )
    )
    share = F.col("found") / F.col("runs")
    end = F.col("last") + F.col("length") - F.col("runs") + 1
    whole = F.col("phrase") & (F.col("found") == F.col("runs"))
    close = ~F.col("phrase") & (share >= COVERAGE) & (end - F.col("first") <= STRETCH * F.col("length"))
    kept = merged.filter(whole | close).select(
        "id", "print", F.col("first").alias("start"), end.alias("end"), "label", F.col("phrase").alias("base"), share.alias("coverage")
    )
    of_text = Window.partitionBy("id", "print", "base").orderBy("start", "end", "label")
    reached = F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = reached.isNull() | (F.col("start") >= reached)
    chained = kept.withColumn("opens", F.when(opens, 1).otherwise(0)).withColumn("chain", F.sum("opens").over(of_text))
    best = F.max("coverage").over(Window.partitionBy("id", "print", "base", "chain"))
    span = F.struct("start", "end", "label", "base", "coverage")
    return chained.withColumn("best", best).filter("base or coverage = best").select("id", "print", span.alias("span"))


def scan(docs: DataFrame, templates: Sequence[Template] = PHRASES + PASSAGES) -> DataFrame:
    """``doc_id, n_words, spans, score``, a row for every row of ``docs`` (``doc_id, text``).

    ``spans`` are the places in order, ``(start, end, label, base, coverage)`` in words, ``base`` for phrases.
    ``score`` is the best coverage, 0 without a place.
    """
    listed, runs = _template_table(docs, templates)
    bounded = sum(len(t.text) for t in templates) <= BROADCAST_ROWS
    voted = _hits(docs, runs, bounded).groupBy("id", "print", "template", (F.col("d") - F.col("t")).alias("diagonal"))
    # written: both kinds of hits are read from here, and the texts once
    diagonals = staged(
        voted.agg(F.collect_set("t").alias("votes"), F.max("n_words").alias("n_words"), F.count("*").alias("rows")), "diagonals"
    )
    rows = diagonals.filter(F.col("template") == _ROW_TEMPLATE).select(
        "id", "print", "n_words", "rows", F.lit(None).alias("span")
    )
    spans = _spans(diagonals.filter(F.col("template") != _ROW_TEMPLATE), listed).select(
        "id", "print", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("rows"), "span"
    )
    judged = (
        rows.unionByName(spans)
        .groupBy("id", "print")
        .agg(F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.array_sort(F.collect_list("span")).alias("spans"))
    )
    parts = judged.withColumn("__from", F.explode(F.expr(f"sequence(1L, rows, {REPEATS}L)")))
    each = parts.withColumn("__row", F.explode(F.expr(f"sequence(__from, least(rows, __from + {REPEATS - 1}L))")))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return each.select(F.col("id").alias("doc_id"), "n_words", "spans", best.alias("score"))

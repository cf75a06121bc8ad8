"""License scan by diagonal voting.

All rolling three-word grams of every document are hashed and joined with the
gram positions of the license templates. A hit votes for its offset diagonal
(document place minus template place); votes are summed per document, template
and diagonal, and neighbouring diagonals (words inserted or lost here and there) are
merged to pieces. Pieces that follow each other in the text and go on in the
template are chained across inserted passages. A piece or a chain is a span if it is
verified: it must cover enough different places of the template and be no longer than
the template allows (STRETCH), which also bounds the passages. Everything is DataFrame operations;
the template table is a parameter of bounded size and is broadcast.

Base places are where a phrase's words stand consecutively. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, counted from 0.

Defined cases: a null or word-free text has no word, no place, empty labels and
score 0; repeated rows are scanned each; an empty table gives an empty result;
null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acqlens.llm.storage import blank, settle
from acqlens.llm.urls import LOWER, UPPER

GRAM = 3
DRIFT = 3  # diagonals at most so far apart are one piece
LEAST_VOTES = 2  # grams of a piece that may be chained: chance hits do not break a chain
COVERAGE = 0.6  # share of a template's grams that a span must have
STRETCH = 1.5  # a span's length over its template's, at most
MAX_TEMPLATE_WORDS = 50_000  # bound of the broadcast table

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices by which common licenses are stated, as (label, text).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]


def words(text: Column) -> Column:
    """The words of a text in order."""
    low = F.translate(blank(text), UPPER, LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(column: str) -> Column:
    """(w0, w1, w2) at every word's place; the places at the end have nulls."""
    size = F.size(column)
    return F.arrays_zip(F.col(column).alias("w0"),
                        F.slice(column, 2, F.greatest(size - 1, F.lit(0))).alias("w1"),
                        F.slice(column, 3, F.greatest(size - 2, F.lit(0))).alias("w2"))


def _gram_key() -> Column:
    return F.when(F.col("g.w2").isNotNull(), F.xxhash64("g.w0", "g.w1", "g.w2"))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(key, at: array of (tpl, label, tpos, n)): the places of every gram in the templates."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    source = spark.createDataFrame(rows, "tpl int, label string, text string").select("tpl", "label", words(F.col("text")).alias("w"))
    return source.select("tpl", "label", F.greatest(F.size("w") - (GRAM - 1), F.lit(0)).alias("n"),
                         F.posexplode(grams("w")).alias("tpos", "g")).select(
        _gram_key().alias("key"), F.struct("tpl", "label", "tpos", "n").alias("place")).where("key is not null").groupBy(
        "key").agg(F.collect_list("place").alias("at"))


def _phrase_label(phrases: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for phrase, label in phrases.items():
        first, *rest = phrase.split(" ")
        fits = F.col("g.w0") == first
        for i, word in enumerate(rest, 1):
            fits = fits & (F.col(f"g.w{i}") == word)
        out = F.when(fits, label).otherwise(out)
    return out


def spans(hits: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans (row, label, start, end, coverage) from hits (row, pos, at)."""
    votes = (
        hits.select("row", "pos", F.inline("at")).withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("row", "tpl", "label", "n", "diagonal")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("places"))
    )
    near = Window.partitionBy("row", "tpl").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT).cast("int"), F.lit(0))
    merged = votes.withColumn("new", new).withColumn("span", F.sum("new").over(near)).groupBy(
        "row", "tpl", "label", "n", "span").agg(
        F.min("first").alias("start"), (F.max("last") + GRAM).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    # A piece goes on with the chain of the one before it, unless it steps back in the template or begins too far away.
    follows = Window.partitionBy("row", "tpl").orderBy("start", "end", "span")
    slack = F.ceil((STRETCH - 1) * (F.col("n") + GRAM - 1)) + DRIFT
    breaks = (F.array_min("places") < F.lag(F.array_max("places")).over(follows)) | (
        F.col("start") - F.lag("end").over(follows) > slack)
    chained = merged.where(F.size("places") >= LEAST_VOTES).withColumn("break", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(
        "chain", F.sum("break").over(follows)).groupBy("row", "tpl", "label", "n", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    columns = ["row", "label", "n", "start", "end", (F.size("places") / F.col("n")).alias("coverage")]
    return merged.select(*columns).union(chained.select(*columns)).where(
        (F.col("coverage") >= coverage) & (F.col("end") - F.col("start") <= STRETCH * (F.col("n") + GRAM - 1) + DRIFT)).select(
        "row", "label", "start", "end", "coverage").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    spark = docs.sparkSession
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    table = template_grams(spark, templates)
    if sum(len(t.split()) for _, t in templates) <= MAX_TEMPLATE_WORDS:
        table = F.broadcast(table)
    every = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
        .select("row", "id", F.size("w").alias("n_words"), F.posexplode_outer(grams("w")).alias("pos", "g"))
        .select("row", "id", "n_words", "pos", _gram_key().alias("key"), _phrase_label(phrases).alias("base"))
    )
    # One row for the document itself (its first place) and one for each place with a phrase or a template gram.
    hits = settle(every.join(table, "key", "left").where("pos is null or pos = 0 or base is not null or at is not null")
                  .drop("key"))
    found = spans(hits.where("at is not null")).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    docs_rows = hits.groupBy("row").agg(
        F.max("id").alias(id_col), F.max("n_words").cast("bigint").alias("n_words"), F.count("base").alias("n_base"),
        F.min(F.when(F.col("base").isNotNull(), F.col("pos"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base").isNotNull(), F.col("pos"))).cast("bigint").alias("last_word"),
        F.collect_set("base").alias("labels"))
    return docs_rows.join(found, "row", "left").select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("labels", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"))

"""License scans by diagonal voting, with DataFrame and SQL functions only.

All rolling hashes of k words of every text are joined with the positions of the same hashes in
templates of license notices. Hits that agree word by word vote for (template, position in the text
minus position in the template); neighbouring diagonals, as insertions and deletions leave them, are
merged. A merged span is then verified on its words: the longest common subsequence of the template
and the words of the span's hits, in the order of the text, must hold ``MIN_SHARE`` of the template.
It is found bit by bit (a set of template positions in one long), so a span costs as much as its
words. Fixed phrases are found besides.

The templates are a fixed list of notices of at most ``LONGEST`` words, so the side that is broadcast
doesn't grow with the data.

Edge cases: null texts count as empty; without words counts are 0, places null and labels empty;
a row is named by doc_id and a hash of its text, so repeated rows are reported alike; overlapping
places of phrases all count; spans may have any length, and very long texts are scanned whole; equal
shares need no order, labels being sorted; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import prepare, table

K, NEAR, MIN_SHARE = 3, 3, 0.6
#: Most words of a template: positions are bits of a long, with one to spare for a carry.
LONGEST = 61
#: ASCII capitals and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases with their labels, and license notices with theirs.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Lower-case words: runs of digits, ASCII letters and characters beyond ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def grams(column: str, k: int = K) -> Column:
    """Every k consecutive words, with their hash."""
    parts = ", ".join(f"get({column}, i + {j})" for j in range(k))
    gram = f"transform(sequence(0, size({column}) - {k}), i -> named_struct('h', xxhash64({parts}), 'ws', slice({column}, i + 1, {k})))"
    return F.expr(f"if(size({column}) >= {k}, {gram}, cast(array() as array<struct<h:bigint,ws:array<string>>>))")


def templates(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, body, places): the words of each notice, and for each word a bit set of its positions."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(notices)], "template int, label string, text string")
    rows = rows.select("template", "label", words("text").alias("body"))
    rows = rows.withColumn("body", F.expr(f"if(size(body) <= {LONGEST}, body, raise_error('a notice has too many words; give it in parts'))"))
    bits = "aggregate(sequence(0, size(body) - 1), 0L, (b, i) -> b | if(get(body, i) = w, shiftleft(1L, i), 0L))"
    return rows.where("size(body) > 0").withColumn("places", F.expr(f"map_from_arrays(array_distinct(body), transform(array_distinct(body), w -> {bits}))"))


def common(span: str) -> Column:
    """The length of the longest common subsequence of a template and words in order.

    ``v`` has a bit for each template position; a word clears those where the subsequence grows
    (row by row of the usual table, all columns at once).
    """
    full = "(shiftleft(1L, size(body)) - 1L)"
    step = f"((v + (v & m)) | (v - (v & m))) & {full}"
    return F.expr(f"size(body) - bit_count(aggregate(transform({span}, w -> coalesce(element_at(places, w), 0L)), {full}, (v, m) -> {step}))")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("x"), words("text").alias("w"))


def matches(docs: DataFrame, notices: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, x, label, start, stop, share): spans of notices, in words, stop exclusive.

    ``share`` is that of the notice's words that a span has in order.
    """
    spark = prepare(docs.sparkSession)
    known = templates(spark, notices)
    index = known.select("template", F.posexplode(grams("body")).alias("at", "g")).select("template", "at", F.col("g.h").alias("h"), F.col("g.ws").alias("body_ws"))
    places = keyed(docs).select("doc_id", "x", F.posexplode(grams("w")).alias("pos", "g")).select("doc_id", "x", "pos", F.col("g.h").alias("h"), F.col("g.ws").alias("ws"))
    hits = places.join(F.broadcast(index), "h").where("ws = body_ws")
    votes = hits.groupBy("doc_id", "x", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("pos", "ws")).alias("met"))
    line = Window.partitionBy("doc_id", "x", "template").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEAR, 0).otherwise(1)
    merged = votes.withColumn("new", step).withColumn("island", F.sum("new").over(line))
    spans = merged.groupBy("doc_id", "x", "template", "island").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))).alias("met"))
    # each hit gives the words that the one before it hasn't given
    fresh = f"flatten(transform(met, (e, i) -> slice(e.ws, {K} + 1 - least({K}, e.pos - coalesce(get(met, i - 1).pos, e.pos - {K})), {K})))"
    spans = spans.withColumn("span", F.expr(fresh)).withColumn("start", F.expr("met[0].pos")).withColumn("stop", F.expr(f"element_at(met, -1).pos + {K}"))
    likely = spans.join(F.broadcast(known), "template").withColumn("share", common("span") / F.size("body"))
    return likely.where(f"share >= {MIN_SHARE}").select("doc_id", "x", "label", "start", "stop", "share")


def scan(docs: DataFrame, notices: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per document the places of phrases, all labels, and a score: the best share of a notice.

    A phrase alone scores one half.
    """
    found = matches(docs, notices).groupBy("doc_id", "x").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
    base = keyed(docs)
    columns = []
    for i, (phrase, _) in enumerate(PHRASES):
        test = " and ".join(f"get(w, i + {j}) = '{word}'" for j, word in enumerate(phrase.split()))
        columns.append(F.expr(f"filter(sequence(0L, size(w) - 1L), i -> {test})" if phrase else "").alias(f"p{i}"))
    base = base.select("doc_id", "x", F.size("w").cast("bigint").alias("n_words"), *[F.when(F.size("w") > 0, c).otherwise(F.expr("cast(array() as array<bigint>)")).alias(f"p{i}") for i, c in enumerate(columns)])
    names = [f"p{i}" for i in range(len(PHRASES))]
    base = base.withColumn("all", F.concat(*names)).withColumn("fixed", F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(names, PHRASES, strict=True)])))
    base = base.select("doc_id", "x", "n_words", F.size("all").cast("bigint").alias("n_base"), F.array_min("all").alias("first_word"), F.array_max("all").alias("last_word"), "fixed")
    same = (base.x == found.x) & base.doc_id.eqNullSafe(found.doc_id)
    out = base.join(found, same, "left").select(base.doc_id, "n_words", "n_base", "first_word", "last_word", "fixed", "more", "best")
    line = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", line(F.col("fixed")).alias("base_labels"),
        line(F.concat("fixed", F.coalesce("more", F.expr("cast(array() as array<string>)")))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

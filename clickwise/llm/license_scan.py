"""License scan by diagonal voting (DataFrame functions only).

Every rolling word 2-gram of a text is hashed and joined to the 2-grams of the
templates (a few hundred rows, a constant of this module).  A hit at word p of
the text for word q of a template votes for the diagonal p - q.  Votes are
counted per (text, template, diagonal); neighbouring diagonals merge, so words
put in or left out split no match; spans are verified by comparing the words
themselves.

A base phrase counts where all its 2-grams lie on one diagonal, that is, where
its words stand consecutively.  A long template gives its label where a merged
run covers at least MIN_COVER of its distinct 2-grams within MAX_STRETCH times
its length.

Defined results: a null or empty text has no words, no labels and score 0;
null doc_ids and repeated rows each get their own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clickwise.llm.common import ascii_lower

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrase -> label of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Own templates: the characteristic sentence of well-known licenses.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                "documentation files the software to deal in the software without restriction",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that "
                "the following conditions are met",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                   "with the license you may obtain a copy of the license at",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation",
    "mpl-text": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
                "not distributed with this file",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use",
    "cc-text": "this work is licensed under a creative commons attribution",
    "mit-notice": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
}
MIN_COVER = 0.8
# Diagonals at most this far apart merge (words put in or left out).
BAND = 3
MAX_STRETCH = 2
END = "\x00end"


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, is_base, q, w0, w1, n_grams: one row per template position."""
    rows = []
    for base, phrases in ((True, BASE_PHRASES.items()), (False, ((t, name) for name, t in TEMPLATES.items()))):
        for text, label in phrases:
            w = text.split()
            rows += [(text, label, base, q, w[q], w[q + 1], len(w) - 1) for q in range(len(w) - 1)]
    rows.append((END, END, False, 0, END, END, 1))
    df = spark.createDataFrame(rows, "template string, label string, is_base boolean, q int, w0 string, w1 string, n_grams int")
    return df.withColumn("gram", F.xxhash64("w0", "w1")).withColumnsRenamed({"w0": "t0", "w1": "t1"})


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified template hits: rid, doc_id, p (word), template position columns.
    Each text ends in one marker gram, so texts without a hit stay in sight and
    bring their number of words (p) without a second scan."""
    words = F.array_remove(F.split(ascii_lower(text_col), SEPARATORS), "")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words.alias("w"))
    n = F.size("w")
    grams = F.arrays_zip(F.concat(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.array(F.lit(END))).alias("w0"),
                         F.concat(F.slice("w", 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(END))).alias("w1"))
    each = (rows.select("rid", "doc_id", n.alias("n_words"), F.posexplode(grams).alias("p", "g"))
                .select("rid", "doc_id", "n_words", "p", "g.w0", "g.w1")
                .withColumn("gram", F.xxhash64("w0", "w1")))
    # The templates are a constant of this module: a few hundred rows.
    return (each.join(F.broadcast(template_grams(docs.sparkSession)), "gram")
                .filter((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: rid, doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, matches (label, first, last word, cover of each span)."""
    found = hits(docs, id_col, text_col)
    diagonals = (found.withColumn("diag", F.col("p") - F.col("q"))
                      .groupBy("rid", "doc_id", "n_words", "template", "label", "is_base", "n_grams", "diag")
                      .agg(F.collect_set("q").alias("qs"), F.min("p").alias("lo"), F.max("p").alias("hi")))
    line = W.partitionBy("rid", "template").orderBy("diag")
    near = F.when(~F.col("is_base") & (F.col("diag") - F.lag("diag").over(line) <= BAND), 0).otherwise(1)
    runs = (diagonals.withColumn("fresh", near).withColumn("run", F.sum("fresh").over(line))
                     .groupBy("rid", "doc_id", "n_words", "template", "label", "is_base", "n_grams", "run")
                     .agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("votes"), F.min("diag").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    tight = F.col("hi") - F.col("lo") < MAX_STRETCH * F.col("n_grams")
    spans = runs.withColumn("cover", F.col("votes") / F.col("n_grams")).withColumn("hit", F.when(
        F.col("is_base"), F.col("votes") == F.col("n_grams")).otherwise(
        (F.col("cover") >= MIN_COVER) & tight & (F.col("template") != END)))
    base = F.col("is_base") & F.col("hit")
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (spans.groupBy("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"))
                 .agg(F.count(F.when(base, 1)).alias("n_base"),
                      F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
                      F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
                      names(base).alias("base_labels"), names(F.col("hit")).alias("labels"),
                      F.max(F.when(F.col("hit"), F.col("cover")).otherwise(0.0)).alias("score"),
                      F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct(
                          "label", F.col("lo").cast("long").alias("first"), (F.col("hi") + 1).cast("long").alias("last"), "cover")))).alias("matches")))

"""License scans by diagonal voting, in DataFrame functions only.

Rolling word k-grams of every text are joined (by Spark, on their hash) to the places where
licence templates hold the same k-gram.  A match votes for its diagonal, the text place less
the template place.  Votes are summed by diagonal, neighbouring diagonals (a word put in or
left out) are merged, and a merged span counts if enough of its template's k-grams stand in
it.  Phrases are templates of two or three words that must match completely (k = 2); notices
are longer (k = ``NOTICE_K``) and may differ in places.  Words are compared with the
template's own, so a hash collision adds nothing.

Only matches are shuffled.  The template table has a fixed size and is broadcast.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows
(same id and text) get the same result each; null ids are kept apart by their texts; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def outside(*ranges: tuple[int, int]) -> str:
    """Runs of characters outside of ASCII ranges, each character named: Java looks those up in one table, and tries ranges one by one."""
    return "[^" + "".join(f"\\x{c:02X}" for low, high in ranges for c in range(low, high + 1)) + "]+"


#: Words: digits, a-z and everything beyond ASCII; and the same in either case.
WORD = outside((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ANY_CASE = outside((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

#: Phrases of the base scan and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices of public licences and their labels.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
PHRASE_K = 2
NOTICE_K = 3
#: Diagonals this close, and starting within this many words, merge into one span.
SLACK = 3
#: Least share of a notice's k-grams in a span.
COVERAGE = 0.7


def lowered(text: str = "text") -> Column:
    """A-Z in lower case.  Spark's ``lower`` also changes other letters, which keeps words whole;
    the two letters that it would turn into ASCII are replaced by non-ASCII ones first."""
    plain = F.coalesce(F.col(text), F.lit(""))
    for letter, other in (("\u212a", "\u0137"), ("\u0130", "\u0131")):
        plain = F.replace(plain, F.lit(letter), F.lit(other))
    return F.lower(plain)


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """One row per k-gram of each template; a few hundred rows."""
    rows = []
    every = [(label, phrase, PHRASE_K) for phrase, label in phrases.items()] + [(label, notice, NOTICE_K) for label, notice in notices]
    for number, (label, phrase, k) in enumerate(every):
        words = phrase.split()
        for at in range(len(words) - k + 1):
            gram = words[at : at + k] + [None] * (3 - k)
            rows.append((number, label, k == PHRASE_K, len(words) - k + 1, at, *gram))
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, t_at int, t0 string, t1 string, t2 string")
    return frame.withColumn("t_hash", F.xxhash64("t0", "t1"))


def matches(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Places (text, template, diagonal) where a k-gram of a text equals one of a template.

    The hash key covers the first two words; a notice's third word is compared with it.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all(lowered(), F.lit(WORD), F.lit(0)).alias("w"))
    # explode of one element keeps the optimizer from computing the words again for each use
    rows = rows.select("doc_id", "text_hash", F.explode(F.array("w")).alias("w"))
    n = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("w0"), F.slice("w", F.lit(2), n).alias("w1"), F.slice("w", F.lit(3), n).alias("w2"))
    grams = rows.select("doc_id", "text_hash", F.posexplode(zipped).alias("at", "g")).where("g.w1 is not null")
    grams = grams.select("doc_id", "text_hash", "at", F.xxhash64("g.w0", "g.w1").alias("hash"), "g.w0", "g.w1", "g.w2")
    same = (F.col("hash") == F.col("t_hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    same = same & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")))
    found = grams.join(F.broadcast(known), same)
    return found.select("doc_id", "text_hash", "template", "label", "base", "grams", (F.col("at") - F.col("t_at")).alias("diagonal"), "at", "t_at")


def spans(found: DataFrame) -> DataFrame:
    """Merged, verified spans: text, label, base, first word, coverage."""
    key = ["doc_id", "text_hash", "template", "label", "base", "grams"]
    once = found.groupBy(*key, "diagonal", "at", "t_at").agg(F.lit(1).alias("one"))  # repeated rows vote once
    votes = once.groupBy(*key, "diagonal").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("t_at").alias("held"))
    # phrases and notices take one way, so that the texts are read once: a phrase's diagonal stands alone and must hold all its k-grams
    ordered = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(ordered) <= SLACK
    near = ~F.col("base") & near & (F.col("lo") - F.lag("hi").over(ordered) <= NOTICE_K + SLACK)
    grouped = votes.withColumn("group", F.sum(F.when(near, 0).otherwise(1)).over(ordered))
    merged = grouped.groupBy(*key, "group").agg(F.min("lo").alias("start"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    # each template place counts once, so a span that repeats a part gains nothing
    coverage = F.size("held") / F.col("grams")
    whole = merged.withColumn("coverage", coverage).where(F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(COVERAGE))
    return whole.select("doc_id", "text_hash", "label", "base", "start", "coverage")


def scan(docs: DataFrame) -> DataFrame:
    """Words, base places, labels and score (the best span's coverage) of every document."""
    found = spans(matches(docs, templates(docs.sparkSession)))
    start = F.when(F.col("base"), F.col("start"))
    by_text = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.count(start).alias("n_base"), F.min(start).cast("long").alias("first_word"), F.max(start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(ANY_CASE)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words.alias("n_words"))
    out = rows.join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

"""License scans by diagonal voting: word k-grams that texts share with templates vote for where a template begins. Native
expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Words of a k-gram of a phrase, and of a notice.
SHORT, LONG = 2, 4
#: The share of a notice's words that a span must have; phrases must be there in full.
SHARE = 0.6
#: Words of a template at most: its positions are bits of a long.
MOST_WORDS = 64

#: Phrases (label, words).
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Notices (label, words), lower case without punctuation. The long ones are openings of the published texts.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that is not yet in lower case.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP_CHARS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def templates() -> list[dict]:
    """number, label, base, words, k, slack (how far neighbouring diagonals may lie apart), share."""
    out = []
    for base, listed in ((True, PHRASES), (False, NOTICES)):
        for label, text in listed:
            w = text.split()
            assert (SHORT if base else LONG) <= len(w) <= MOST_WORDS, text
            out.append({"number": len(out), "label": label, "base": base, "words": w, "k": SHORT if base else LONG, "slack": 0 if base else min(8, len(w) // 2), "share": 1.0 if base else SHARE})
    return out


def template_grams() -> list[tuple]:
    """number, label, base, n (words of the template), k, slack, share, j (place of the k-gram), gram (its words)."""
    return [(t["number"], t["label"], t["base"], len(t["words"]), t["k"], t["slack"], t["share"], j, t["words"][j : j + t["k"]]) for t in templates() for j in range(len(t["words"]) - t["k"] + 1)]


def license_words(text: Column) -> Column:
    t = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(GAP_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP))


def votes(docs: DataFrame) -> DataFrame:
    """A row for each place i at which the text has the k-gram that a template has at j. docs: doc_id, text_hash, text.

    Every rolling k-gram of both sizes is hashed and joined to the templates' ones, a fixed list that is broadcast; equal
    hashes count only if the words are equal. A text's words are split once; no k-gram is shuffled."""
    grams = docs.sparkSession.createDataFrame(template_grams(), "number int, label string, base boolean, n int, k int, slack int, share double, j int, gram array<string>")
    hashed = lambda w, i, k: F.xxhash64(*[F.get(w, i + d) for d in range(k)])
    of = lambda w, i, k: F.when(k == SHORT, hashed(w, i, SHORT)).otherwise(hashed(w, i, LONG))
    grams = grams.withColumn("key", of(F.col("gram"), F.lit(0), F.col("k")))
    words = docs.select("doc_id", "text_hash", license_words(F.col("text")).alias("w"))
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), 2 * F.size("w") - 1))
    each = words.select("doc_id", "text_hash", "w", F.explode(places).alias("x"))
    i, k = F.shiftright("x", 1), F.when(F.col("x") % 2 == 0, SHORT).otherwise(LONG)
    each = each.select("doc_id", "text_hash", "w", i.alias("i"), k.alias("size")).withColumn("at", of(F.col("w"), F.col("i"), F.col("size")))
    same = (F.col("at") == F.col("key")) & (F.slice("w", F.col("i") + 1, F.col("size")) == F.col("gram"))
    return each.join(F.broadcast(grams), same).select("doc_id", "text_hash", "i", "number", "label", "base", "n", "k", "slack", "share", "j")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, label, base, start, stop (words from 0, stop is not in it), part: where a template stands, and the
    share of its words that do.

    Votes add up by diagonal, i - j, as bits of the template's places; diagonals of a text and template that follow each other within
    the template's slack are one span, as words left out or put in move a template to a neighbouring diagonal. A span is kept
    if the words that its verified k-grams cover are the template's share or more."""
    own = ["doc_id", "text_hash", "number", "label", "base", "n", "k", "slack", "share"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    lines = votes(docs).groupBy(*own, (F.col("i") - F.col("j")).alias("diagonal")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.bit_or(bit).alias("bits"))
    by = W.partitionBy("doc_id", "text_hash", "number").orderBy("diagonal")
    lines = lines.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > F.col("slack")).cast("int"), F.lit(0)))
    lines = lines.withColumn("island", F.sum("new").over(by))
    merged = lines.groupBy(*own, "island").agg(F.min("lo").alias("start"), (F.max("hi") + F.first("k")).alias("stop"), F.bit_or("bits").alias("bits"))
    to = lambda d: F.call_function("shiftleft", F.col("bits"), F.lit(d))
    covered = F.when(F.col("k") == SHORT, F.bit_count(F.col("bits").bitwiseOR(to(1)))).otherwise(F.bit_count(F.col("bits").bitwiseOR(to(1)).bitwiseOR(to(2)).bitwiseOR(to(3))))
    merged = merged.withColumn("part", covered / F.col("n")).where("part >= share")
    return merged.select("doc_id", "text_hash", "label", "base", "start", "stop", "part")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Words are runs of digits, letters and characters beyond ASCII of the whole text, A-Z in lower case. n_base counts the
    places of the phrases, first_word and last_word are the first and the last of them, null if there are none; labels are
    those of phrases and notices; score is the greatest share of a template that a span has, 0 without any. A null or empty
    text has no words; rows with one id, or none, are judged by their own text, rows that repeat alike; an empty table gives
    no rows; other columns play no part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.lit(1)).alias("text_hash"), "text")
    when = lambda c: F.when(F.col("base"), F.col(c))
    told = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(rows).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.count_if("base").alias("n_base"), F.min(when("start")).alias("first_word"), F.max(when("start")).alias("last_word"), told(when("label")).alias("base_labels"), told(F.col("label")).alias("labels"), F.max("part").alias("score")
    )
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(CASED_WORD))).cast("long").alias("n_words")
    rows = rows.select("doc_id", "text_hash", n).join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return rows.select("doc_id", "n_words", none("n_base", 0), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), none("base_labels", ""), none("labels", ""), none("score", 0.0))

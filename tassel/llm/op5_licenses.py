"""License scans by diagonal voting: word k-gram hashes joined to template positions, in Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases; a place is where all their words stand consecutively.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Longer wordings, (label, words); a text carries the label if it holds most of the wording.
WORDINGS = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-released", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 3
#: Diagonals of a wording at most so far apart are one span: words left out or put in shift the diagonal.
GAP = 3
#: Share of a wording's k-grams that makes the label.
SHARE = 0.8


def templates(base: dict[str, str] = BASE, wordings: list[tuple[str, str]] = WORDINGS) -> list[tuple]:
    """(template, label, base, place, k-grams of the template, k, words of the k-gram); at most 63 k-grams each."""
    out = []
    entries = [(p, label, True) for p, label in base.items()] + [(p, label, False) for label, p in wordings]
    for n, (phrase, label, is_base) in enumerate(entries):
        words = phrase.split()
        k = len(words) if is_base else K
        count = len(words) - k + 1
        if not 1 <= count <= 63 or k not in (2, 3):
            raise ValueError(f"cannot search for {phrase!r}")
        out += [(n, label, is_base, i, count, k, " ".join(words[i : i + k])) for i in range(count)]
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _places(spark: SparkSession, rows: list[tuple], k: int) -> DataFrame:
    """One row for each k-gram hash, with all template positions of it."""
    table = spark.createDataFrame(
        [r for r in rows if r[5] == k] or [(0, "", False, 0, 1, k, "")],
        "template int, label string, base boolean, place int, grams int, k int, gram string",
    )
    parts = F.split("gram", " ")
    return table.groupBy(F.xxhash64(*[F.get(parts, i) for i in range(k)]).alias(f"_h{k}")).agg(
        F.collect_list(F.struct("template", "label", "base", "place", "grams", "gram")).alias(f"_found{k}")
    )


def license_votes(docs: DataFrame, keep: list[str], rows: list[tuple]) -> DataFrame:
    """(_row, keep, n_words, template, label, base, grams, diagonal, places as bits), and a row without template
    for each document. All word k-grams are hashed and joined to the template positions; a hit counts if its
    words are the template's."""
    spark = docs.sparkSession
    text = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, words_of(F.col("text")).alias("_w"))
    n = F.size("_w")
    shifted = F.arrays_zip(
        F.col("_w").alias("w1"), F.slice("_w", F.lit(2), n).alias("w2"), F.slice("_w", F.lit(3), n).alias("w3")
    )
    grams = text.select("_row", *keep, n.cast("long").alias("n_words"), F.posexplode_outer(shifted).alias("_pos", "_g"))
    grams = grams.select("_row", *keep, "n_words", "_pos", F.col("_g.w1").alias("_1"), F.col("_g.w2").alias("_2"), F.col("_g.w3").alias("_3"))
    grams = grams.withColumns({"_k2": F.xxhash64("_1", "_2"), "_k3": F.xxhash64("_1", "_2", "_3")})
    # a row or less for each k-gram of the templates, which are part of the program
    hits = grams.join(F.broadcast(_places(spark, rows, 3)), F.col("_k3") == F.col("_h3"), "left").join(
        F.broadcast(_places(spark, rows, 2)), F.col("_k2") == F.col("_h2"), "left"
    )
    first = F.coalesce(F.col("_pos") == 0, F.lit(True))
    hits = hits.filter(F.col("_h3").isNotNull() | F.col("_h2").isNotNull() | first)
    three = F.filter("_found3", lambda x: x["gram"] == F.concat_ws(" ", "_1", "_2", "_3"))
    two = F.filter("_found2", lambda x: x["gram"] == F.concat_ws(" ", "_1", "_2"))
    empty = F.array().cast(_KIND)
    both = F.concat(F.coalesce(three, empty), F.coalesce(two, empty))
    votes = hits.select("_row", *keep, "n_words", "_pos", F.explode_outer(both).alias("_v"))
    votes = votes.filter(F.col("_v").isNotNull() | F.coalesce(F.col("_pos") == 0, F.lit(True)))
    return votes.groupBy(
        "_row",
        *keep,
        "n_words",
        F.col("_v.template").alias("template"),
        F.col("_v.label").alias("label"),
        F.col("_v.base").alias("base"),
        F.col("_v.grams").alias("grams"),
        (F.col("_pos") - F.col("_v.place")).alias("diagonal"),
    ).agg(F.bit_or(F.expr("shiftleft(1L, _v.place)")).alias("places"))


_KIND = "array<struct<template:int,label:string,base:boolean,place:int,grams:int,gram:string>>"


def license_spans(docs: DataFrame, keep: list[str], rows: list[tuple] | None = None, share: float = SHARE) -> DataFrame:
    """(_row, keep, n_words, template, label, base, start, end, coverage) of each span of a template, and a row without template for
    each document.

    Neighbouring diagonals of one wording (``GAP`` words apart at most) are one span; its coverage is the share
    of the wording's k-grams found there. A base phrase is a place only in full.
    """
    votes = license_votes(docs, keep, rows or templates())
    near = Window.partitionBy("_row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    apart = F.when(F.col("base") | gap.isNull() | (gap > GAP), 1).otherwise(0)
    cut = votes.withColumn("_new", apart).withColumn("_span", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut.groupBy("_row", *keep, "n_words", "template", "label", "base", "grams", "_span").agg(
        F.min("diagonal").alias("start"), F.max("diagonal").alias("_last"), F.bit_or("places").alias("_places")
    )
    coverage = F.bit_count("_places") / F.col("grams")
    return spans.withColumn("coverage", coverage).filter(
        F.col("template").isNull() | ~F.col("base") | (F.col("coverage") == 1)
    )


def scan_licenses(docs: DataFrame, keep: list[str], share: float = SHARE) -> DataFrame:
    """One row for each document: ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty; repeated rows each get a row (rows are told apart by their place in the input, so the
    input must read the same each time, as files do). ``score`` is the largest share of any template found.
    Long texts and texts with very many spans are spread by k-gram and summed before the shuffle.
    """
    spans = license_spans(docs, keep, share=share)
    base, own = F.col("base") & F.col("template").isNotNull(), ~F.col("base") & (F.col("coverage") >= share)
    label_list = lambda found: F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",")
    return (
        spans.groupBy("_row", *keep, "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            label_list(base).alias("base_labels"),
            label_list(base | own).alias("labels"),
            F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
    )

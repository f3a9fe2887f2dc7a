"""License scans by diagonal voting.

All word k-grams of all texts are joined, by hash, to the places where license
templates have them. A hit votes for the diagonal text place minus template
place. A template that stands in a text whole fills one diagonal; with words put
in or left out it fills neighbouring ones, which are merged. What a merged
diagonal covers is held against the template's length.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import content_key
from trackloom.session import cut_lineage

K = 3
# Diagonals so near to each other are one place.
NEIGHBOURS = 4
# Share of its k-grams that a place must cover of a template with LONG or more;
# a shorter one must be covered whole.
COVERED, LONG = 0.6, 16

# Fixed values of the query: phrase, label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Templates of the method: opening words of public licenses and their usual notices.
TEMPLATES = [
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the mozilla public license", "mpl"),
    ("licensed under the bsd license", "bsd"),
    ("licensed under the creative commons attribution license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of a-z, 0-9 and non-ASCII characters."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int = K) -> DataFrame:
    """template, label, whole, grams, at, gram of every k-gram; as many rows as the
    templates have words."""
    rows = []
    for number, (text, label, whole) in enumerate(templates):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
        rows += [(number, label, whole, len(grams), i, gram) for i, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, whole boolean, grams int, at int, gram string")


def places(docs: DataFrame, templates: list[tuple[str, str, bool]], k: int = K, neighbours: int = NEIGHBOURS) -> DataFrame:
    """_key (digest of a row's id and text), label, whole, start, end (words), grams, share
    of every place where a template was hit: each full diagonal of a template that
    must stand whole, and each group of neighbouring diagonals of the others."""
    grams = F.broadcast(template_grams(docs.sparkSession, templates, k).withColumn("hash", F.xxhash64("gram")))
    split = docs.select(content_key("doc_id", "text").alias("_key"), words_of(F.col("text")).alias("w"))
    rolled = F.when(F.size("w") >= k, F.transform(
        F.sequence(F.lit(0), F.size("w") - k), lambda i: F.concat_ws(" ", *[F.get("w", i + n) for n in range(k)])))
    # The outer form: the inner one would filter on the size of g before its words are split once.
    rows = split.select("_key", rolled.alias("g")).select("_key", F.posexplode_outer("g").alias("pos", "words"))
    hits = (rows.withColumn("hash", F.xxhash64("words")).join(grams, "hash").where("words = gram")
            .select("_key", "template", "label", "whole", "grams", "at", (F.col("pos") - F.col("at")).alias("diagonal")))
    # Equal rows share a key, so a vote is a distinct template place.
    votes = hits.groupBy("_key", "template", "label", "whole", "grams", "diagonal").agg(
        F.count_distinct("at").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    votes = cut_lineage(votes)
    full = votes.where("whole and votes = grams").select(
        "_key", "label", "whole", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("grams") + k - 1).alias("end"),
        "grams", F.lit(1.0).alias("share"))
    by = W.partitionBy("_key", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > neighbours).cast("int"), F.lit(0))
    grouped = votes.where("not whole").withColumn("gap", gap).withColumn("group", F.sum("gap").over(by))
    merged = grouped.groupBy("_key", "template", "label", "whole", "grams", "group").agg(
        F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("start"),
        F.max(F.col("diagonal") + F.col("high") + k).alias("end"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"), F.col("grams") / (F.col("end") - F.col("start") - k + 1))
    return full.unionByName(merged.select("_key", "label", "whole", "start", "end", "grams", share.alias("share")))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
         covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    of every row.

    A null text is empty. Equal rows get equal results; an empty table gives an
    empty result; other columns are not read. score is the best share of a template
    that was found, 1 for a whole phrase, 0 for none.
    """
    every = [(t, label, True) for t, label in phrases] + [(t, label, False) for t, label in templates]
    found = places(docs, every)
    good = F.col("share") >= F.when(F.col("grams") < LONG, 1.0).otherwise(covered)

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    by_key = cut_lineage(found.groupBy("_key").agg(
        F.count_if("whole").alias("n_base"), F.min(F.when(F.col("whole"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("start"))).cast("long").alias("last_word"), labels(F.col("whole")).alias("base_labels"),
        labels(good).alias("labels"), F.max("share").alias("score")))
    rows = docs.select("doc_id", content_key("doc_id", "text").alias("_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(by_key, "_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

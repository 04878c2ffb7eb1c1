"""License scans by diagonal voting.

All two-word grams of all texts are joined with the grams of the templates; a hit at text word p and template word q votes
for the diagonal p - q. Votes are counted for each document, template and diagonal before the shuffle. A phrase stands where its
diagonal has the votes of all its grams. For the longer templates diagonals that are at most ``SLACK`` words apart merge,
so a few words put in or left out do not break a match, and a span counts when it has at least ``COVERAGE`` of
the template's votes within ``STRETCH`` times its length. The join compares hashes first and then the words themselves,
so no vote comes from a hash collision.

Only DataFrame and SQL functions are used. The templates are fixed values of this module, so the side that is broadcast
does not grow. Each document also sends one marker, so that those without a hit stay in the result and no text is read twice.

Words are runs of letters, digits and non-ASCII characters, A-Z in small letters. Null and empty texts have no words.
Rows that repeat id and text are counted together and given out as often as they came. A document of one word has no gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from moteflow.llm.common import ALNUM, lower_ascii

SLACK, COVERAGE, STRETCH = 3, 0.7, 1.5
#: Phrases that count wherever they stand, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening words of well-known licenses and the usual one-line notices, with their labels.
TEMPLATES = {
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-text",
    "this program is free software you can redistribute it and or modify it under the terms of the": "gpl-text",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark: SparkSession) -> DataFrame:
    """(h, one, two, template, q): every gram of every template, and the marker of documents as template -1."""
    rows = [(-1, 0, None, None)]
    for t, text in enumerate([*PHRASES, *TEMPLATES]):
        words = text.encode().translate(ALNUM).decode().split()
        rows += [(t, q, a, b) for q, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    df = spark.createDataFrame(rows, "template int, q int, one string, two string")
    return df.withColumn("h", F.when(F.col("template") >= 0, F.xxhash64("one", "two")).otherwise(F.lit(0).cast("long")))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, n_words, template, diagonal, votes, low, high) over all texts; template -1 has a vote for each row."""
    words = docs.select("doc_id", F.xxhash64("text", F.lit(1)).alias("a"), F.xxhash64(F.lit(2), "text").alias("b"),
                        F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w").cast("long")
    grams = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0)).cast("int")), lambda x, y: F.xxhash64(x, y))
    marked = words.select("doc_id", "a", "b", n.alias("n_words"), "w", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), grams)).alias("i", "h"))
    t = F.broadcast(template_grams(docs.sparkSession))
    same = (marked["h"] == t["h"]) & (((t["template"] == -1) & (marked["i"] == 0))
                                      | ((F.get("w", F.col("i") - 1) == t["one"]) & (F.get("w", "i") == t["two"])))
    hits = marked.join(t, same).select("doc_id", "a", "b", "n_words", "template", (F.col("i") - 1 - F.col("q")).alias("diagonal"), (F.col("i") - 1).alias("p"))
    return hits.groupBy("doc_id", "a", "b", "n_words", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans): spans of struct(template, label, base, first, last, coverage) in words, both ends included."""
    spark = docs.sparkSession
    key = ["doc_id", "a", "b", "n_words"]
    names = spark.createDataFrame([(t, label, text in PHRASES, len(text.split()) - 1) for t, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()])],
                                  "template int, label string, base boolean, need int")
    all_votes = votes(docs)
    times = Window.partitionBy(*key)
    copies = F.max(F.when(F.col("template") == -1, F.col("votes"))).over(times)
    cast = all_votes.withColumn("copies", copies).withColumn("votes", (F.col("votes") / F.col("copies")).cast("int")).join(F.broadcast(names), "template", "left")
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK), 1).otherwise(0)
    runs = cast.withColumn("step", apart).withColumn("run", F.sum("step").over(order))
    merged = runs.groupBy(*key, "copies", "template", "label", "base", "need", "run") \
        .agg(F.sum("votes").alias("votes"), F.min("low").alias("first"), (F.max("high") + 1).alias("last"))
    right = F.when(F.col("base"), F.col("votes") == F.col("need")) \
        .otherwise((F.col("votes") >= COVERAGE * F.col("need")) & (F.col("last") - F.col("first") <= STRETCH * (F.col("need") + 1)))
    span = F.when(right, F.struct("template", "label", "base", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"),
                                  F.least(F.lit(1.0), F.col("votes") / F.col("need")).alias("coverage")))
    return merged.groupBy(*key, "copies").agg(F.sort_array(F.collect_list(span)).alias("spans")) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "n_words", "spans")

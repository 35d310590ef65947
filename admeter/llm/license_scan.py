"""License scans by diagonal voting, in DataFrame operations only.

1. Every pair of neighbouring words of every text, as a 64-bit hash, is joined to the places of that pair in
   the templates (a fixed table of a few hundred rows).  The words themselves are compared too, so a vote
   is never a hash collision.
2. A vote counts for the diagonal ``place in text - place in template``; votes are summed by text,
   template and diagonal.
3. Diagonals that lie at most ``NEAR`` words apart are merged, so that a few inserted or missing words don't
   split a passage.
4. A merged span is verified by the share of the template's pairs that it holds (``SHARE``), and by the words that tell the
   notice from others like it, whose pairs must all be there; a base phrase stands where all its pairs vote for
   one diagonal.

Fixed meaning of edge cases: a null text is empty and has no words; each input row gives one row, repeated ids
and rows included (votes are kept by id and hash of the text); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices that the method looks for beside the base phrases, their labels, and the words that tell them from like notices.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", "apache license"),
    ("licensed under the gnu general public license version 3", "gpl", "gnu general public license"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser general public"),
    ("licensed under the gnu affero general public license", "agpl", "gnu affero general public"),
    ("licensed under the terms of the mit license", "mit", "mit license"),
    ("licensed under the terms of the bsd license", "bsd", "bsd license"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "associated documentation files"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "source and binary forms"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
)
#: Words between two diagonals of one passage, at most; the share of a notice's pairs that a span must hold.
NEAR, SHARE = 3, 0.6
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case.  ``lower`` leaves word borders as they are; the one other character that it
    turns into an ASCII letter, the Kelvin sign, is replaced first."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(low, SEPARATOR), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Each pair of neighbouring words with its place."""
    last = F.size(words) - 2
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(
        i.alias("place"), F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)).alias("pair")))


def phrases() -> list[tuple[str, str, bool, int, int]]:
    """(phrase, label, is_base, first and last place of the pairs that must be held) of all templates."""
    out = [(phrase, label, True, 0, len(phrase.split()) - 2) for phrase, label in BASE]
    for phrase, label, telling in NOTICES:
        before = phrase[:phrase.index(telling)].split()
        out.append((phrase, label, False, len(before), len(before) + len(telling.split()) - 2))
    return out


def templates(spark: SparkSession) -> DataFrame:
    """Rows (template, label, is_base, pairs, tells, told, at, t_hash, t_pair): the places of each pair in each template."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("is_base"), F.lit(len(phrase.split()) - 1).alias("pairs"),
                 F.lit(first).alias("tells"), F.lit(last).alias("told"), F.lit(phrase).alias("phrase"))
        for n, (phrase, label, base, first, last) in enumerate(phrases())])
    each = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    columns = ["template", "label", "is_base", "pairs", "tells", "told"]
    placed = each.select(*columns, F.explode(pairs_of(F.split("phrase", " "))).alias("p"))
    return placed.select(*columns, F.col("p.place").alias("at"), F.xxhash64("p.pair").alias("t_hash"), F.col("p.pair").alias("t_pair"))


def votes(docs: DataFrame) -> DataFrame:
    """Rows (k, h, template, label, is_base, pairs, tells, told, diagonal, at, place) of all pairs that a template has too."""
    rows = docs.select("k", "h", F.explode(pairs_of(F.col("words"))).alias("p"))
    hashed = rows.select("k", "h", "p.place", "p.pair", F.xxhash64("p.pair").alias("hash"))
    table = F.broadcast(templates(docs.sparkSession))  # fixed constants
    found = hashed.join(table, (F.col("hash") == F.col("t_hash")) & (F.col("pair") == F.col("t_pair")))
    return found.select("k", "h", "template", "label", "is_base", "pairs", "tells", "told", (F.col("place") - F.col("at")).alias("diagonal"), "at", "place")


def spans(found: DataFrame) -> DataFrame:
    """Merged and verified spans: (k, h, label, is_base, first, last, share)."""
    keys = ["k", "h", "template", "label", "is_base", "pairs", "tells", "told"]
    diagonals = found.groupBy(*keys, "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("first"), (F.max("place") + 1).alias("last"))
    order = Window.partitionBy("k", "h", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    passage = F.sum(F.when((gap <= NEAR) & ~F.col("is_base"), 0).otherwise(1)).over(order)
    merged = diagonals.withColumn("passage", passage).groupBy(*keys, "passage").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("held"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.size("held") / F.col("pairs")
    told = F.size(F.filter("held", lambda at: at.between(F.col("tells"), F.col("told")))) == F.col("told") - F.col("tells") + 1
    return merged.where((share >= F.when(F.col("is_base"), 1.0).otherwise(SHARE)) & told).select(
        "k", "h", "label", "is_base", "first", "last", share.alias("share"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``, the largest verified share."""
    docs = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), words_of(F.col(text)).alias("words"))
    base = F.col("is_base")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = spans(votes(docs)).groupBy(F.col("k").alias("found_k"), F.col("h").alias("found_h")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("share").alias("score"))
    counted = docs.select("k", "h", F.size("words").cast("bigint").alias("n_words"))
    both = counted.join(found, F.col("k").eqNullSafe(F.col("found_k")) & (F.col("h") == F.col("found_h")), "left")
    return both.select(
        F.col("k").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

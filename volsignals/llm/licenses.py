"""License scan by diagonal voting (DataFrame functions only).

Every run of ``K`` words of a document is joined by hash to the places where it stands in a
template; the words themselves are compared in the join. Runs whose words stand in no template at
their place in a run are left out before they become rows: one pass over the texts makes the words
once, counts them and keeps the runs that may hit. A hit votes for the diagonal (template, place in
the document less place in the template). A diagonal with the votes of all places is the whole
template word for word. Diagonals that lie within ``NEAR`` words of each other, as after a word put
in or left out, are merged. A merged span is verified by going through its hits in the order of the
document: those that stand in the template's order too must cover ``COVER`` of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsignals.llm.common import stored, whole_text

K = 3
NEAR = 2
COVER = 0.6

#: Words before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that name a license wherever their words stand together.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Templates that may be met with words changed; of any length.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _candidates(words: Column, rows: list[tuple]) -> Column:
    """Place and text of the runs of which every word stands at its place in some template's run.

    Lower-casing beyond A-Z lets too many runs pass, never too few; the join compares them exactly.
    """
    at = [sorted({r[-1].split()[j] for r in rows}) for j in range(K)]

    def run(word: Column, i: Column) -> Column:
        each = [word, *[F.get(words, i + j) for j in range(1, K)]]
        hit = F.lower(each[0]).isin(at[0])
        for w, known in zip(each[1:], at[1:], strict=True):
            hit = hit & F.lower(w).isin(known)
        return F.when(hit, F.struct(i.cast("long").alias("pos"), F.concat_ws(" ", *each).alias("run")))

    return F.filter(F.transform(words, run), lambda x: x.isNotNull())


def _template_rows(templates: list[tuple[str, str]], base: int) -> list[tuple]:
    """One row per place of every template. The list is a parameter, so its size is known."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        for at in range(len(words) - K + 1):
            rows.append((number, label, number < base, len(words), at, " ".join(words[at : at + K])))
    return rows


_TEMPLATE = "template int, label string, base boolean, n int, at long, template_run string"


def scan(
    docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES
) -> DataFrame:
    """Licenses found in each row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest
    and largest start of one, else null), base_labels, labels (all; both distinct, sorted and
    joined by commas), score (share of the best template found; 1 for a base phrase), spans
    (label, start, end in words, from the first hit to the last). Null and empty texts have 0 words and empty labels; repeated
    rows get the same values each; an empty table gives an empty table; other columns are left out.
    """
    spark = docs.sparkSession
    places = _template_rows([*base, *templates], len(base))
    own = spark.createDataFrame(places, _TEMPLATE).withColumn("template_gram", F.xxhash64("template_run"))
    # the words as a column of their own: inside the lambda an expression would run for each word
    words = docs.select("doc_id", F.regexp_extract_all(whole_text(), F.lit(WORD), 0).alias("words"))
    seen = words.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), _candidates(F.col("words"), places).alias("runs"),
        F.monotonically_increasing_id().alias("row"),
    )
    seen = stored(seen, "runs")  # without the texts; row numbers are fixed here
    grams = seen.filter(F.size("runs") > 0).select("row", F.inline("runs")).withColumn("run", _low(F.col("run")))
    hits = grams.join(
        F.broadcast(own),
        (F.xxhash64("run") == F.col("template_gram")) & (F.col("run") == F.col("template_run")),
    )
    kind = ["row", "template", "label", "base", "n"]
    hits = hits.select(*kind, "pos", "at", (F.col("pos") - F.col("at")).alias("start"))
    # neighbouring diagonals: a new span begins where the next one is more than NEAR words on
    diagonals = hits.groupBy(*kind, "start").agg(F.count(F.lit(1)).alias("votes"))
    along = Window.partitionBy("row", "template").orderBy("start")
    new = F.col("start") - F.coalesce(F.lag("start").over(along), F.col("start") - NEAR - 1) > NEAR
    merged = diagonals.withColumn("span", F.sum(F.when(F.col("base") | new, 1).otherwise(0)).over(along))
    merged = merged.select("row", "template", "start", "span")
    # a hit is in order if no earlier one stands at its place of the template or behind it
    inside = Window.partitionBy("row", "template", "span").orderBy("pos", "at")
    ahead = F.max("at").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ordered = hits.join(merged, ["row", "template", "start"]).withColumn(
        "in_order", F.coalesce(F.col("at") > ahead, F.lit(True)).cast("int")
    )
    spans = (
        ordered.groupBy(*kind, "span")
        .agg(F.min("pos").alias("start"), (F.max("pos") + K).alias("end"), F.sum("in_order").alias("covered"))
        .withColumn("cover", F.col("covered") / (F.col("n") - K + 1))
        .filter(F.when(F.col("base"), F.col("cover") == 1).otherwise(F.col("cover") >= COVER))
    )
    mine = F.when(F.col("base"), F.col("label"))
    found = spans.groupBy("row").agg(
        F.count(mine).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(mine)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(
            F.collect_list(F.struct("label", "start", "end"))
        ).alias("spans"),
    )
    out = seen.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )

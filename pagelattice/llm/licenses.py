"""License scan by diagonal voting.

Rolling word grams of every text are hashed and joined to the places of the same grams in license
templates. A match of text position p with template position t votes for the diagonal p - t: the
words of a license text stand on one diagonal, wherever it was pasted. Votes are added up per
diagonal before the shuffle's final step, neighbouring diagonals (words added or left out) are
merged, and a merged run counts if its verified grams cover enough of the template within a span
of about its length. Short phrases use 2-grams and must be covered whole, on one diagonal; so every
place of a phrase is found, and nothing else. Built-in functions only.

Null and word-less texts have no match. Repeated rows give one result row each; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelattice.llm.grams import gram_hits

PHRASE_GRAM = 2
TEMPLATE_GRAM = 3
#: Diagonals this near are one run.
DRIFT = 3
#: Share of a template's grams that must be found.
COVERAGE = 0.6

#: Phrases that name a license, with its label.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices that license texts ask to be copied, with the label of the license.
TEMPLATES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(``template``, ``label``, ``base``, ``total``, ``length``, ``at``, ``gram``): each gram of each template."""
    rows = [{"text": t, "label": lab, "k": PHRASE_GRAM, "base": True} for t, lab in phrases]
    rows += [{"text": t, "label": lab, "k": TEMPLATE_GRAM, "base": False} for t, lab in templates]
    rows = [r | {"template": i} for i, r in enumerate(rows)]
    source = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<template:int,text:string,label:string,k:int,base:boolean>>"))
    )
    cut = source.withColumn("words", F.split("text", " "))
    return cut.select(
        "template", "label", "base",
        F.expr("size(words) - k + 1").alias("total"),
        F.size("words").alias("length"),
        F.posexplode(F.expr("transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))")).alias("at", "gram"),
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, phrase places, their labels, all labels, ``score``, ``spans``.

    ``score`` is 1 if a phrase stands in the text, else the best coverage of a template.
    """
    spark = docs.sparkSession
    hits = gram_hits(docs, id_col, text_col, template_grams(spark, phrases, templates), [PHRASE_GRAM, TEMPLATE_GRAM])
    votes = hits.groupBy("id", "mark", "n_words", "template", "label", "base", "total", "length", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("size")).alias("last")
    )
    # Runs of neighbouring diagonals; a phrase's diagonal stands alone.
    per = "partition by id, mark, template order by diagonal"
    runs = votes.withColumn("gap", F.expr(f"diagonal - lag(diagonal) over ({per})")).withColumn(
        "run", F.expr(f"if(base, diagonal, sum(if(gap <= {DRIFT}, 0, 1)) over ({per}))")
    )
    merged = runs.groupBy("id", "mark", "n_words", "template", "label", "base", "total", "length", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("votes").alias("copies"),
    )
    cover = F.when(F.col("base"), F.when(F.col("covered") == F.col("total"), 1.0).otherwise(0.0)).otherwise(
        F.col("covered") / F.greatest("total", (F.col("last") - F.col("first")) / 2)
    )
    merged = merged.withColumn("cover", F.when(F.col("template").isNull(), F.lit(0.0)).otherwise(cover))
    # Equal rows vote together: their number is that of the rows without a match position.
    phrase = F.col("base") & (F.col("cover") == 1.0)
    good = F.coalesce(phrase | (~F.col("base") & (F.col("cover") >= COVERAGE)), F.lit(False))
    joined = lambda condition: F.concat_ws(",", F.array_sort(F.collect_set(F.when(condition, F.col("label")))))
    return (
        merged.groupBy("id", "mark", "n_words")
        .agg(
            F.count(F.when(phrase, 1)).alias("n_base"),
            F.min(F.when(phrase, F.col("first"))).cast("bigint").alias("first_word"),
            F.max(F.when(phrase, F.col("first"))).cast("bigint").alias("last_word"),
            joined(phrase).alias("base_labels"),
            joined(good).alias("labels"),
            F.max(F.when(good, F.col("cover")).otherwise(F.when(~F.col("base"), F.col("cover")).otherwise(0.0))).alias("score"),
            F.array_sort(F.collect_set(F.when(good, F.struct("first", "last", "label", "cover")))).alias("spans"),
            F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        )
        .select(
            F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
            F.least(F.col("score"), F.lit(1.0)).alias("score"), "spans", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy"),
        )
        .drop("copy")
    )

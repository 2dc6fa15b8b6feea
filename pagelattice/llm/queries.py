"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelattice.llm import chat, decontaminate, filter_audit, licenses, lines, neardup, packing, repetition, runs, sharding, toxicity, url_rules, weighted
from pagelattice.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHARDS = 40


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_decontamination(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op3_license_scan(spark, sf):
    return licenses.license_scan(table(spark, sf, "documents")).drop("spans")


@query
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))


@query
def op5_repetition_rules(spark, sf):
    return repetition.repetition_rules(table(spark, sf, "documents"))


@query
def op6_ring_sharding(spark, sf):
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return sharding.assign(sized, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op7_near_duplicates(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"), shingle=3, percent=85)


@query
def op8_url_rules(spark, sf):
    return url_rules.url_verdicts(table(spark, sf, "pages"))


@query
def op9_chat_windows(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
    ).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", said.alias("text"))
    formatted = chat.windows(chat.turns(rows.unionByName(extra)))
    read = formatted.select("conv", F.char_length("formatted").alias("chars"), chat.turns_of_window().alias("turns"), chat.loss_of_window().alias("losses"))
    each = read.groupBy("conv").agg(
        F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"),
        F.array_sort(F.flatten(F.collect_list("losses"))).alias("losses"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    newline = F.lit("\n")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    trained = F.array_join(F.transform("losses", lambda t: t["text"]), "")
    return each.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(trained).cast("bigint").alias("loss_chars"), F.sha2(trained.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


@query
def op10_line_chunks(spark, sf):
    return lines.drop_repeated_chunks(table(spark, sf, "documents"))


@query
def op11_fingerprints(spark, sf):
    return weighted.edit_likeness(table(spark, sf, "documents"))


@query
def op12_periodic_runs(spark, sf):
    found = runs.collapse_runs(with_periods(table(spark, sf, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("longest", longest)
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which the words of every tenth document, by a hash of the id, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)"))
    docs = docs.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, size(words) - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


@query
def op13_filter_audit(spark, sf):
    return filter_audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))

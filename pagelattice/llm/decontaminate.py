"""Benchmark decontamination: windows of benchmark words looked up in whole training texts.

All windows of ``window`` consecutive words of the benchmark items (a shorter item is one window)
form a hash set, broadcast while its counted rows and bytes stay under the limits; beyond, the hashes
alone are joined by shuffle. Every window of every text is looked up, hits are verified on the words, overlapping hits
are merged into spans, and spans or whole documents are removed. Built-in functions only.

Null texts and texts without words have no hit. Items without words give no window; an item without
id still hits but is not listed. Repeated rows give one result row each. Empty tables on either side
give no hit. Extra columns pass through the removal untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions.binding import let
from pagelattice.llm.common import small
from pagelattice.llm.grams import gram_hits, words
from pagelattice.session import cut_lineage


def benchmark_windows(benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(``gram``, ``items``): each distinct window with the items it comes from."""
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where("size(words) > 0")
    starts = F.expr(f"sequence(1, greatest(size(words) - {window - 1}, 1))")
    grams = cut.select("item", "words", F.explode(starts).alias("at")).select(
        "item", F.expr(f"slice(words, at, {window})").alias("gram")
    )
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``mark``, ``n_words``, ``spans`` of hit words, ``n_hit``, ``items``."""
    grams = cut_lineage(benchmark_windows(benchmark, window))
    # At most ``window`` different lengths.
    sizes = sorted((r[0] for r in grams.select(F.size("gram")).distinct().collect()), reverse=True) or [window]
    hits = gram_hits(docs, id_col, text_col, grams, sizes)
    merged = hits.groupBy("id", "mark", "n_words").agg(
        F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.count(F.when(F.col("pos").isNull(), 1)).alias("copies"),
    )
    spans = let(F.expr("array_sort(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.end - 1)))))"), _runs)
    total = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return (
        merged.withColumn("spans", spans)
        .withColumn("n_hit", total)
        .select("id", "mark", "n_words", "spans", "n_hit", "items", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy"))
        .drop("copy")
    )


def _runs(at: Column) -> Column:
    """Stretches of consecutive numbers in a sorted array, as (``start``, ``end``)."""
    starts = F.filter(at, lambda n, i: F.coalesce(F.get(at, i - 1) < n - 1, F.lit(True)))
    ends = F.filter(at, lambda n, i: F.coalesce(F.get(at, i + 1) > n + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    hit = contamination(docs, benchmark, window, id_col, text_col).where("n_hit > 0").select(
        F.col("id").alias("_hit_id"), F.col("mark").alias("_hit_mark")
    ).distinct()
    # Its rows are counted before it is broadcast; the texts then stay in place.
    hit = small(cut_lineage(hit))
    same = F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text_col, F.octet_length(text_col)) == F.col("_hit_mark"))
    return docs.join(hit, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out of their texts, each with what follows it up to the next word."""
    hit = contamination(docs, benchmark, window, id_col, text_col).where("n_hit > 0").select(
        F.col("id").alias("_hit_id"), F.col("mark").alias("_hit_mark"), F.col("spans").alias("_spans")
    ).dropDuplicates(["_hit_id", "_hit_mark"])
    same = F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text_col, F.octet_length(text_col)) == F.col("_hit_mark"))
    marked = docs.join(hit, same, "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(text_col, f"^({gap})", 1)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{word}{gap}"), F.lit(0))
    kept = F.filter(pieces, lambda piece, i: ~F.exists(F.col("_spans"), lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, "")))
    return marked.withColumn(text_col, cut).drop("_hit_id", "_hit_mark", "_spans")

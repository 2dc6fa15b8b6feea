"""Word n-grams of texts held against a small gram table, with built-in functions only.

Texts are cut into words, all grams of the asked sizes are hashed, and the hashes are exploded and
looked up. A hash match counts only if the words are the same. While the gram table is small by
counted rows and bytes it is broadcast and all happens in one pass: no text is shuffled. Beyond that the
hashes alone are joined by shuffle, hot ones spread, and the texts with a match are visited once more to
take the words from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.llm.common import BROADCAST_BYTES, BROADCAST_ROWS
from pagelattice.operators.skew import skew_join

#: Words of a text whose grams are exploded from one row, so that a row of a long text stays narrow.
BLOCK = 512

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def gram_hashes(name: str, size: int) -> Column:
    """Hash of every run of ``size`` words in the array column ``name``, of a block those that start in it."""
    return F.expr(
        f"if(size({name}) >= {size}, transform(sequence(1, greatest(least(size({name}) - {size - 1}, {BLOCK}), 1)), "
        f"i -> xxhash64(slice({name}, i, {size}))), cast(array() as array<bigint>))"
    )


def _blocks(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(``id``, ``mark``, ``n_words``, ``start``, ``words``): texts in blocks that overlap by a gram less a word."""
    cut = texts.select("id", "mark", words(F.col("text")).alias("all")).withColumn("n_words", F.size("all"))
    block = F.expr(
        f"inline(transform(sequence(0, cast(greatest(n_words - 1, 0) div {BLOCK} as int)), "
        f"b -> named_struct('start', b * {BLOCK}, 'words', slice(all, b * {BLOCK} + 1, {BLOCK + max(sizes) - 1}))))"
    )
    return cut.select("id", "mark", "n_words", block)


def _positions(sizes: list[int]) -> tuple[Column, Column]:
    """Place in the block and size of the gram at ``place`` of its concatenated hash arrays of ``sizes``."""
    pos, size, before, choices = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0), []
    for k in sizes:
        count = F.least(F.greatest(F.col("block_words") - (k - 1), F.lit(0)), F.lit(BLOCK))
        choices.append((F.col("place") < before + count, k, (F.col("place") - before).cast("int")))
        before = before + count
    for condition, k, at in reversed(choices):
        pos, size = F.when(condition, at).otherwise(pos), F.when(condition, F.lit(k)).otherwise(size)
    return pos, size


def gram_hits(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Matches of ``grams`` (``gram`` array of words, other columns) in each row of ``docs``.

    Gives (``id``, ``mark``, ``n_words``, ``pos``, ``size``, the other columns of ``grams``). ``mark``
    tells rows of one id with different texts apart. Every row of ``docs`` also gives one row with
    null ``pos``, so that rows without a match are not lost.
    """
    known = grams.withColumn("hash", F.xxhash64("gram"))
    extent = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("gram", " "))), F.lit(0))).first()
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col, F.octet_length(text_col)).alias("mark"),
        F.col(text_col).alias("text"),
    )
    look_up = _in_place if extent[0] <= BROADCAST_ROWS and extent[1] <= BROADCAST_BYTES else _by_shuffle
    return look_up(texts, known, [c for c in grams.columns if c != "gram"], sizes)


def _in_place(texts: DataFrame, known: DataFrame, payload: list[str], sizes: list[int]) -> DataFrame:
    arrays = [gram_hashes("words", size) for size in sizes]
    none = F.expr("if(start = 0, array(null), array())").cast("array<bigint>")
    probes = F.posexplode(F.concat(*arrays, none)).alias("place", "probe")
    cut = _blocks(texts, sizes).withColumn("block_words", F.size("words"))
    found = cut.select("*", probes).join(F.broadcast(known), F.col("probe") == F.col("hash"), "left")
    pos, size = _positions(sizes)
    matched = found.select(
        "id", "mark", F.col("n_words").cast("bigint").alias("n_words"), "start",
        F.when(F.col("probe").isNotNull(), pos).alias("pos"),
        F.when(F.col("probe").isNotNull(), size).alias("size"),
        F.col("gram"), F.col("words"), F.col("probe"), *payload,
    ).where("probe is null or (gram is not null and slice(words, pos + 1, size) = gram)")
    return matched.select("id", "mark", "n_words", (F.col("start") + F.col("pos")).alias("pos"), "size", *payload)


def _by_shuffle(texts: DataFrame, known: DataFrame, payload: list[str], sizes: list[int]) -> DataFrame:
    """The same rows without a broadcast: only (id, mark, place, hash) of a gram is shuffled."""
    probes = F.posexplode(F.concat(*[gram_hashes("words", size) for size in sizes])).alias("place", "probe")
    cut = _blocks(texts, sizes).withColumn("block_words", F.size("words"))
    each = cut.select("id", "mark", "start", "block_words", probes)
    asked = skew_join(each, known.select(F.col("hash").alias("probe")).distinct(), "probe", "inner")
    pos, size = _positions(sizes)
    places = asked.select(F.col("id").alias("p_id"), F.col("mark").alias("p_mark"), F.struct((F.col("start") + pos).alias("pos"), size.alias("size")).alias("at"))
    # Equal rows ask for the same places; bounded by one text.
    places = places.groupBy("p_id", "p_mark").agg(F.collect_set("at").alias("ats"))
    same = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("mark") == F.col("p_mark"))
    visited = texts.join(places, same).select("id", "mark", "ats", words(F.col("text")).alias("words"))
    taken = F.expr("transform(ats, a -> named_struct('pos', a.pos, 'size', a.size, 'found', slice(words, a.pos + 1, a.size)))")
    seen = visited.select("id", "mark", F.size("words").cast("bigint").alias("n_words"), F.inline(taken))
    seen = seen.withColumn("probe", F.xxhash64("found"))
    matched = skew_join(seen, known.withColumnRenamed("hash", "probe"), "probe", "inner").where("found = gram")
    hits = matched.select("id", "mark", "n_words", "pos", "size", *payload)
    none = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("pos", "size", *payload)]
    counted = texts.select("id", "mark", F.size(words(F.col("text"))).cast("bigint").alias("n_words"), *none)
    return hits.unionAll(counted)

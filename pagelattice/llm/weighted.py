"""Document fingerprints by consistent weighted sampling, and each document beside the next.

A document is the weighted set of its words, the weight being how often a word stands there. For each
sample a word draws, from its hash and the sample's number alone, r and c from Gamma(2, 1) and b from
(0, 1), and with its weight w gives::

    t = floor(ln(w) / r + b)
    ln a = ln c - r * (t - b + 1)

The least ln a of a document is the sample. It is the same number for two documents exactly if the same
word with the same t has the least in both, which happens with probability sum min(w, w') / sum
max(w, w'), their generalised Jaccard similarity. A fingerprint is four hex digits per sample, a hash of
that number, so that different samples agree once in 65,536. The share of equal samples estimates the
similarity with standard error sqrt(s * (1 - s) / samples).

Words are exploded with their weights and every sample is a minimum in one aggregation over
(partition, row), for which the rows lie together already: no word is shuffled. Built-in functions only.

``with_next`` puts each text beside the next one by id. The texts are dealt by ranges of (id, text hash),
bounds taken from a sorted table of these narrow keys, and shuffled once; the first row of each range goes
to the range before too, so that the last one there finds its successor. After the last row comes the
first. Repeated rows are one row in this order, with their number.

A null text is empty. Texts without words have the fingerprint of no samples, equal to each other and to
nothing else. Rows of one id with different texts are in the order of a hash of the text; rows without
id come first. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelattice.llm.common import scratch

SAMPLES = 64
#: Samples of one aggregation row: more would make its code too long to be compiled.
AT_ONCE = 16
GAP = r"[\x20\x09-\x0D]+"
#: The parts of a hash that give the uniform numbers, and how many values each has.
_PART_BITS = 21
_DIGITS = 4


def _hashes(text: Column, sets: int) -> Column:
    """A hash of each word, with ``sets`` as its lowest two bits."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
    return F.transform(words, lambda w: F.shiftleft(F.xxhash64(w), 2).bitwiseOR(F.lit(sets).cast("bigint")))


def with_terms(df: DataFrame, pieces: list[tuple[Column, int]], name: str) -> DataFrame:
    """``df`` with ``name``: an array of one (``term``, ``weight_0``, ``weight_1``) for each distinct word.

    The weights are the word's numbers in two sets. Each of the ``pieces`` is a text and the sets that its
    words are in: 1 the first, 2 the second, 3 both. So words that two texts share are counted once.
    """
    hashes, starts, runs, first = (f"_{name}_{x}" for x in ("hashes", "starts", "runs", "first"))
    df = df.withColumn(hashes, F.sort_array(F.concat(*[_hashes(t, sets) for t, sets in pieces])))
    df = df.withColumn(starts, F.expr(f"filter(sequence(0, size({hashes})), i -> i < size({hashes}) and (i = 0 or {hashes}[i] <> {hashes}[i - 1]))"))
    each = f"struct(shiftright({hashes}[s], 2) as term, {hashes}[s] & 3 as sets, coalesce(get({starts}, j + 1), size({hashes})) - s as n)"
    df = df.withColumn(runs, F.expr(f"transform({starts}, (s, j) -> {each})"))
    # The runs of a word, one for each of its kinds of pieces, follow one another.
    df = df.withColumn(first, F.expr(f"filter(sequence(0, size({runs})), i -> i < size({runs}) and (i = 0 or {runs}[i].term <> {runs}[i - 1].term))"))
    kinds = len({sets for _, sets in pieces})

    many = f"(coalesce(get({first}, j + 1), size({runs})) - i)"

    def term(upto: int) -> str:
        here = lambda k, bit: f"if({k} < {many} and get({runs}, i + {k}).sets & {bit} <> 0, get({runs}, i + {k}).n, 0)"
        weight = lambda bit: " + ".join([f"if({runs}[i].sets & {bit} <> 0, {runs}[i].n, 0)", *[here(k, bit) for k in range(1, upto)]])
        return f"struct({runs}[i].term as term, {weight(1)} as weight_0, {weight(2)} as weight_1)"

    # Most words have one run.
    terms = F.expr(f"transform({first}, (i, j) -> if({many} = 1, {term(1)}, {term(kinds)}))")
    return df.withColumn(name, terms).drop(hashes, starts, runs, first)


def _uniform(hashed: Column, part: int) -> Column:
    """A number within (0, 2 ** 21) from 21 bits of a hash."""
    return F.shiftrightunsigned(hashed, part * _PART_BITS).bitwiseAND((1 << _PART_BITS) - 1) + 0.5


def _sample(k: int, seed: Column, log_weight: Column) -> Column:
    """ln a of a word for sample ``k`` of its block; null for no word, which has no weight."""
    one, two = F.xxhash64(seed.bitwiseXOR(2 * k)), F.xxhash64(seed.bitwiseXOR(2 * k + 1))
    # Products with powers of two, since a division has to look for zeros.
    scale = 2.0**-_PART_BITS
    r = -F.log(_uniform(one, 0) * _uniform(one, 1) * (scale * scale))
    c = -F.log(_uniform(two, 0) * _uniform(two, 1) * (scale * scale))
    b = _uniform(one, 2) * scale
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + 1.0)


def signatures(df: DataFrame, keys: list[str], terms: str, names: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and the fingerprints, named ``names``, of the sets that the weights in ``terms`` give.

    ``keys`` tell the rows apart. What a word draws is computed once for all sets. ``samples`` is rounded up to
    a multiple of ``AT_ONCE``.
    """
    blocks = -(-samples // AT_ONCE)
    each = df.select(*keys, terms, F.explode_outer(F.array(*[F.lit(b) for b in range(blocks)])).alias("_block")).select(*keys, "_block", F.explode_outer(terms).alias("_t"))
    # The logarithm of no weight is null, and so is the sample.
    weights = [F.log(F.col(f"_t.weight_{i}").cast("double")).alias(f"_log_{i}") for i in range(len(names))]
    # One hash of word and block; the samples of the block hash that one number, changed in its lowest bits.
    each = each.select(*keys, "_block", F.xxhash64("_t.term", "_block").alias("_seed"), *weights)
    drawn = [F.min(_sample(k, F.col("_seed"), F.col(f"_log_{i}"))).alias(f"_{i}_{k}") for k in range(AT_ONCE) for i in range(len(names))]
    least = each.groupBy(*keys, "_block").agg(*drawn)

    def digits(i: int) -> Column:
        hashed = [F.xxhash64(f"_{i}_{k}").bitwiseAND((1 << 4 * _DIGITS) - 1) for k in range(AT_ONCE)]
        # Four samples are one number of 16 digits; a row without words has none.
        four = lambda k: F.shiftleft(hashed[k], 48).bitwiseOR(F.shiftleft(hashed[k + 1], 32)).bitwiseOR(F.shiftleft(hashed[k + 2], 16)).bitwiseOR(hashed[k + 3])
        return F.when(F.col(f"_{i}_0").isNull(), F.lit("")).otherwise(F.lower(F.concat(*[F.lpad(F.hex(four(k)), 16, "0") for k in range(0, AT_ONCE, 4)])))

    parts = least.select(*keys, "_block", *[digits(i).alias(f"_part_{i}") for i in range(len(names))])
    whole = lambda i: F.concat(*[F.max(F.when(F.col("_block") == b, F.col(f"_part_{i}"))) for b in range(blocks)])
    return parts.groupBy(*keys).agg(*[whole(i).alias(name) for i, name in enumerate(names)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints, 0 to 1."""
    size = samples * _DIGITS
    each = lambda text: F.regexp_extract_all(text, F.lit(f".{{{_DIGITS}}}"), F.lit(0))
    equal = F.size(F.array_remove(F.zip_with(each(a), each(b), lambda x, y: x == y), False)) / float(samples)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == size) & (F.length(b) == size), equal).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, ``fingerprint``), one row per distinct id and text."""
    keyed = docs.select(F.col(id_col), F.xxhash64(text_col, F.octet_length(text_col)).alias("_mark"), F.col(text_col).alias("_text"))
    keyed = with_terms(keyed, [(F.col("_text"), 1)], "_terms")
    return signatures(keyed, [id_col, "_mark"], "_terms", ["fingerprint"], samples).drop("_mark")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Texts beside the next one: ``part``, ``nth``, ``id``, ``text``, ``next_text``, ``copies``, ``border``.

    (``part``, ``nth``) are unique, rows of a ``part`` lie in one task, and the next row of each is
    ``nth + 1`` of its ``part``. Rows with ``border`` repeat the first of the next part, have no next text,
    and are to be dropped in the end.
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(text_col, F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.octet_length(text)).alias("mark"), text.alias("text"))
    with scratch(spark) as tables:
        # Equal rows in one: a row repeated without end is one key here.
        keys = tables.store(keyed.groupBy("id", "mark").agg(F.count("*").alias("copies")), "keys")
        dealt = tables.store(keys.repartitionByRange(ranges, "id", "mark").withColumn("part", F.spark_partition_id()), "dealt_keys")
        key = F.struct("id", "mark")
        # One row per range: their number is a setting, not the table's size.
        bounds = [r["low"] for r in dealt.groupBy("part").agg(F.min(key).alias("low")).orderBy("part").collect()]
        repeated = tables.store(keys.where("copies > 1"), "repeated_keys")
        n_repeated = repeated.count()
        if n_repeated:
            repeated = tables.store(repeated, "copies", keep=True)
    if not bounds:
        return docs.sparkSession.createDataFrame([], f"part int, nth int, id {keyed.schema['id'].dataType.simpleString()}, text string, next_text string, copies bigint, border boolean")
    rows = keyed.withColumn("copies", F.lit(1).cast("bigint"))
    if n_repeated:
        same = keyed["id"].eqNullSafe(repeated["id"]) & (keyed["mark"] == repeated["mark"])
        once = keyed.join(repeated, same, "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
        first = keyed.join(repeated, same).select(keyed["id"], keyed["mark"], "text", "copies").groupBy("id", "mark").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
        rows = once.unionByName(first)
    kind = keyed.schema["id"].dataType
    lows = F.array(*[F.struct(F.lit(b["id"]).cast(kind).alias("id"), F.lit(b["mark"]).cast("bigint").alias("mark")) for b in bounds])
    last = len(bounds) - 1
    # The number of bounds at or below a key tells its range.
    rows = rows.withColumn("part", F.size(F.filter(lows, lambda low: low <= key)) - 1)
    before = F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1)
    here = F.struct(F.col("part"), F.lit(False).alias("border"))
    places = F.when(F.get(lows, F.col("part")) == key, F.array(here, F.struct(before.alias("part"), F.lit(True).alias("border")))).otherwise(F.array(here))
    placed = rows.select("id", "mark", "text", "copies", F.inline_outer(places))
    inside = Window.partitionBy("part").orderBy("border", "id", "mark")
    return placed.select("part", F.row_number().over(inside).alias("nth"), "id", "text", F.lead("text").over(inside).alias("next_text"), "copies", "border")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last quarter, in code points, replaced by as many from the front of ``other``."""
    size = F.char_length(text)
    cut = F.floor(size / 4).cast("int")
    return F.concat(text.substr(F.lit(1), size - cut), other.substr(F.lit(1), cut))


def shared_pieces(text: Column, edit: Column) -> list[tuple[Column, int]]:
    """``text`` and its edited text as pieces of words: those both begin with, the rest of each.

    The common piece ends with the last gap of what the edit leaves of ``text``, so no word is cut.
    """
    size = F.char_length(text)
    common = F.regexp_extract(text.substr(F.lit(1), size - F.floor(size / 4).cast("int")), r"(?s)^.*[\x20\x09-\x0D]", 0)
    rest = lambda whole: F.substr(whole, F.char_length(common) + 1)
    return [(common, 3), (rest(text), 1), (rest(edit), 2)]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited`` and ``near_next``.

    ``near_edited`` is the likeness to the text edited with the next one, ``near_next`` to that next text.
    """
    rows = with_next(docs, id_col, text_col)
    # Border rows have no next text; what they are edited to is not used.
    rows = rows.withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.select("part", "nth", "id", "copies", "border", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), "text", "edited")
    # The digest as numbers: keys of fixed width are cheap to group by.
    rows = rows.withColumns({f"sha_{i}": F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(4)})
    rows = with_terms(rows, shared_pieces(F.col("text"), F.col("edited")), "terms")
    about = ["part", "nth", "id", "copies", "border", "n_chars", *[f"sha_{i}" for i in range(4)]]
    one = signatures(rows, about, "terms", ["fingerprint", "edited_fingerprint"], samples)
    beside = one.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("nth"))).where(~F.col("border"))
    return beside.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.concat(*[F.lpad(F.hex(f"sha_{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
        F.explode_outer(F.expr("sequence(1L, copies)")).alias("_copy"),
    ).drop("_copy")

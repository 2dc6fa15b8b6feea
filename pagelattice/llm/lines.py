"""Content-defined chunks of lines and sentences, removed where they repeat anywhere in the corpus.

Units are the texts between newlines, cut further after sentence ends, so that a passage pasted into
a line is seen. A rolling hash over the unit hashes chooses where chunks end. Over units of
``least_words`` words or more it spans one unit, and a chunk ends after each but those whose hash is 0 modulo
``JOINS``, which go on into the next. Shorter units in a row form a stretch, closed by a longer unit; in
it the hash spans two units, and a chunk ends where it is the least of all that end fewer than ``least_words``
words away on either side (the earlier of equal ones). So borders depend on the few words around them
alone, chunks do not overlap, and what was inserted before a passage does not move the borders within it.
A line of ``long_line`` words or more opens and closes a chunk, and hashes inside it do not look out of it:
repeated as a whole it is found as a whole. A passage inside a line may lose its first or last unit to a neighbour.

Chunks are counted by hash over the whole corpus. All but the first occurrence, by (id, place), are
candidates. Their bytes are compared with those of the first before they are removed; one that differs stays.
Only hashes are counted, combined before the shuffle; texts are joined by id with the places asked for, once to
compare and once to cut.

A null text stays null, an empty one empty. A text all of whose chunks were seen before becomes
empty; no row is dropped. Chunks under ``least_words`` words, stretches of so few, stay. Rows equal in id and text are one text and are changed alike. Rows of
one id with different texts are different texts. Ids may be of any type that can be compared. Extra columns pass through, but for one
named as the count, which tells the units removed; names that begin
with ``_line`` are reserved. An empty table gives an empty result. Memory follows a slice of a few megabytes, or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.common import scratch, ship, small
from pagelattice.session import cut_lineage

LEAST_WORDS = 8
LONG_LINE = 30
#: One in so many units of ``LEAST_WORDS`` words or more goes on into the next.
JOINS = 16


def borders(rolling: np.ndarray, words: np.ndarray, stretch: np.ndarray, least: int) -> np.ndarray:
    """Whether a chunk ends after each unit: where its hash is least within ``least`` words, and at stretch ends."""
    n = len(rolling)
    last = np.append(stretch[1:] != stretch[:-1], True) if n else np.zeros(0, bool)
    upto = np.cumsum(words)
    starts = np.flatnonzero(np.append(True, last[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    before = np.repeat((upto - words)[starts], sizes)
    after = np.repeat(upto[np.append(starts[1:], n) - 1], sizes) if n else upto
    # Neither the first nor the last chunk of a stretch is shorter than the others may be.
    ends = (upto - before >= least) & (after - upto >= least)
    for away in range(1, min(least, n)):
        near = (stretch[away:] == stretch[:-away]) & (upto[away:] - upto[:-away] < least)
        beaten = rolling[:-away] <= rolling[away:]
        ends[away:] &= ~(near & beaten)
        ends[:-away] &= ~(near & ~beaten)
    return ends | last


class Chunks:
    """Chunks of a slice of texts: row, number within the row, units, bytes, word count and hash."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, long_line: int = LONG_LINE, least_words: int = LEAST_WORDS):
        words = arrays.Runs(raw, bounds, arrays.INK, lower=False)
        data, n = words.data, len(words.data)
        self.data, self.bounds = data, words.bounds
        newline = data == 10
        stop = np.isin(data, (33, 46, 63))
        cut = newline.copy()
        cut[1:] |= stop[:-1] & (data[1:] == 32)
        begins = np.zeros(n + 1, dtype=bool)
        begins[1:] = cut
        begins[words.bounds] = True
        begins[n] = False
        # Units with a word; a blank stretch belongs to what stands before it.
        at = np.flatnonzero(begins)
        first = np.searchsorted(words.start, at)
        counts = np.diff(np.append(first, len(words.start)))
        filled = counts > 0
        unit, count, first = at[filled], counts[filled], first[filled]
        last_word = first + count - 1
        row = np.searchsorted(words.bounds, unit, side="right") - 1
        # Lines, and sections: a long line, or what stands between two in one text.
        line = np.searchsorted(np.flatnonzero(newline), unit)
        line = np.cumsum(np.append(False, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))) if len(unit) else line
        long = np.bincount(line, weights=count, minlength=1)[line] >= long_line
        section = np.cumsum(np.append(False, (row[1:] != row[:-1]) | (long[1:] != long[:-1]) | (long[1:] & (line[1:] != line[:-1])))) if len(unit) else line
        hashes = arrays.span_hashes(data, words.start[first], words.end[last_word])
        before = np.append(np.uint64(0), hashes[:-1])
        before[np.append(True, section[1:] != section[:-1])[: len(unit)]] = 0
        full = count >= least_words
        rolling = np.where(full, arrays.mix(hashes), arrays.mix(hashes + before * np.uint64(0xFF51AFD7ED558CCD)))
        # A full unit is a stretch of its own.
        new = np.append(False, (section[1:] != section[:-1]) | full[1:] | full[:-1])[: len(unit)]
        ends = borders(rolling, count, np.cumsum(new), least_words)
        closing = np.append(section[1:] != section[:-1], True)[: len(unit)]
        ends &= closing | ~full | (rolling % np.uint64(JOINS) != 0)
        tail = np.flatnonzero(ends)
        head = np.append(0, tail[:-1] + 1)[: len(tail)]
        self.words = np.add.reduceat(count, head) if len(head) else count
        large = self.words >= least_words
        head, tail, self.words = head[large], tail[large], self.words[large]
        self.row = row[head]
        self.units = tail + 1 - head
        self.start, self.end = words.start[first[head]], words.end[last_word[tail]]
        self.cut_from = unit[head]
        self.cut_to = np.minimum(np.append(unit, n)[tail + 1], words.bounds[self.row + 1])
        self.hash = arrays.span_hashes(data, self.start, self.end)
        self.first = np.searchsorted(self.row, np.arange(words.rows + 1))
        self.place = np.arange(len(head)) - self.first[self.row]


def _places(least_words: int, long_line: int):
    def run(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                found = Chunks(raw, bounds[low : high + 1], long_line, least_words)
                rows = pa.array(found.row + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("mark").take(rows), pa.array(found.place.astype(np.int32)), pa.array(found.hash.view(np.int64))],
                    names=["id", "mark", "place", "hash"],
                )

    return run


def _asked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a list column."""
    offsets = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.flatten().to_numpy()


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after another, and where each begins."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)], offsets


def _texts(least_words: int, long_line: int):
    """Bytes of the chunks at the places asked for, and whether they are the first."""

    def run(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                found = Chunks(raw, bounds[low : high + 1], long_line, least_words)
                row, code = _asked(batch.column("places")[low:high])
                chunk = found.first[row] + (code >> 1)
                spans, offsets = _joined(found.data, found.start[chunk], found.end[chunk])
                texts = pa.Array.from_buffers(pa.large_binary(), len(chunk), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(spans)])
                rows = pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("mark").take(rows), pa.array((code >> 1).astype(np.int32)), pa.array(found.hash[chunk].view(np.int64)), pa.array(code & 1 == 0), texts.cast(pa.binary())],
                    names=["id", "mark", "place", "hash", "first", "bytes"],
                )

    return run


def _cut(least_words: int, long_line: int):
    """Texts without the chunks at the places asked for."""

    def run(batches):
        for batch in batches:
            column = batch.column("_line_text")
            raw, bounds = arrays.flat(column)
            texts, removed = [], []
            for low, high in arrays.slices(bounds):
                row, place = _asked(batch.column("_line_places")[low:high])
                if not len(row):
                    texts.append(column[low:high].cast(pa.large_string()))
                    removed.append(np.zeros(high - low, np.int64))
                    continue
                found = Chunks(raw, bounds[low : high + 1], long_line, least_words)
                chunk = found.first[row] + place
                # Bytes within no chunk asked for.
                depth = np.zeros(len(found.data) + 1, dtype=np.int64)
                depth[found.cut_from[chunk]] += 1
                np.add.at(depth, found.cut_to[chunk], -1)
                stays = np.cumsum(depth[:-1]) == 0
                ends = np.concatenate(([0], np.cumsum(stays)))[found.bounds]
                left = pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.data[stays])])
                texts.append(pa.compute.if_else(column[low:high].is_valid(), left, pa.scalar(None, pa.large_string())))
                removed.append(np.bincount(row, weights=found.units[chunk], minlength=high - low).astype(np.int64))
            index = batch.schema.get_field_index("_line_text")
            text = pa.concat_arrays(texts) if texts else pa.array([], pa.large_string())
            batch = batch.set_column(index, "_line_text", text.cast(pa.string()))
            index = batch.schema.get_field_index("_line_places")
            yield batch.set_column(index, "_line_places", pa.array(np.concatenate(removed) if removed else [], pa.int64()))

    return run


def drop_repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, long_line: int = LONG_LINE, count_col: str = "n_removed"
) -> DataFrame:
    """``docs`` with repeated chunks cut from their texts, and the number of units cut in ``count_col``."""
    spark = docs.sparkSession
    ship(spark)
    mark = F.xxhash64(text_col, F.octet_length(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    key = f"id {keyed.schema['id'].dataType.simpleString()}, mark bigint"
    with scratch(spark) as tables:
        with scratch(spark) as early:
            places = early.store(keyed.mapInArrow(_places(least_words, long_line), f"{key}, place int, hash bigint"), "chunks")
            here = F.struct("id", "mark", "place")
            hashes = early.store(places.groupBy("hash").count().where("count > 1").select("hash"), "hashes")
            n_repeated = hashes.count()
            again = early.store(places.join(small(hashes, n_repeated), "hash"), "again")
            repeated = early.store(again.groupBy("hash").agg(F.min(here).alias("first")), "repeated")
            # A place asked for is twice its number, and one more if it is to be dropped.
            asked = again.join(small(repeated, n_repeated), "hash").select(
                "id", "mark", (F.col("place").cast("bigint") * 2 + F.when(here.eqNullSafe(F.col("first")), 0).otherwise(1)).alias("code")
            )
            # Dealt by text first: the sets are then made in one step, from narrow rows.
            asked = asked.repartition("id", "mark").groupBy("id", "mark").agg(F.collect_set("code").alias("places"))
            asked = tables.store(asked.withColumn("drops", F.expr("transform(filter(places, c -> c % 2 = 1), c -> cast(c div 2 as int))")), "asked")
        wanted = keyed.join(asked, (keyed["id"].eqNullSafe(asked["id"])) & (keyed["mark"] == asked["mark"]))
        texts = wanted.select(keyed["id"], keyed["mark"], "text", "places").mapInArrow(_texts(least_words, long_line), f"{key}, place int, hash bigint, first boolean, bytes binary")
        texts = tables.store(texts, "chunk_texts")
        # Equal rows give a first chunk several times.
        first_texts = texts.where("first").groupBy("hash").agg(F.min("bytes").alias("f_bytes"))
        differing = texts.where("not first").join(first_texts, "hash").where("bytes <> f_bytes").select("id", "mark", "place").distinct()
        differing = tables.store(differing, "differing")
        drops = asked.where("size(drops) > 0").select("id", "mark", "drops")
        if not differing.isEmpty():
            spared = differing.groupBy("id", "mark").agg(F.collect_set("place").alias("spared"))
            drops = drops.join(
                spared.withColumnsRenamed({"id": "s_id", "mark": "s_mark"}),
                F.col("id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left",
            ).select("id", "mark", F.when(F.col("spared").isNull(), F.col("drops")).otherwise(F.array_except("drops", "spared")).alias("drops"))
        # Needed for as long as the result; goes when it does.
        drops = cut_lineage(drops)
    found = drops.select(F.col("id").alias("_line_id"), F.col("mark").alias("_line_mark"), F.col("drops").alias("_line_places"))
    same = F.col(id_col).eqNullSafe(F.col("_line_id")) & (mark == F.col("_line_mark"))
    joined = docs.withColumn("_line_text", F.col(text_col)).join(found, same, "left").select(
        *[c for c in docs.columns if c != text_col], "_line_text", F.coalesce("_line_places", F.expr("cast(array() as array<int>)")).alias("_line_places")
    )
    fields = ", ".join(f"`{f.name}` {'bigint' if f.name == '_line_places' else f.dataType.simpleString()}" for f in joined.schema)
    done = joined.mapInArrow(_cut(least_words, long_line), fields)
    names = [c for c in docs.columns if c != count_col]
    return done.select(*[F.col("_line_text").alias(c) if c == text_col else F.col(c) for c in names], F.col("_line_places").alias(count_col))

"""How filters of a corpus interact, for every order in which they can be applied.

A document's filters that fail form its mask. Documents are counted per part and mask, by built-in
functions; with five filters a part has at most 32 counts whatever its size. Each order of the filters
is a row of positions, the inverse of its permutation. The removal step of a mask under an order is
the min-plus product of both: the least position among the filters that fail, computed for all masks and
orders at once. Those steps scatter the counts: a document leaves at its removal step, and at each later
step whose filter it also fails it is redundant. Parts are spread over tasks; a task holds one
batch of parts.

The filters, each failing when its condition holds (words are runs of all but ASCII white space):

- A: under 200 words
- B: fewer than half the words are distinct
- C: more than 2 % of the code points are A-Z
- D: any of ``#$%&*|``
- E: identical to the text of a smaller id, anywhere in the table

Null and empty texts are the same text. A null part counts as the empty string. Rows equal in id and
text are counted each, and none is a copy of the other; a row without id has no smaller one, is smaller
than none and has no label. Of several labels of one id any that is set counts. Extra columns are not
read. An empty table has no parts and gives an empty result; absent labels lose nothing.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.llm.common import scratch, ship
from pagelattice.session import cut_lineage

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percent.
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = r"[#$%&*|]"
#: Parts whose results leave a task at once.
PARTS_AT_ONCE = 64
_GAP = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Failure of A to D, the filters that need the text alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    # One pass over the words for both numbers.
    counted = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("all"), F.size(F.array_distinct(ws)).alias("distinct")))[0]
    return [
        counted["all"] < LEAST_WORDS,
        100 * counted["distinct"] < LEAST_DISTINCT * counted["all"],
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length(text),
        text.rlike(SYMBOLS),
    ]


def failures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, tables) -> DataFrame:
    """(``part``, ``mask``, ``n``, ``good``, ``toxic``): documents of each mask, bit i for filter i."""
    text = F.coalesce(text_col, F.lit(""))
    a_to_d = F.transform(F.array(F.struct(*[c.alias(FILTERS[i]) for i, c in enumerate(text_failures(F.col(text_col)))])), lambda f: sum((f[FILTERS[i]].cast("int") * (1 << i) for i in range(4)), F.lit(0)))[0]
    narrow = docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), a_to_d.alias("mask"),
    )
    # Equal rows in one, so that an id or a text without end is a few rows.
    narrow = tables.store(narrow.groupBy("id", "key", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = narrow.where("id is not null").groupBy("key").agg(F.min("id").alias("id"))
    marked = labels.where(f"{id_col} is not null").groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.expr("cast(quality = 1 as int)")), F.lit(0)).alias("good"), F.coalesce(F.max(F.expr("cast(toxic = 1 as int)")), F.lit(0)).alias("toxic")
    )
    known = narrow.where("id is not null").join(first.withColumn("first", F.lit(True)), ["id", "key"], "left").join(marked, "id", "left")
    known = known.select("part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = narrow.where("id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def removal_steps(filters: int = len(FILTERS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All orders, the failing filters of all masks, and the step (from 0) at which each mask leaves under each order.

    A mask that fails nothing leaves after the last step.
    """
    orders = np.array(list(permutations(range(filters))), dtype=np.int64)
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1
    positions = np.argsort(orders, axis=1)  # of each filter under each order
    toll = np.where(fails, 0, filters)
    return orders, fails, np.minimum((toll[:, None, :] + positions[None, :, :]).min(axis=2), filters)


class Scatter:
    """Linear maps from the counts per mask to the counts per order and step, from the removal steps."""

    def __init__(self, filters: int = len(FILTERS)):
        self.orders, fails, steps = removal_steps(filters)
        masks, shape = len(fails), (len(fails), self.orders.size)
        at = np.arange(filters)
        leaves = steps[:, :, None] == at
        failing = fails[:, self.orders]  # mask, order, step: the step's filter fails
        alone = fails.sum(axis=1) == 1
        self.removed = leaves.reshape(shape).astype(np.int64)
        self.kept = (steps[:, :, None] > at).reshape(shape).astype(np.int64)
        self.redundant = (failing & (steps[:, :, None] < at)).reshape(shape).astype(np.int64)
        self.unique = (failing & alone[:, None, None]).reshape(shape).astype(np.int64)
        by_filter = np.zeros((masks, filters), dtype=np.int64)
        np.add.at(by_filter, (np.arange(masks)[:, None, None], self.orders[None]), leaves.astype(np.int64))
        self.shapley = by_filter[:, self.orders].reshape(shape)

    def apply(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
        """Per part (rows) and order and step (columns), in the order of the result's columns."""
        return [n @ self.kept, n @ self.removed, n @ self.redundant, n @ self.unique, good @ self.removed, toxic @ self.removed, n @ self.shapley]


def _scatter(batches):
    """Arrow task: parts with their counts per mask to one row per part, order and step."""
    maps = Scatter()
    steps = len(FILTERS)
    names = pa.array(["".join(FILTERS[f] for f in order) for order in maps.orders for _ in range(steps)])
    step = np.tile(np.arange(1, steps + 1, dtype=np.int32), len(maps.orders))
    for batch in batches:
        for low in range(0, batch.num_rows, PARTS_AT_ONCE):
            part = batch.slice(low, PARTS_AT_ONCE)
            weights = np.zeros((3, part.num_rows, 1 << steps), dtype=np.int64)
            cells = part.column("cells")
            row = np.repeat(np.arange(part.num_rows), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            mask = flat.field("mask").to_numpy()
            for i, name in enumerate(("n", "good", "toxic")):
                np.add.at(weights[i], (row, mask), flat.field(name).to_numpy())
            columns = maps.apply(*weights)
            own = pa.array(np.repeat(np.arange(part.num_rows), len(step)))
            yield pa.RecordBatch.from_arrays(
                [part.column("part").take(own), pa.concat_arrays([names] * part.num_rows), pa.array(np.tile(step, part.num_rows)), *[pa.array(c.ravel()) for c in columns]],
                names=["part", "filter_order", "step", *_COUNTS],
            )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: who is left, leaves and would have left.

    ``kept`` documents after the step, ``removed`` at it, ``redundant`` ones that fail its filter but left
    before, ``unique_fails`` that fail its filter alone, ``good_lost`` and ``toxic_lost`` among the removed,
    and ``shapley``, what the step's filter removes summed over all orders.
    """
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark) as tables:
        cells = tables.store(failures(docs, labels, id_col, text_col, part_col, tables), "mask_counts")
        # A few numbers a part; as a checkpoint they go when the result does.
        parts = cut_lineage(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    return parts.mapInArrow(_scatter, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS))

"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per vertex, combined before the shuffle, and an equi-join. Nothing of a
vertex's neighbourhood is collected. A chain of n vertices takes O(log n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelattice.llm.common import Scratch, small


def _large(edges: DataFrame, rows: int) -> DataFrame:
    """Neighbours above a vertex are tied to the smallest vertex it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = small(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * rows)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _small(edges: DataFrame, rows: int) -> DataFrame:
    """Each vertex and its lower neighbours are tied to the lowest of them."""
    low = small(edges.groupBy("u").agg(F.min("v").alias("m")), rows)
    down = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.where("u > v").union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """(``u``, ``v``) links to (``node``, ``component``): each vertex and the least of its component."""
    edges = tables.store(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges"
    )
    summary = (F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.bit_xor(F.xxhash64("v", "u")))
    state = edges.agg(*summary).first()
    while state[0]:
        # A step never makes more edges than it finds vertices and edges.
        edges = tables.store(_small(_large(edges, state[0]), 2 * state[0]).distinct(), "edges")
        last, state = state, edges.agg(*summary).first()
        if state == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

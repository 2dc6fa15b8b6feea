"""Breadth-first traversal of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelattice.functions import urls
from pagelattice.operators.robots import RuleIndex
from pagelattice.operators.skew import heavy_keys, repeated, salted, skew_join
from pagelattice.session import LaidOut, cut_lineage, laid_out_by


def page_edges(links: DataFrame) -> DataFrame:
    """Links as graph edges between page keys (fragments of captured URLs dropped)."""
    return links.select(urls.captured_key(F.col("src")).alias("src"), "dst")


def crawl_frontier(
    edges: DataFrame,
    seeds: DataFrame,
    rules: DataFrame | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Every URL the traversal meets: (url, depth, allowed).

    Starts from ``seeds`` (url) of all sites at once. Refused URLs are listed and not expanded;
    URLs that were not captured are listed and have nothing to expand. One job per level; each
    level is checkpointed, so a lost executor costs at most one level. Levels hold distinct
    URLs, so a page linked from everywhere is one row after the first combine.
    """
    stored = cut_lineage(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    heavy = heavy_keys(stored, "src")
    index = RuleIndex(rules) if rules is not None else None
    hot_hosts = None
    if index is not None:
        hot_hosts = heavy_keys(stored.select(urls.authority(F.col("dst")).alias("host")), "host")

    def judged(candidates: DataFrame, depth: int) -> DataFrame:
        """Distinct URLs with the verdict of their host's rules; each URL is judged once."""
        rows = candidates.select("url").distinct()
        verdict = rows.withColumn("allowed", F.lit(True)) if index is None else index.verdicts(rows, hot_hosts)
        return verdict.select("url", F.lit(depth).alias("depth"), "allowed")

    # Edges are laid out by source and the URLs met by URL, each once: a level shuffles its own
    # frontier and what it reaches, and its plan is as long as that of the first.
    level, depth, met = cut_lineage(judged(seeds, 0)), 0, LaidOut(edges.sparkSession, "url")
    try:
        met.add(level)
        with laid_out_by(salted(stored, "src", heavy), "src", "_salt") as graph:
            while max_depth is None or depth < max_depth:
                depth += 1
                frontier = level.where("allowed").select(F.col("url").alias("src"))
                starts = repeated(frontier, "src", heavy)
                reached = graph.join(starts, ["src", "_salt"]).select(F.col("dst").alias("url"))
                unmet = reached.distinct().join(met.rows().select("url"), "url", "left_anti")
                level = cut_lineage(judged(unmet, depth))
                if level.isEmpty():
                    break
                met.add(level)
        return cut_lineage(met.rows())
    finally:
        met.drop()


def crawl_order(
    edges: DataFrame,
    seeds: DataFrame,
    rules: DataFrame | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Visited URLs with their breadth-first depth."""
    met = crawl_frontier(edges, seeds, rules, max_depth)
    return met.where("allowed").select("url", "depth")

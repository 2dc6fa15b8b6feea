"""Comparison of captures with the state of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice import schemas
from pagelattice.functions import urls


def page_captures(pages: DataFrame, ts: Column) -> DataFrame:
    """State rows of captured pages; the content hash stands in for the server's validator.

    The hash is taken at the scan, so page text never enters a shuffle.
    """
    return pages.select(
        "url",
        F.md5("html").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit("text/html").alias("content_type"),
        urls.local_path(F.col("url")).alias("local_path"),
        ts.cast("timestamp").alias("ts"),
    )


def asset_captures(assets: DataFrame, ts: Column) -> DataFrame:
    """State rows of captured assets (url, content_type, body)."""
    return assets.select(
        "url",
        F.md5(F.col("body").cast("binary")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        "content_type",
        urls.local_path(F.col("url")).alias("local_path"),
        ts.cast("timestamp").alias("ts"),
    )


def latest_per_url(captures: DataFrame) -> DataFrame:
    """One row per URL, the last write. Copies of one URL are combined before the shuffle."""
    rest = [c for c in schemas.STATE.names if c != "url"]
    best = F.max_by(F.struct(*rest), F.struct("ts", "etag", "local_path")).alias("s")
    return captures.groupBy("url").agg(best).select("url", *[F.col(f"s.{c}") for c in rest])


def upsert_state(state: DataFrame, captures: DataFrame) -> DataFrame:
    """State after the captures: one row per URL, the later write wins, captures on a tie."""
    columns = schemas.STATE.names
    rest = [c for c in columns if c != "url"]
    both = state.select(*columns, F.lit(0).alias("_new")).unionByName(
        captures.select(*columns, F.lit(1).alias("_new"))
    )
    best = F.max_by(F.struct(*rest), F.struct("ts", "_new", "etag", "local_path")).alias("s")
    return both.groupBy("url").agg(best).select("url", *[F.col(f"s.{c}") for c in rest])


def _unchanged(new: str, old: str) -> Column:
    def both(name: str) -> Column:
        return (F.coalesce(F.col(f"{new}.{name}"), F.lit("")) != "") & (
            F.coalesce(F.col(f"{old}.{name}"), F.lit("")) != ""
        )

    def equal(name: str) -> Column:
        return F.col(f"{new}.{name}") == F.col(f"{old}.{name}")

    return F.when(both("etag"), equal("etag")).when(both("last_modified"), equal("last_modified")).otherwise(False)


def snapshot_diff(captures: DataFrame, state: DataFrame) -> DataFrame:
    """Status of every URL: new, changed, unchanged or removed.

    The entity tag decides when both sides have one, else the modification date. Captures are
    reduced to one row per URL first, so a URL captured very often stays one row per task.
    """
    now = latest_per_url(captures).select("url", "etag", "last_modified", F.lit(1).alias("here")).alias("n")
    before = state.select("url", "etag", "last_modified", F.lit(1).alias("here")).alias("o")
    joined = now.join(before, F.col("n.url") == F.col("o.url"), "full_outer")
    status = (
        F.when(F.col("o.here").isNull(), "new")
        .when(F.col("n.here").isNull(), "removed")
        .when(_unchanged("n", "o"), "unchanged")
        .otherwise("changed")
    )
    return joined.select(F.coalesce("n.url", "o.url").alias("url"), status.alias("status"))


def changed_captures(captures: DataFrame, state: DataFrame) -> DataFrame:
    """Captures that are new or differ from the state: what a rescan has to read."""
    before = state.select("url", "etag", "last_modified", F.lit(1).alias("here")).alias("o")
    now = latest_per_url(captures).alias("n")
    joined = now.join(before, F.col("n.url") == F.col("o.url"), "left")
    return joined.where(F.col("o.here").isNull() | ~_unchanged("n", "o")).select("n.*")

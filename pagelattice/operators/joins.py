"""Look-ups of URLs in other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pagelattice.functions import urls
from pagelattice.operators.filters import AssetFilter
from pagelattice.operators.skew import Heavy, skew_join


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct keys of ``links.dst`` that are not keys of ``visited.url``.

    Both sides are made distinct first, which combines before the shuffle: a target linked from
    everywhere arrives once per task.
    """
    wanted = links.select(urls.page_key(F.col("dst")).alias("key")).distinct()
    seen = visited.select(urls.page_key(F.col("url")).alias("key")).distinct()
    return wanted.join(seen, "key", "left_anti")


def dangling_links(links: DataFrame, pages: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """Links whose target was not captured.

    ``links`` is read twice when ``heavy`` is not given; pass a stored or checkpointed table.
    """
    captured = pages.select(urls.captured_key(F.col("url")).alias("dst")).distinct()
    return skew_join(links, captured, "dst", "left_anti", heavy).select(*links.columns)


def asset_paths(assets: DataFrame) -> DataFrame:
    """Local path of each held asset, one row per URL."""
    held = assets.select("url").distinct()
    return held.select("url", urls.local_path(F.col("url")).alias("local_path"))


def resolve_asset_paths(
    refs: DataFrame, paths: DataFrame, heavy: Heavy | None = None
) -> DataFrame:
    """``refs`` (url, page_path, …) plus ``new_ref``: the path of a held asset relative to the
    page, the asset URL itself otherwise.

    ``refs`` is read twice when ``heavy`` is not given; pass a stored or checkpointed table.
    """
    joined = skew_join(refs, paths.select("url", "local_path"), "url", "left", heavy)
    relative = urls.relative_path(F.col("local_path"), F.col("page_path"))
    return joined.select(
        *refs.columns,
        F.when(F.col("local_path").isNotNull(), relative).otherwise(F.col("url")).alias("new_ref"),
    )


def conditional_headers(df: DataFrame, state: DataFrame) -> DataFrame:
    """Validators to send for each URL; null where there is none."""

    def filled(name: str):
        return F.when(F.col(name) != "", F.col(name))

    known = state.select(
        "url",
        filled("etag").alias("if_none_match"),
        filled("last_modified").alias("if_modified_since"),
    )
    return df.select("url").join(known, "url", "left")


def seed_assets(
    sites: DataFrame, paths: Sequence[str], held: DataFrame, asset_filter: AssetFilter | None = None
) -> DataFrame:
    """Candidate URLs of known paths on every site (column ``site``) that are not held yet.

    The path list is a parameter of fixed size, so each site row grows in place; the filter acts
    before any look-up.
    """
    asset_filter = asset_filter or AssetFilter()
    listed = F.explode(F.array(*[F.lit(p) for p in paths]))
    candidates = (
        sites.select("site")
        .distinct()
        .select("site", listed.alias("path"))
        .select(F.concat("site", "path").alias("url"), "path")
    )
    category = urls.asset_category(F.col("url"), F.lit(None).cast("string"))
    wanted = candidates.withColumn("category", category).where(
        asset_filter.allows(F.col("url"), F.col("category"))
    )
    return wanted.join(held.select("url").distinct(), "url", "left_anti").select(
        "url",
        "category",
        F.regexp_replace("path", "^/+", "").alias("local_path"),
    )

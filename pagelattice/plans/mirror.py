"""One run over captured sites, from captures and state to offline pages, findings and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import urls
from pagelattice.operators import (
    crawl,
    extract,
    joins,
    reports,
    rewrite,
    robots,
    scan,
    snapshots,
)
from pagelattice.operators.filters import AssetFilter
from pagelattice.operators.skew import heavy_keys, skew_join
from pagelattice.session import cut_lineage, laid_out_by
from pagelattice.sources import state as state_io, warc


@dataclass(frozen=True)
class Options:
    """What a run does; the defaults mirror politely and scan nothing."""

    respect_robots: bool = True
    agent: str = "*"
    incremental: bool = True
    recon: bool = False
    export_warc: bool = False
    max_depth: int | None = None
    base_delay: float = 0.3
    asset_filter: AssetFilter = field(default_factory=AssetFilter)
    seed_paths: Sequence[str] = ()


def kept_assets(assets: DataFrame, chosen: AssetFilter) -> DataFrame:
    """Assets (url, content_type, body) that the filter lets through.

    Type and URL are tested before the body is needed.
    """
    category = urls.asset_category(F.col("url"), F.col("content_type"))
    named = assets.where(chosen.allows(F.col("url"), category))
    return named.where(chosen.allows_size(F.octet_length("body")))


def mirror(
    pages: DataFrame,
    assets: DataFrame,
    robots_text: DataFrame,
    seeds: DataFrame,
    out: str,
    ts: Column,
    options: Options = Options(),
) -> dict[str, DataFrame]:
    """Mirror every site reachable from ``seeds`` (url) and return the tables written to ``out``.

    ``pages`` is (page_id, url, html), ``assets`` (url, content_type, body) with one row per URL,
    ``robots_text`` (host, body). Pages and assets that did not change since the last run keep their
    links and places but are neither rewritten, scanned nor archived again.
    """
    spark = pages.sparkSession
    state_path = f"{out}/state"
    state = state_io.load_state(spark, state_path) if options.incremental else None

    rules = robots.parse_rules(robots_text, options.agent) if options.respect_robots else None
    edges = crawl.page_edges(extract.extract_links(pages))
    keyed_seeds = seeds.select(urls.captured_key(F.col("url")).alias("url"))
    met = cut_lineage(crawl.crawl_frontier(edges, keyed_seeds, rules, options.max_depth))
    visited = met.where("allowed")

    # Everything up to the choice of pages runs on narrow rows: hashes are taken at the scan, and
    # page text moves once, by page_id, which is also the key of the rewrite.
    key = urls.captured_key(F.col("url"))
    copies = heavy_keys(pages.select(key.alias("_key")), "_key")
    captures = skew_join(
        snapshots.page_captures(pages, ts).withColumn("_key", key),
        visited.select(F.col("url").alias("_key")),
        "_key",
        "left_semi",
        copies,
    ).drop("_key")
    fresh = captures if state is None else snapshots.changed_captures(captures, state)
    fresh = cut_lineage(fresh)
    chosen = pages.select("page_id", "url").join(fresh.select("url"), "url", "left_semi")
    work = pages.select("page_id", "url", "html").join(chosen.select("page_id"), "page_id", "left_semi")

    held = kept_assets(assets, options.asset_filter)
    fresh_assets = snapshots.asset_captures(held, ts)
    if state is not None:
        fresh_assets = snapshots.changed_captures(fresh_assets, state)
    fresh_assets = cut_lineage(fresh_assets)
    new_held = held.join(fresh_assets.select("url"), "url", "left_semi")
    captured = fresh.unionByName(fresh_assets)
    # Page text moves once more, into a table laid out by the key of the rewrite; rewrite, scan and
    # archive read it in place.
    with laid_out_by(work, "page_id") as work:
        return _written(spark, work, visited, met, held, new_held, captured, robots_text, seeds, out, state, options)


def _written(spark, work, visited, met, held, new_held, captured, robots_text, seeds, out, state, options):
    state_path = f"{out}/state"
    paths = joins.asset_paths(held)
    is_sheet = F.contains(F.col("content_type"), F.lit("css"))
    tables = {
        "crawl": met,
        "pages": rewrite.clean_pages(work, paths),
        "css": rewrite.rewrite_css(new_held.where(is_sheet).select("url", "body"), held.select("url", "body")),
        "sitemap": reports.sitemap(visited.select("url")),
        "listing": reports.crawl_listing(visited, paths, met.where(~F.col("allowed"))),
        "delays": robots.effective_delay(robots.crawl_delay(robots_text), options.base_delay),
        "robots_report": robots.robots_report(robots_text),
    }
    if options.recon:
        texts = scan.page_texts(work).unionByName(scan.asset_texts(new_held))
        tables["findings"] = scan.all_findings(texts)
    if options.seed_paths:
        sites = seeds.select(urls.origin(F.col("url")).alias("site"))
        tables["wanted_assets"] = joins.seed_assets(
            sites, options.seed_paths, held, options.asset_filter
        )

    run = state_io.next_run(spark, state_path)
    written = {}
    for name, table in tables.items():
        target = f"{out}/{name}/run={run}"
        table.write.mode("overwrite").parquet(target)
        written[name] = spark.read.parquet(target)
    if options.export_warc:
        responses = warc.responses(work).unionByName(warc.responses(new_held, body="body"))
        warc.write_warc(responses, f"{out}/warc/run={run}", overwrite=True)
    if state is not None:
        # The state comes last: a run that failed half-way is simply done again.
        state_io.save_state(captured, state_path)
        written["state"] = state_io.load_state(spark, state_path)
    if options.recon:
        written["summary"] = reports.findings_summary(written["findings"])
    return written

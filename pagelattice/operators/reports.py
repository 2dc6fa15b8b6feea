"""Summaries, rankings and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagelattice.functions import urls


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row: all secrets, distinct e-mail addresses, all comments."""

    def of(kind: str, value: str):
        return F.when(F.col("kind") == kind, F.col(value))

    return findings.agg(
        F.count(of("secret", "kind")).alias("secrets"),
        F.count_distinct(of("email", "value")).alias("emails"),
        F.count(of("comment", "kind")).alias("comments"),
    )


def findings_by_site(findings: DataFrame) -> DataFrame:
    """Counts per site, kind and type; e-mail addresses count once per site.

    Addresses are made distinct by a first grouping that combines before the shuffle and whose
    key includes the value, so a site with very many findings is spread over all tasks.
    """
    keyed = findings.select(
        urls.authority(F.col("source")).alias("site"),
        "kind",
        "type",
        F.when(F.col("kind") == "email", F.col("value")).alias("once"),
    )
    partial = keyed.groupBy("site", "kind", "type", "once").agg(F.count(F.lit(1)).alias("n"))
    hits = F.when(F.col("kind") == "email", F.lit(1)).otherwise(F.col("n"))
    return partial.groupBy("site", "kind", "type").agg(F.sum(hits).alias("n"))


def distinct_emails(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("kind") == "email").select(F.col("value").alias("email")).distinct()


def sorted_emails(findings: DataFrame) -> DataFrame:
    """Distinct addresses in code-point order (a range-partitioned sort)."""
    return distinct_emails(findings).orderBy("email")


def sorted_urls(df: DataFrame) -> DataFrame:
    return df.select("url").distinct().orderBy("url")


def top_comments(findings: DataFrame, k: int = 50) -> DataFrame:
    """The k longest comments; every task keeps only its own k."""
    return (
        findings.where(F.col("kind") == "comment")
        .select("type", "source", F.col("value").alias("content"), F.length("value").alias("length"))
        .orderBy(F.col("length").desc(), "source", "content")
        .limit(k)
    )


def sitemap(pages: DataFrame) -> DataFrame:
    """File name and offline path of each page, in URL order within its site."""
    last = F.substring_index("url", "/", -1)
    file = F.when(F.col("url") == "", F.lit("index.html")).otherwise(last)
    return pages.select(
        urls.authority(F.col("url")).alias("site"),
        "url",
        F.when(F.endswith(file, F.lit(".html")), file)
        .otherwise(F.concat(file, F.lit(".html")))
        .alias("file"),
        urls.local_path(F.col("url")).alias("local_path"),
    ).orderBy("site", "url")


def first_n_per_site(df: DataFrame, n: int, site: str = "host", order: str = "rule_order") -> DataFrame:
    """First n rows of each site. Tasks cut to n rows per site before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(site).orderBy(order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def crawl_listing(pages: DataFrame, assets: DataFrame, skipped: DataFrame) -> DataFrame:
    """Visited pages, skipped pages and held assets as labelled rows (section, url, local_path)."""
    nothing = F.lit(None).cast("string")

    def section(df: DataFrame, label: str, path) -> DataFrame:
        return df.select(F.lit(label).alias("section"), "url", path.alias("local_path"))

    visited = pages.select(urls.page_key(F.col("url")).alias("url")).distinct()
    held = assets.groupBy("url").agg(F.max("local_path").alias("local_path"))
    return (
        section(visited, "pages", nothing)
        .unionByName(section(skipped.select("url").distinct(), "skipped", nothing))
        .unionByName(section(held, "assets", F.col("local_path")))
    )


def crawl_summary(pages: DataFrame, assets: DataFrame, skipped: DataFrame) -> DataFrame:
    """Number of pages, assets and skipped URLs."""
    return crawl_listing(pages, assets, skipped).groupBy("section").agg(F.count(F.lit(1)).alias("n"))

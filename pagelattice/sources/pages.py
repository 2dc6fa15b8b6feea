"""Captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page captures. Where captures carry a content type, only HTML is kept."""
    captures = spark.read.parquet(path)
    return only_html(captures)


def only_html(captures: DataFrame) -> DataFrame:
    if "content_type" not in captures.columns:
        return captures
    return captures.where(F.contains(F.col("content_type"), F.lit("text/html")))


def write_bucketed_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Pages stored by page_id, so that page-with-references joins never move page text."""
    pages.write.bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(table)

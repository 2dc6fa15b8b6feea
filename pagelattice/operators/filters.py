"""Row filters. Each is a plain predicate, so it reaches the scan when it can."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import fixed, urls


@dataclass(frozen=True)
class AssetFilter:
    """Which assets to keep: categories, URL patterns and a byte range."""

    include_types: Sequence[str] = ()
    exclude_types: Sequence[str] = ()
    include_patterns: Sequence[str] = ()
    exclude_patterns: Sequence[str] = ()
    min_kb: int | None = None
    max_kb: int | None = None

    def allows(self, url: Column, category: Column) -> Column:
        return type_allowed(category, self.include_types, self.exclude_types) & url_allowed(
            url, self.include_patterns, self.exclude_patterns
        )

    def allows_size(self, size: Column) -> Column:
        return size_allowed(size, self.min_kb, self.max_kb)


def type_allowed(category: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Case-folded category test; an absent category counts as 'other'."""
    folded = F.lower(F.when(category != "", category).otherwise("other"))
    keep = F.lit(True)
    if include:
        keep = keep & folded.isin([t.lower() for t in include])
    if exclude:
        keep = keep & ~folded.isin([t.lower() for t in exclude])
    return keep


def url_allowed(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any exclude hit rejects; with includes, at least one must be found."""
    keep = F.lit(True)
    for pattern in exclude:
        keep = keep & ~url.rlike(pattern)
    if include:
        found = F.lit(False)
        for pattern in include:
            found = found | url.rlike(pattern)
        keep = keep & found
    return keep


def size_allowed(size: Column, min_kb: int | None = None, max_kb: int | None = None) -> Column:
    """Inclusive byte range given in KB; an unknown size passes."""
    keep = F.lit(True)
    if min_kb is not None:
        keep = keep & (size >= int(min_kb) * 1024)
    if max_kb is not None:
        keep = keep & (size <= int(max_kb) * 1024)
    return size.isNull() | keep


def filter_asset_types(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), category: str = "category") -> DataFrame:
    return df.where(type_allowed(F.col(category), include, exclude))


def filter_url_patterns(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), url: str = "url") -> DataFrame:
    return df.where(url_allowed(F.col(url), include, exclude))


def filter_size(df: DataFrame, min_kb: int | None = None, max_kb: int | None = None, body: str = "body") -> DataFrame:
    return df.where(size_allowed(F.octet_length(F.col(body)), min_kb, max_kb))


def filter_same_site(df: DataFrame, url: str = "url", page: str = "src") -> DataFrame:
    return df.where(urls.same_site(F.col(url), urls.authority(F.col(page))))


def crawlable(href: Column) -> Column:
    joined = "|".join(re.escape(prefix) for prefix in fixed.UNCRAWLED_PREFIXES)
    return ~href.rlike(f"^(?:{joined})")


def filter_crawlable_href(df: DataFrame, href: str = "href") -> DataFrame:
    return df.where(crawlable(F.col(href)))


def is_reference(ref: Column) -> Column:
    """Neither empty nor inline data."""
    return (ref != "") & ~F.startswith(ref, F.lit("data:"))


def filter_data_uri(df: DataFrame, ref: str = "ref") -> DataFrame:
    return df.where(is_reference(F.col(ref)))


def is_address(email: Column) -> Column:
    """E-mail hits that are not image names."""
    folded = F.lower(email)
    noise = F.lit(False)
    for fragment in fixed.EMAIL_NOISE:
        noise = noise | F.contains(folded, F.lit(fragment))
    return ~noise


def is_html_remark(text: Column) -> Column:
    return F.length(text) > 3


def is_code_remark(text: Column) -> Column:
    folded = F.lower(text)
    noise = F.lit(False)
    for fragment in fixed.COMMENT_NOISE:
        noise = noise | F.contains(folded, F.lit(fragment))
    return (F.length(text) > 5) & ~noise

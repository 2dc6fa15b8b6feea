"""Links and asset references out of pages and style sheets.

Every extractor is row-local: one pass over the text, duplicates removed inside the row, no
shuffle. Only the columns named are read from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import fixed, markup, urls
from pagelattice.functions.binding import let
from pagelattice.operators.filters import crawlable, is_reference


def extract_links(pages: DataFrame) -> DataFrame:
    """Same-site page links: (page_id, src, dst), one row per target and page."""
    hrefs = F.array_distinct(markup.attribute_values(F.col("html"), "a", "href"))
    found = pages.select(
        "page_id",
        F.col("url").alias("src"),
        F.filter(hrefs, crawlable).alias("hrefs"),
        urls.base_parts(F.col("url")).alias("base"),
    )
    base = F.col("base")
    resolved = urls.resolve_all(F.col("hrefs"), base)
    kept = F.filter(
        resolved,
        lambda u: u.rlike("^https?://") & urls.same_site(u, urls.base_authority(base)),
    )
    targets = F.array_distinct(F.transform(kept, urls.page_key))
    exploded = found.select("page_id", "src", F.explode_outer(targets).alias("dst"))
    return exploded.where(F.col("dst").isNotNull())


def _entries(kind: str, refs: Column) -> Column:
    return F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))


def _one(ref: Column) -> Column:
    return F.filter(F.array(ref), lambda r: r != "")


# Finds what fixed.CSS_URL_PATTERN finds, in linear time. A reference ends at a quote, a bracket or white space,
# so giving back characters never helps; and where one is not closed there, none that begins within it is,
# so it is passed over as a whole, up to a later "url(" that a quote follows.
_CSS_URL = r"""url\(["']?+(?:([^"')\s]++)["']?+\)|(?:(?!url\(["'])[^"')\s])*+)"""


def css_urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_CSS_URL), F.lit(1))
    return F.filter(found, lambda ref: ref != "")


def may_have_style(token: Column, name: Column) -> Column:
    """A cheap test that spares most tokens the attribute pattern."""
    return ~name.isin("", "script", "style") & F.contains(F.lower(token), F.lit("style"))


def css_imports(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.CSS_IMPORT_PATTERN), F.lit(1))


def token_refs(token: Column) -> Column:
    """References of one tag or style block as (kind, ref) entries."""
    none = F.array().cast("array<struct<kind:string,ref:string>>")

    def of_link(href: Column) -> Column:
        return let(
            F.split(markup.plain_attribute(token, "rel"), r"\s+"),
            lambda rel: F.concat(
                F.when(F.array_contains(rel, "stylesheet"), _entries("stylesheet", _one(href))).otherwise(none),
                F.when(
                    F.exists(rel, lambda r: F.contains(F.lower(r), F.lit("icon"))),
                    _entries("icon", _one(href)),
                ).otherwise(none),
            ),
        )

    def of_source(src: Column) -> Column:
        srcset = urls.first_srcset(markup.attribute(token, "srcset"))
        return F.concat(_entries("source", _one(src)), _entries("srcset", _one(srcset)))

    def of_element(name: Column) -> Column:
        main = F.when(name == "link", markup.raw_attribute(token, "href")).when(
            name.isin("img", "source"), markup.raw_attribute(token, "src")
        )
        own = let(
            markup.unquote_value(F.coalesce(main, F.lit(""))),
            lambda value: F.when(name == "link", of_link(value))
            .when(name == "img", _entries("img", _one(value)))
            .when(name == "source", of_source(value))
            .otherwise(none),
        )
        inline = F.when(may_have_style(token, name), _entries("inline", css_urls(markup.attribute(token, "style")))).otherwise(none)
        imports = _entries("import", css_imports(token))
        return F.when(name == "style", imports).otherwise(F.concat(own, inline))

    return let(markup.tag_name(token), of_element)


def is_proxied(kind: Column, ref: Column) -> Column:
    """Image references that go through the resizing endpoint."""
    return kind.isin("img", "srcset") & F.contains(ref, F.lit(fixed.IMAGE_PROXY))


def asset_refs(
    pages: DataFrame, kinds: list[str] | None = None, keep: dict[str, Column] | None = None
) -> DataFrame:
    """All same-site asset references: (page_id, kind, ref, url), one row per kind, ref and page.

    Image-proxy references are replaced by the image they wrap. ``keep`` names expressions over
    the page that each row should carry.
    """
    keep = keep or {}
    found = pages.select(
        "page_id",
        *[value.alias(name) for name, value in keep.items()],
        markup.asset_tokens(F.col("html")).alias("tokens"),
        urls.base_parts(F.col("url")).alias("base"),
    )
    base = F.col("base")
    entries = F.array_distinct(F.flatten(F.transform("tokens", token_refs)))
    wanted = F.filter(
        entries,
        lambda e: is_reference(e["ref"]) & (e["kind"].isin(kinds) if kinds else F.lit(True)),
    )

    def located(entry: Column) -> Column:
        kind, ref = entry["kind"], entry["ref"]
        # A proxy reference without an inner URL is left alone by the page rewrite.
        image = let(
            urls.proxied_target(ref), lambda t: F.when(t != "", F.concat(urls.base_site(base), t))
        )
        target = F.when(is_proxied(kind, ref), image).otherwise(urls.resolve(ref, base))
        return F.struct(kind.alias("kind"), ref.alias("ref"), target.alias("url"))

    kept = F.filter(
        F.transform(wanted, located),
        lambda e: e["url"].isNotNull() & urls.same_site(e["url"], urls.base_authority(base)),
    )
    exploded = found.select("page_id", *keep, F.explode_outer(kept).alias("e"))
    return exploded.where(F.col("e").isNotNull()).select(
        "page_id", *keep, "e.kind", "e.ref", "e.url"
    )


def extract_stylesheets(pages: DataFrame) -> DataFrame:
    return asset_refs(pages, ["stylesheet"])


def extract_media(pages: DataFrame) -> DataFrame:
    return asset_refs(pages, ["img", "source", "srcset"])


def extract_icons(pages: DataFrame) -> DataFrame:
    return asset_refs(pages, ["icon"])


def extract_css_imports(pages: DataFrame) -> DataFrame:
    return asset_refs(pages, ["import"])


def extract_inline_urls(pages: DataFrame) -> DataFrame:
    return asset_refs(pages, ["inline"])


def extract_css_urls(sheets: DataFrame) -> DataFrame:
    """Same-site url(...) references of style sheets (url, body): (css_url, ref, url)."""
    found = sheets.select(
        F.col("url").alias("css_url"),
        F.filter(F.array_distinct(css_urls(F.col("body"))), is_reference).alias("refs"),
        urls.base_parts(F.col("url")).alias("base"),
    )
    base = F.col("base")
    resolved = F.transform(
        "refs", lambda r: F.struct(r.alias("ref"), urls.resolve(r, base).alias("url"))
    )
    kept = F.filter(resolved, lambda e: urls.same_site(e["url"], urls.base_authority(base)))
    exploded = found.select("css_url", F.explode_outer(kept).alias("e"))
    return exploded.where(F.col("e").isNotNull()).select("css_url", "e.ref", "e.url")


def dedupe_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """One row per page key; the smallest spelling stands for it. Combines before the shuffle."""
    keyed = df.select(urls.page_key(F.col(url)).alias("key"), F.col(url).alias("url"))
    return keyed.groupBy("key").agg(F.min("url").alias("url"))

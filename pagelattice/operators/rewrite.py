"""Pages and style sheets rewritten for offline use.

A page is cut once into tokens and the text between them; each token is rewritten on its own and
the page is put together again. Text outside rewritten attributes stays byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.functions import fixed, markup, urls
from pagelattice.functions.binding import let
from pagelattice.operators import extract
from pagelattice.operators.filters import crawlable, is_reference
from pagelattice.operators.joins import resolve_asset_paths
from pagelattice.operators.skew import skew_join
from pagelattice.session import cut_lineage

TokenRule = Callable[[Column, Column], Column]


class _Cut:
    """Pages cut into tokens, rewritten step by step.

    A rule gets each token with its element name, which is read once. Every step is its own
    projection; Catalyst merges them again, but resolves each one alone.
    """

    def __init__(self, pages: DataFrame):
        self.df = pages.withColumns(
            {"_parts": markup.tokens(F.col("html")), "_gaps": markup.between_tokens(F.col("html"))}
        )
        self.step("_names", F.transform("_parts", markup.tag_name))

    def each(self, *rules: TokenRule) -> _Cut:
        for rule in rules:
            self.step("_parts", F.zip_with("_parts", "_names", rule))
        return self

    def step(self, name: str, value: Column) -> _Cut:
        self.df = self.df.withColumn(name, value)
        return self

    def html(self) -> Column:
        return markup.reassemble(F.col("_gaps"), F.col("_parts"))


def drop_scripts_rule(token: Column, name: Column) -> Column:
    """Scripts with a source go, and inline ones of the usual front-end frameworks."""
    body = F.regexp_extract(token, r"(?is)^<script\b[^>]*>(.*)\z", 1)
    framework = let(
        body, lambda b: F.contains(b, F.lit("_next")) | F.contains(F.lower(b), F.lit("react"))
    )
    gone = (name == "script") & (markup.has_attribute(token, "src") | framework)
    return F.when(gone, F.lit("")).otherwise(token)


def drop_preloads_rule(token: Column, name: Column) -> Column:
    gone = (name == "link") & markup.has_rel(token, lambda r: r == "preload")
    return F.when(gone, F.lit("")).otherwise(token)


def drop_attributes_rule(token: Column, name: Column) -> Column:
    """crossorigin off style sheet links, srcset off images with a source."""
    sheet = (
        (name == "link")
        & markup.has_attribute(token, "crossorigin")
        & markup.has_rel(token, lambda r: r == "stylesheet")
    )
    image = (
        (name == "img")
        & markup.has_attribute(token, "srcset")
        & (markup.raw_attribute(token, "src") != "")
    )
    return (
        F.when(sheet, markup.drop_attribute(token, "crossorigin"))
        .when(image, markup.drop_attribute(token, "srcset"))
        .otherwise(token)
    )


def _reveal(style: Column) -> Column:
    opaque = F.regexp_replace(style, r"opacity\s*:\s*0(?![.\d])", "opacity:1")
    return F.regexp_replace(opaque, r"transform\s*:\s*scale\([0-9.]+\)", "transform:scale(1)")


def reveal_hidden_rule(token: Column, name: Column) -> Column:
    return F.when(
        extract.may_have_style(token, name), _with_attribute(token, "style", _reveal)
    ).otherwise(token)


def _append_reveal_style(cut: _Cut) -> Column:
    """The page with the fixed style block at the end of its head.

    The end of the head is a token of its own, so one named in a comment or script is none. Where it
    is not written, the head ends before the body, or with the text.
    """
    style = F.lit(fixed.REVEAL_STYLE)
    ends = F.array_position(F.transform("_parts", lambda t: F.lower(F.left(t, F.lit(6))) == "</head"), F.lit(True))
    head, body = F.array_contains("_names", "head"), F.array_position("_names", F.lit("body"))
    cut.step("_end", F.when(ends > 0, ends).when(head & (body > 0), body).when(head, F.lit(-1)).otherwise(F.lit(0)))
    cut.step("_parts", F.transform("_parts", lambda t, i: F.when(i + 1 == F.col("_end"), F.concat(style, t)).otherwise(t)))
    return F.when(F.col("_end") == -1, F.concat(cut.html(), style)).otherwise(cut.html())


def _relink(cut: _Cut) -> _Cut:
    """Same-site page links become relative paths of their offline files.

    Arrays aligned with the tokens carry the link of each token through the steps, so the work
    grows with the number of tokens.
    """
    base, page = F.col("_base"), F.col("_path")

    def href(token: Column, name: Column) -> Column:
        def value(raw: Column) -> Column:
            url = let(markup.unquote_value(raw), lambda h: F.when(crawlable(h), h))
            return F.when(raw != "", url)

        return F.when(name == "a", let(markup.raw_attribute(token, "href"), value))

    def target(url: Column) -> Column:
        return F.when(urls.same_site(url, urls.base_authority(base)), urls.local_path(url))

    cut.step("_new", F.zip_with("_parts", "_names", href))
    cut.step("_new", urls.resolve_all(F.col("_new"), base))
    cut.step("_new", F.transform("_new", target))
    cut.step("_new", F.transform("_new", lambda file: urls.relative_path(file, page)))
    rewritten = F.zip_with(
        "_parts",
        "_new",
        lambda token, new: F.when(new.isNull(), token).otherwise(
            markup.set_attribute(token, "href", new)
        ),
    )
    return cut.step("_parts", rewritten)


# Marks the entries of proxied references; no reference starts with a line break.
_PROXIED = "\n"


def _moved(ref: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("_refs"), ref), ref)


def _unwrapped(value: Column, ref: Column) -> Column:
    """New value of an image attribute whose first URL is ``ref``."""
    inner = F.try_element_at(F.col("_refs"), F.concat(F.lit(_PROXIED), ref))
    return F.when(F.contains(value, F.lit(fixed.IMAGE_PROXY)), F.coalesce(inner, value)).otherwise(
        _moved(ref)
    )


def _with_attribute(token: Column, name: str, new: Callable[[Column], Column]) -> Column:
    """Token whose attribute, when present, got the value ``new`` makes of it."""

    def change(value: Column) -> Column:
        return let(
            new(value),
            lambda n: F.when(n == value, token).otherwise(markup.set_attribute(token, name, n)),
        )

    return let(
        markup.raw_attribute(token, name),
        lambda raw: F.when(raw == "", token).otherwise(let(markup.unquote_value(raw), change)),
    )


def _replaced(text: Column, refs: Column) -> Column:
    """Every occurrence of every reference replaced, in the order found."""
    return F.aggregate(
        F.filter(F.array_distinct(refs), is_reference),
        text,
        lambda acc, r: F.replace(acc, r, _moved(r)),
    )


def _main_reference_rule(token: Column, name: Column) -> Column:
    linked = markup.has_rel(token, lambda r: (r == "stylesheet") | F.contains(F.lower(r), F.lit("icon")))
    return (
        F.when((name == "link") & linked, _with_attribute(token, "href", _moved))
        .when(name == "img", _with_attribute(token, "src", lambda v: _unwrapped(v, v)))
        .when(name == "source", _with_attribute(token, "src", _moved))
        .when(name == "style", _replaced(token, extract.css_imports(token)))
        .otherwise(token)
    )


def _srcset_rule(token: Column, name: Column) -> Column:
    return F.when(
        name == "source",
        _with_attribute(token, "srcset", lambda v: _unwrapped(v, urls.first_srcset(v))),
    ).otherwise(token)


def _inline_style_rule(token: Column, name: Column) -> Column:
    return F.when(
        extract.may_have_style(token, name),
        _with_attribute(token, "style", lambda s: _replaced(s, extract.css_urls(s))),
    ).otherwise(token)


_ASSET_RULES = (_main_reference_rule, _srcset_rule, _inline_style_rule)


# --- page jobs ------------------------------------------------------------------------------


def _by_rules(pages: DataFrame, *rules: TokenRule) -> DataFrame:
    cut = _Cut(pages.select("page_id", "url", "html")).each(*rules)
    return cut.df.select("page_id", "url", cut.html().alias("html"))


def drop_scripts(pages: DataFrame) -> DataFrame:
    return _by_rules(pages, drop_scripts_rule)


def drop_preloads(pages: DataFrame) -> DataFrame:
    return _by_rules(pages, drop_preloads_rule)


def drop_attributes(pages: DataFrame) -> DataFrame:
    return _by_rules(pages, drop_attributes_rule)


def reveal_hidden(pages: DataFrame) -> DataFrame:
    cut = _Cut(pages.select("page_id", "url", "html")).each(reveal_hidden_rule)
    html = _append_reveal_style(cut)
    return cut.df.select("page_id", "url", html.alias("html"))


def _placed(pages: DataFrame) -> DataFrame:
    """Pages with the pieces that link rewriting needs, computed once per page."""
    return pages.select("page_id", "url", "html").withColumns(
        {"_base": urls.base_parts(F.col("url")), "_path": urls.local_path(F.col("url"))}
    )


def rewrite_links(pages: DataFrame) -> DataFrame:
    cut = _relink(_Cut(_placed(pages)))
    return cut.df.select("page_id", "url", cut.html().alias("html"))


def new_refs_by_page(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """For each page a map from its asset references to their new values: (page_id, _refs).

    Held assets become relative paths, other same-site assets full URLs. What an image-proxy
    reference wraps becomes a relative path, held or not.

    Only the narrow reference table takes part in the look-up; it is stored first, because it is
    read for its heavy keys and for the join. A style sheet shared by a third of all pages is one
    heavy key and is spread over all tasks. The final grouping is bounded by one page.
    """
    page_path = urls.local_path(F.col("url"))
    refs = cut_lineage(extract.asset_refs(pages, keep={"page_path": page_path}))
    moved = resolve_asset_paths(refs, paths)
    proxied = extract.is_proxied(F.col("kind"), F.col("ref"))
    wrapped = urls.relative_path(
        F.regexp_replace(urls.proxied_target(F.col("ref")), "^/+", ""), F.col("page_path")
    )
    entry = F.struct(
        F.when(proxied, F.concat(F.lit(_PROXIED), F.col("ref"))).otherwise(F.col("ref")).alias("ref"),
        F.when(proxied, wrapped).otherwise(F.col("new_ref")).alias("new_ref"),
    )
    return moved.groupBy("page_id").agg(F.map_from_entries(F.collect_set(entry)).alias("_refs"))


def _with_refs(pages: DataFrame, paths: DataFrame) -> DataFrame:
    # Tables bucketed on page_id join here without moving the pages.
    none = F.create_map().cast("map<string,string>")
    joined = _placed(pages).join(new_refs_by_page(pages, paths), "page_id", "left")
    return joined.withColumn("_refs", F.coalesce("_refs", none))


def rewrite_assets(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Asset references of each page replaced; ``paths`` is (url, local_path), one row per URL."""
    cut = _Cut(_with_refs(pages, paths)).each(*_ASSET_RULES)
    return cut.df.select("page_id", "url", cut.html().alias("html"))


def clean_pages(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """All page rewrites in one pass: (page_id, url, local_path, html)."""
    cut = _Cut(_with_refs(pages, paths))
    cut.each(drop_scripts_rule, drop_preloads_rule, *_ASSET_RULES)
    cut.each(drop_attributes_rule, reveal_hidden_rule)
    cut = _relink(cut)
    html = _append_reveal_style(cut)
    return cut.df.select("page_id", "url", F.col("_path").alias("local_path"), html.alias("html"))


# --- style sheets ---------------------------------------------------------------------------


def css_replacements(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """New value of every held reference of every sheet: (css_url, ref, local_path, new_ref).

    Fonts become data URIs, everything else a path relative to the sheet. ``assets`` is
    (url, body). References are stored first, as they are read twice.
    """
    refs = cut_lineage(extract.extract_css_urls(sheets))
    # Only font bodies are carried into the join, one per URL; of several captures the greatest body.
    is_font = urls.font_mime(urls.path(F.col("url"))).isNotNull()
    held = assets.groupBy("url").agg(F.max(F.when(is_font, F.col("body"))).alias("font"))
    held = held.select(
        "url",
        urls.local_path(F.col("url")).alias("local_path"),
        F.replace(F.base64("font"), F.lit("\r\n"), F.lit("")).alias("font"),
    )
    joined = skew_join(refs, held, "url", "inner")
    mime = urls.font_mime(F.col("local_path"))
    relative = urls.relative_path(F.col("local_path"), urls.local_path(F.col("css_url")))
    embedded = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.col("font"))
    return joined.select(
        "css_url", "ref", "local_path", F.coalesce(embedded, relative).alias("new_ref")
    )


def inline_css_fonts(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """Data URIs of the fonts that sheets refer to: (css_url, ref, data_uri)."""
    rows = css_replacements(sheets, assets)
    return rows.where(urls.font_mime(F.col("local_path")).isNotNull()).select(
        "css_url", "ref", F.col("new_ref").alias("data_uri")
    )


def rewrite_css(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """Sheets (url, body) with every occurrence of every held reference replaced.

    References are replaced in the order of their first appearance; the grouping is bounded by
    one sheet.
    """
    changes = (
        css_replacements(sheets, assets)
        .groupBy("css_url", "ref")
        .agg(F.any_value("new_ref").alias("new_ref"))
        .groupBy(F.col("css_url").alias("url"))
        .agg(F.map_from_entries(F.collect_list(F.struct("ref", "new_ref"))).alias("_new"))
    )
    joined = sheets.select("url", "body").join(changes, "url", "left")
    ordered = F.array_distinct(extract.css_urls(F.col("body")))
    body = F.aggregate(
        ordered,
        F.col("body"),
        lambda acc, r: F.coalesce(F.replace(acc, r, F.try_element_at(F.col("_new"), r)), acc),
    )
    return joined.select("url", body.alias("body"))

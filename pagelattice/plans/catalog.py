"""Query catalogue: every operator over the sample tables, as (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelattice import schemas
from pagelattice.functions import text as tx, urls
from pagelattice.operators import (
    crawl,
    extract,
    filters,
    joins,
    reports,
    rewrite,
    robots,
    scan,
    snapshots,
)
from pagelattice.plans import derived as d
from pagelattice.session import cut_lineage, scratch_path
from pagelattice.sources import state as state_io, warc
from pagelattice.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAPTURE_TIME = "TIMESTAMP '2024-02-01 00:00:00'"
SEED_PATHS = ["/assets/logo.png", "/assets/hero.jpg", "/favicon.ico", "/site.css", "/print.css"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _digest(df: DataFrame, *columns: str) -> DataFrame:
    """Long text columns as a digest and a length over the whole text."""
    for name in columns:
        df = df.withColumn(f"{name}_md5", F.md5(name)).withColumn(
            f"{name}_len", F.length(name).cast("bigint")
        )
    return df.drop(*columns)


def _dated(state: DataFrame) -> DataFrame:
    """State rows with the time as text, the same in every engine."""
    return state.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


# --- sources and sinks ----------------------------------------------------------------------


@query
def scan_pages(spark, sf):
    return _digest(d.pages(spark, sf), "html")


@query
def scan_only_html(spark, sf):
    """Pages and assets captured together; only the HTML ones are pages."""
    from pagelattice.sources.pages import only_html

    captures = d.pages(spark, sf).select("url", F.lit("text/html; charset=utf-8").alias("content_type")).unionByName(
        d.assets_v(spark, sf).select("url", "content_type")
    )
    return only_html(captures)


@query
def save_and_load_state(spark, sf):
    path = scratch_path(spark, "state")
    state_io.save_state(d.state_prev_v(spark, sf).where("last_modified is null"), path)
    state_io.save_state(d.state_prev_v(spark, sf), path)
    return _dated(state_io.load_state(spark, path))


@query
def write_warc(spark, sf):
    """Archive all pages, then read the records with their payloads back from the archive."""
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.responses(d.pages(spark, sf)), path)
    return warc.warc_records(warc.read_warc(spark, path))


@query
def warc_records(spark, sf):
    return warc.warc_records(warc.responses(d.pages(spark, sf)))


# --- filters --------------------------------------------------------------------------------


def _categorized(spark, sf):
    assets = d.assets_v(spark, sf)
    return assets.withColumn("category", urls.asset_category(F.col("url"), F.col("content_type")))


@query
def filter_asset_types(spark, sf):
    kept = filters.filter_asset_types(_categorized(spark, sf), ["CSS", "js", "other"], ["JS"])
    return kept.select("asset_id", "url", "category")


@query
def filter_url_patterns(spark, sf):
    kept = filters.filter_url_patterns(
        d.assets_v(spark, sf), [r"src1[0-9]*\.", r"/static/[0-9]*7\b"], [r"\.png$", r"src11\."]
    )
    return kept.select("asset_id", "url")


@query
def filter_size(spark, sf):
    return filters.filter_size(d.assets_v(spark, sf), min_kb=1, max_kb=4).select("asset_id", "url")


@query
def filter_same_site(spark, sf):
    hrefs = d.hrefs_v(spark, sf)
    resolved = hrefs.withColumn("url", urls.normalize_url(F.col("href"), F.col("src")))
    return filters.filter_same_site(resolved, "url", "src").select("page_id", "form", "url")


@query
def filter_crawlable_href(spark, sf):
    return filters.filter_crawlable_href(d.hrefs_v(spark, sf)).select("page_id", "form", "href")


@query
def filter_data_uri(spark, sf):
    return filters.filter_data_uri(d.hrefs_v(spark, sf), "href").select("page_id", "form", "href")


@query
def filter_email_noise(spark, sf):
    docs = d.table(spark, sf, "documents")
    ending = F.when(F.col("doc_id") % 3 == 0, "@2x.PNG.example.com").otherwise("@example.org")
    email = F.concat("source", ending).alias("email")
    return docs.select("doc_id", email).where(filters.is_address(F.col("email")))


@query
def filter_comment_noise(spark, sf):
    docs = d.table(spark, sf, "documents")
    note = F.when(F.col("doc_id") % 4 == 0, "Copyright ").when(F.col("doc_id") % 4 == 1, "sourceMappingURL ").otherwise("")
    text = tx.strip_text(F.concat(note, F.col("lang"), F.lit("  "), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")))
    rows = docs.select("doc_id", text.alias("comment"))
    return rows.select(
        "doc_id",
        "comment",
        filters.is_html_remark(F.col("comment")).alias("html_keeps"),
        filters.is_code_remark(F.col("comment")).alias("code_keeps"),
    )


# --- look-ups -------------------------------------------------------------------------------


def _captured(spark, sf):
    """Captured pages of the synthetic link graph."""
    return d.pages(spark, sf).select(
        F.concat(F.lit("https://s.example.com/p/"), F.col("page_id").cast("string")).alias("url")
    )


@query
def unvisited(spark, sf):
    return joins.unvisited(d.edges_v(spark, sf), _captured(spark, sf))


@query
def resolve_asset_paths(spark, sf):
    page = d.rich_pages_v(spark, sf)
    refs = cut_lineage(extract.asset_refs(page, keep={"page_path": urls.local_path(F.col("url"))}))
    return joins.resolve_asset_paths(refs, joins.asset_paths(d.page_assets_v(spark, sf))).select(
        "page_id", "kind", "ref", "new_ref"
    )


@query
def conditional_headers(spark, sf):
    return joins.conditional_headers(d.pages(spark, sf), d.state_prev_v(spark, sf))


@query
def robots_allowed(spark, sf):
    page = d.pages(spark, sf).select("page_id", "url")
    return robots.robots_allowed(page, d.robots_rules_v(spark, sf)).select("page_id", "url", "allowed")


def _captures(spark, sf):
    return snapshots.page_captures(d.pages(spark, sf), F.expr(CAPTURE_TIME))


@query
def snapshot_diff(spark, sf):
    """All pages against the state, which also knows a URL per page that is gone since."""
    before = d.state_prev_v(spark, sf)
    gone = before.withColumn("url", F.concat("url", F.lit("#gone")))
    return snapshots.snapshot_diff(_captures(spark, sf), before.unionByName(gone))


@query
def changed_captures(spark, sf):
    return snapshots.changed_captures(_captures(spark, sf), d.state_prev_v(spark, sf)).select("url", "etag")


@query
def seed_assets(spark, sf):
    sites = d.hosts_v(spark, sf).select(F.concat(F.lit("https://"), F.col("host")).alias("site"))
    held = sites.where(F.col("site").contains("blog.")).select(F.concat("site", F.lit("/favicon.ico")).alias("url"))
    chosen = filters.AssetFilter(include_types=["image", "css"], exclude_patterns=["print"])
    return joins.seed_assets(sites, SEED_PATHS, held, chosen)


@query
def inline_css_fonts(spark, sf):
    rows = rewrite.inline_css_fonts(d.css_v(spark, sf), d.css_assets_v(spark, sf))
    return _digest(rows, "data_uri")


# --- aggregations ---------------------------------------------------------------------------


def _findings(spark, sf):
    return scan.all_findings(d.texts_v(spark, sf).unionByName(scan.asset_texts(d.assets_v(spark, sf))))


@query
def findings_summary(spark, sf):
    return reports.findings_summary(_findings(spark, sf))


@query
def findings_by_site(spark, sf):
    return reports.findings_by_site(_findings(spark, sf))


@query
def distinct_emails(spark, sf):
    return reports.distinct_emails(scan.scan_emails(d.texts_v(spark, sf)))


def _summary_inputs(spark, sf):
    page = d.pages(spark, sf)
    skipped = robots.skipped_urls(page, d.robots_rules_v(spark, sf))
    return page, joins.asset_paths(d.page_assets_v(spark, sf)), skipped


@query
def crawl_summary(spark, sf):
    return reports.crawl_summary(*_summary_inputs(spark, sf))


@query
def crawl_listing(spark, sf):
    return reports.crawl_listing(*_summary_inputs(spark, sf))


@query
def robots_report(spark, sf):
    report = robots.robots_report(d.robots_txt_v(spark, sf))
    return report.select(
        "host",
        "crawl_delay",
        F.col("disallowed").cast("bigint").alias("disallowed"),
        F.array_join("disallowed_paths", " | ").alias("first_paths"),
    )


@query
def crawl_delay(spark, sf):
    return robots.crawl_delay(d.robots_txt_v(spark, sf))


@query
def effective_delay(spark, sf):
    return robots.effective_delay(robots.crawl_delay(d.robots_txt_v(spark, sf)), 0.3)


@query
def upsert_state(spark, sf):
    return _dated(snapshots.upsert_state(d.state_prev_v(spark, sf), _captures(spark, sf)))


@query
def dedupe_urls(spark, sf):
    return extract.dedupe_urls(d.pages(spark, sf))


@query
def parse_rules(spark, sf):
    rules = robots.parse_rules(d.robots_txt_v(spark, sf))
    return rules.select("host", F.col("rule_order").cast("bigint").alias("rule_order"), "allow", "path")


# --- rankings -------------------------------------------------------------------------------


@query
def top_comments(spark, sf):
    texts = scan.page_texts(d.pages(spark, sf)).unionByName(scan.asset_texts(d.assets_v(spark, sf)))
    top = reports.top_comments(scan.scan_comments(texts))
    return top.withColumn("length", F.col("length").cast("bigint"))


@query
def sorted_emails(spark, sf):
    return reports.sorted_emails(scan.scan_emails(d.texts_v(spark, sf)))


@query
def sorted_urls(spark, sf):
    return reports.sorted_urls(d.pages(spark, sf))


@query
def sitemap(spark, sf):
    return reports.sitemap(d.pages(spark, sf))


@query
def first_n_per_site(spark, sf):
    rules = robots.parse_rules(d.robots_txt_v(spark, sf))
    first = reports.first_n_per_site(rules, 2)
    return first.select("host", F.col("rule_order").cast("bigint").alias("rule_order"), "path")


# --- set operations -------------------------------------------------------------------------


@query
def all_findings(spark, sf):
    found = _findings(spark, sf)
    return _digest(found.select("kind", "type", "value", "source"), "value")


@query
def asset_refs(spark, sf):
    return extract.asset_refs(d.rich_pages_v(spark, sf))


@query
def dangling_links(spark, sf):
    page = d.pages(spark, sf)
    first = page.where(F.col("page_id") % 2 == 0).select(F.col("url").alias("src"), urls.captured_key(F.col("url")).alias("dst"))
    links = extract.extract_links(page).select("src", "dst").unionByName(first)
    return joins.dangling_links(cut_lineage(links), page)


# --- scalar functions -----------------------------------------------------------------------


@query
def normalize_url(spark, sf):
    url = urls.normalize_url(F.col("href"), F.col("src"))
    return d.hrefs_v(spark, sf).select("page_id", "form", url.alias("url"))


@query
def page_key(spark, sf):
    page = d.pages(spark, sf).select("page_id", "url", urls.page_key(F.col("url")).alias("key"))
    return page.withColumn("captured", urls.captured_key(F.col("url")))


@query
def asset_category(spark, sf):
    return _categorized(spark, sf).select("asset_id", "url", "category")


@query
def file_extension(spark, sf):
    ext = urls.file_extension(F.col("url"), F.col("content_type"))
    return d.assets_v(spark, sf).select("asset_id", ext.alias("extension"))


@query
def local_path(spark, sf):
    links = extract.extract_links(d.pages(spark, sf)).select(F.col("dst").alias("url"))
    both = d.pages(spark, sf).select("url").unionByName(links).distinct()
    return both.select("url", urls.local_path(F.col("url")).alias("local_path"))


@query
def image_proxy_path(spark, sf):
    return d.hrefs_v(spark, sf).select("page_id", "form", urls.image_proxy_path(F.col("href")).alias("path"))


@query
def unwrap_image_proxy(spark, sf):
    site = F.lit("https://s.example.com")
    return d.hrefs_v(spark, sf).select(
        "page_id", "form", urls.unwrap_image_proxy(F.col("href"), site).alias("url")
    )


@query
def first_srcset(spark, sf):
    i = F.col("page_id").cast("string")
    plain = F.concat(F.lit(" /i/"), i, F.lit(".png, /j.png 2x"))
    proxied = F.concat(F.lit("/_next/image?url=%2Fa"), i, F.lit(".png,/b 2x"))
    srcset = F.when(F.col("page_id") % 2 == 0, plain).otherwise(proxied)
    return d.pages(spark, sf).select("page_id", urls.first_srcset(srcset).alias("first"))


@query
def relative_path(spark, sf):
    page = urls.local_path(F.col("url"))
    target = F.concat(F.regexp_extract(page, "^([^/]*)/", 1), F.lit("/x.css"))
    return d.pages(spark, sf).select(
        "page_id",
        urls.relative_path(target, page).alias("sibling"),
        urls.relative_path(F.lit("s/a.css"), page).alias("cousin"),
    )


@query
def site_key(spark, sf):
    return d.pages(spark, sf).select("page_id", urls.site_key(F.col("url")).alias("site_key"))


@query
def redact(spark, sf):
    docs = d.table(spark, sf, "documents")
    return docs.select("doc_id", tx.redact(F.col("text")).alias("redacted"))


@query
def font_mime(spark, sf):
    return d.assets_v(spark, sf).select("asset_id", urls.font_mime(urls.path(F.col("url"))).alias("mime"))


@query
def strip_text(spark, sf):
    docs = d.table(spark, sf, "documents")
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\r\n\t "))
    return _digest(docs.select("doc_id", tx.strip_text(padded).alias("text")), "text")


# --- extraction -----------------------------------------------------------------------------


@query
def extract_links(spark, sf):
    return extract.extract_links(d.pages(spark, sf))


@query
def extract_stylesheets(spark, sf):
    return extract.extract_stylesheets(d.rich_pages_v(spark, sf)).select("page_id", "ref", "url")


@query
def extract_media(spark, sf):
    return extract.extract_media(d.rich_pages_v(spark, sf))


@query
def extract_icons(spark, sf):
    return extract.extract_icons(d.rich_pages_v(spark, sf)).select("page_id", "ref", "url")


@query
def extract_css_urls(spark, sf):
    return extract.extract_css_urls(d.css_v(spark, sf))


@query
def extract_inline_urls(spark, sf):
    return extract.extract_inline_urls(d.rich_pages_v(spark, sf)).select("page_id", "ref", "url")


@query
def extract_css_imports(spark, sf):
    return extract.extract_css_imports(d.rich_pages_v(spark, sf)).select("page_id", "ref", "url")


# --- scanning -------------------------------------------------------------------------------


@query
def scan_emails(spark, sf):
    return scan.scan_emails(d.texts_v(spark, sf)).select("source", F.col("value").alias("email"))


def _secret_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "source", "type", "value", "value_sha256", F.col("start").cast("bigint").alias("start"), "snippet"
    )


@query
def scan_secrets(spark, sf):
    return _secret_rows(scan.scan_secrets(d.texts_v(spark, sf)))


@query
def scan_secrets_all_types(spark, sf):
    return _secret_rows(scan.scan_secrets(d.leaky_texts_v(spark, sf)))


@query
def scan_html_comments(spark, sf):
    found = scan.scan_html_comments(scan.page_texts(d.pages(spark, sf)))
    return found.select("source", F.col("value").alias("comment"))


@query
def scan_js_css_comments(spark, sf):
    found = scan.scan_js_css_comments(scan.asset_texts(d.assets_v(spark, sf)))
    return found.select("source", F.col("value").alias("comment"))


@query
def decode_body(spark, sf):
    """Texts as bytes, every third one with a byte that is not UTF-8."""
    bad = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    body = F.concat(F.col("text").cast("binary"), bad)
    docs = d.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return _digest(scan.decode_captures(docs).select("doc_id", "text"), "text")


# --- rewriting ------------------------------------------------------------------------------


@query
def drop_scripts(spark, sf):
    return _digest(rewrite.drop_scripts(d.rich_pages_v(spark, sf)), "html")


@query
def drop_preloads(spark, sf):
    return _digest(rewrite.drop_preloads(d.rich_pages_v(spark, sf)), "html")


@query
def drop_attributes(spark, sf):
    return _digest(rewrite.drop_attributes(d.rich_pages_v(spark, sf)), "html")


@query
def reveal_hidden(spark, sf):
    return _digest(rewrite.reveal_hidden(d.rich_pages_v(spark, sf)), "html")


@query
def rewrite_links(spark, sf):
    return _digest(rewrite.rewrite_links(d.pages(spark, sf)), "html")


@query
def rewrite_assets(spark, sf):
    paths = joins.asset_paths(d.page_assets_v(spark, sf))
    return _digest(rewrite.rewrite_assets(d.rich_pages_v(spark, sf), paths), "html")


@query
def rewrite_css(spark, sf):
    return _digest(rewrite.rewrite_css(d.css_v(spark, sf), d.css_assets_v(spark, sf)), "body")


@query
def clean_pages(spark, sf):
    paths = joins.asset_paths(d.page_assets_v(spark, sf))
    return _digest(rewrite.clean_pages(d.rich_pages_v(spark, sf), paths), "html")


# --- graph and streams ----------------------------------------------------------------------


def _seed(spark, sf):
    return _captured(spark, sf).where(F.endswith(F.col("url"), F.lit("/p/0")))


def _graph_rules(spark, sf):
    """Rules of the synthetic site, derived with its pages."""
    site = d.pages(spark, sf).select(F.lit("s.example.com").alias("host")).distinct()
    return site.select("host", F.inline(d.fixed_rules((True, "/p/30"), (False, "/p/3"))))


@query
def crawl_order(spark, sf):
    order = crawl.crawl_order(d.edges_v(spark, sf), _seed(spark, sf))
    return order.withColumn("depth", F.col("depth").cast("bigint"))


@query
def crawl_order_with_rules(spark, sf):
    met = crawl.crawl_frontier(d.edges_v(spark, sf), _seed(spark, sf), _graph_rules(spark, sf))
    return met.withColumn("depth", F.col("depth").cast("bigint"))


@query
def crawl_sites(spark, sf):
    """All captured sites traversed together, each from one page."""
    links = extract.extract_links(d.pages(spark, sf))
    order = crawl.crawl_order(crawl.page_edges(links), _host_seeds(spark, sf), d.robots_rules_v(spark, sf))
    return order.withColumn("depth", F.col("depth").cast("bigint"))


@query
def skipped_urls(spark, sf):
    return robots.skipped_urls(d.pages(spark, sf), d.robots_rules_v(spark, sf))


def _stream(spark, sf):
    # As a glob, since the table is one file or a folder of them and a stream takes no plain path of a file.
    return jobs.read_captures(spark, f"{sf}/{{pages.parquet}}", "*")


@query
def stream_state(spark, sf):
    path = scratch_path(spark, "state")
    state_io.save_state(d.state_prev_v(spark, sf), path)
    jobs.stream_state(
        _stream(spark, sf), path, scratch_path(spark, "offsets"), F.expr(CAPTURE_TIME)
    ).awaitTermination()
    return _dated(state_io.load_state(spark, path))


@query
def stream_findings(spark, sf):
    out = scratch_path(spark, "findings")
    jobs.stream_findings(_stream(spark, sf), out, scratch_path(spark, "offsets")).awaitTermination()
    found = spark.read.schema(schemas.FINDINGS).parquet(out)
    return found.select("kind", "type", "value", "source")


@query
def stream_dedupe(spark, sf):
    out = scratch_path(spark, "captures")
    jobs.stream_dedupe(_stream(spark, sf), out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("key")


# --- the whole run --------------------------------------------------------------------------


def _host_seeds(spark, sf):
    """One captured page of each host, from which its site is traversed."""
    key = urls.captured_key(F.col("url"))
    return d.pages(spark, sf).groupBy(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).agg(F.min(key).alias("url")).select("url")


def _mirror(spark, sf, pages=None, assets=None, **options):
    """A run under the sites' robots files from one page of each, after one that left ``state_prev_v``."""
    from pagelattice.plans.mirror import Options, mirror

    out = scratch_path(spark, "mirror")
    state_io.save_state(d.state_prev_v(spark, sf), f"{out}/state")
    pages = d.pages(spark, sf) if pages is None else pages
    assets = d.assets_v(spark, sf).select("url", "content_type", "body") if assets is None else assets
    tables = mirror(pages, assets, d.robots_txt_v(spark, sf), _host_seeds(spark, sf), out, F.expr(CAPTURE_TIME), Options(**options))
    return out, tables


@query
def mirror_pages(spark, sf):
    """Pages that the run rewrote: those it reached and had not seen as they are now."""
    assets = d.page_assets_v(spark, sf).select("url", F.lit("application/octet-stream").alias("content_type"), F.lit("").alias("body"))
    return _digest(_mirror(spark, sf, d.rich_pages_v(spark, sf), assets)[1]["pages"], "html")


@query
def mirror_findings(spark, sf):
    """Findings of the run in new and changed pages and assets."""
    found = _mirror(spark, sf, recon=True)[1]["findings"]
    return _digest(found.select("kind", "type", "value", "source"), "value")


@query
def mirror_state(spark, sf):
    """State after the run: pages and assets, those unchanged with their old time."""
    return _dated(_mirror(spark, sf)[1]["state"]).select("url", "etag", "content_type", "ts")


@query
def mirror_archive(spark, sf):
    """Records in the archive of the run: new and changed pages and assets, read back with their payloads."""
    out, _ = _mirror(spark, sf, export_warc=True)
    return warc.warc_records(warc.read_warc(spark, f"{out}/warc/run=1")).drop("warc_type", "status_line")

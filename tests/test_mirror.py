"""A whole run over two small sites, and the run after it."""

import glob
import gzip

from pyspark.sql import functions as F

from pagelattice.operators.filters import AssetFilter
from pagelattice.plans.mirror import Options, mirror

PAGES = [
    (1, "http://a.x/", '<head><link rel="stylesheet" href="/s.css"></head><a href="/p">p</a><a href="/private/x">x</a><!-- todo list -->'),
    (2, "http://a.x/p?ref=1", '<a href="/deep/q">q</a><img src="/i.png"><img src="/big.png"> me@a.org'),
    (3, "http://a.x/deep/q", '<a href="/">home</a>'),
    (4, "http://a.x/orphan", "<p>nobody links here"),
    (5, "http://b.x", '<a href="http://a.x/">other site</a><a href="/missing">gone</a>'),
]
ASSETS = [
    ("http://a.x/s.css", "text/css", "b{x:url(/i.png)} /* remark one */"),
    ("http://a.x/i.png", "image/png", "PNG"),
    ("http://a.x/big.png", "image/png", "P" * 3000),
]
ROBOTS = [("a.x", "User-agent: *\nDisallow: /private\nCrawl-delay: 2"), ("b.x", "")]


def run(spark, out, pages, stamp, **options):
    return mirror(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"),
        spark.createDataFrame(ASSETS, "url string, content_type string, body string"),
        spark.createDataFrame(ROBOTS, "host string, body string"),
        spark.createDataFrame([("http://a.x/",), ("http://b.x/",)], "url string"),
        out,
        F.expr(f"TIMESTAMP '{stamp}'"),
        Options(recon=True, export_warc=True, asset_filter=AssetFilter(max_kb=2), seed_paths=["/i.png", "/n.css"], **options),
    )


def test_two_runs(spark, tmp_path):
    out = str(tmp_path)
    first = run(spark, out, PAGES, "2024-01-01 00:00:00")
    met = {(r.url, r.depth, r.allowed) for r in first["crawl"].collect()}
    assert met == {
        ("http://a.x/", 0, True), ("http://b.x/", 0, True), ("http://a.x/p", 1, True), ("http://a.x/private/x", 1, False),
        ("http://b.x/missing", 1, True), ("http://a.x/deep/q", 2, True),
    }
    html = {r.page_id: (r.local_path, r.html) for r in first["pages"].collect()}
    assert set(html) == {1, 2, 3, 5}
    assert 'href="s.css"' in html[1][1] and 'href="p.html"' in html[1][1]
    assert html[2] == ("p.html", '<a href="deep/q.html">q</a><img src="i.png"><img src="http://a.x/big.png"> me@a.org')
    assert html[3] == ("deep/q.html", '<a href="../index.html">home</a>')
    assert [r.body for r in first["css"].collect()] == ["b{x:url(i.png)} /* remark one */"]
    assert first["summary"].collect()[0].asDict() == {"secrets": 0, "emails": 1, "comments": 2}
    assert {r.host: r.delay for r in first["delays"].collect()} == {"a.x": 2.0, "b.x": 0.3}
    assert {r.url for r in first["wanted_assets"].collect()} == {"http://a.x/n.css", "http://b.x/n.css", "http://b.x/i.png"}
    assert first["state"].count() == 6
    records = b"".join(gzip.open(f).read() for f in glob.glob(f"{out}/warc/run=0/*.warc.gz"))
    assert records.count(b"WARC/1.0\r\n") == 6 and b"WARC-Target-URI: http://a.x/i.png\r\n" in records

    changed = [p if p[0] != 3 else (3, p[1], "<p>new text") for p in PAGES]
    second = run(spark, out, changed, "2024-02-01 00:00:00")
    assert [(r.page_id, r.html) for r in second["pages"].collect()] == [(3, "<p>new text")]
    assert second["css"].count() == 0
    records = b"".join(gzip.open(f).read() for f in glob.glob(f"{out}/warc/run=1/*.warc.gz"))
    assert records.count(b"WARC/1.0\r\n") == 1
    stamps = {r.url: str(r.ts) for r in second["state"].collect()}
    assert stamps["http://a.x/deep/q"].startswith("2024-02") and stamps["http://a.x/"].startswith("2024-01")
    assert second["crawl"].count() == 6


def test_without_robots_and_state(spark, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        tables = run(spark, out, PAGES, "2024-01-01 00:00:00", respect_robots=False, incremental=False, max_depth=1)
        assert {r.page_id for r in tables["pages"].collect()} == {1, 2, 5}
        assert "state" not in tables
        records = b"".join(gzip.open(f).read() for f in glob.glob(f"{out}/warc/run=0/*.warc.gz"))
        assert records.count(b"WARC/1.0\r\n") == 5
        assert "http://a.x/private/x" in {r.url for r in tables["sitemap"].collect()}

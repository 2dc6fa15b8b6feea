"""Reading and rewriting of pages, on awkward markup."""

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import fixed
from pagelattice.operators import extract, joins, rewrite

URL = "http://h.x/dir/page"


def pages(spark, *htmls, url=URL):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def links(spark, html):
    return sorted(r.dst for r in extract.extract_links(pages(spark, html)).collect())


def refs(spark, html):
    return sorted((r.kind, r.ref, r.url) for r in extract.asset_refs(pages(spark, html)).collect())


def test_links_of_awkward_tags(spark):
    html = """<A HREF='/single'>x</A><a class="x>y" data-href="/no" href = "/gt?q=1">y</a><a href=/bare>z</a>
    <!-- <a href="/commented">no</a> --><script>var s = '<a href="/scripted">';</script>
    <a title=" href=/fake " href="/amp?a=1&amp;b=2#f">q</a><a href="/amp">again</a><abbr href="/abbr">no</abbr>
    <a hreflang="en" href="rel">r</a><a href="">self</a><a href="#top">t</a><a href="mailto:a@b.c">m</a>
    <a href="https://other.x/">o</a><a href="//h.x/secure">s</a><a name="anchor">n</a><a href="/unclosed"""
    assert links(spark, html) == [
        "http://h.x/amp", "http://h.x/bare", "http://h.x/dir/page", "http://h.x/dir/rel", "http://h.x/gt",
        "http://h.x/single", "https://h.x/secure",
    ]


def test_mostly_broken_page_is_linear(spark):
    html = "<a " * 20000 + "<!--" * 2000 + "<a title='" + "x" * 200000 + '<a href="/late">'
    assert extract.extract_links(pages(spark, html)).count() <= 1


def test_asset_references(spark):
    html = """<link rel="preload stylesheet" href="/a.css"><link rel="SHORTCUT ICON" href='/i.ico'>
    <link rel=canonical href=/no><img src="/p.png" srcset="/q.png 2x"><img src="data:x"><img alt="no">
    <img src="/_next/image?url=%2Fhero.png&amp;w=1"><img src="/_next/image?w=1">
    <source src="/v.mp4" srcset="/s.webp 1x, /t.webp 2x"><style>@import '/base.css'; @import "data:x";</style>
    <p style="background:url('/bg.jpg'); mask: url(&quot;m.svg&quot;)">x</p><img src="http://cdn.x/no.png">"""
    assert refs(spark, html) == [
        ("icon", "/i.ico", "http://h.x/i.ico"),
        ("img", "/_next/image?url=%2Fhero.png&w=1", "http://h.x/hero.png"),
        ("img", "/p.png", "http://h.x/p.png"),
        ("import", "/base.css", "http://h.x/base.css"),
        ("inline", "/bg.jpg", "http://h.x/bg.jpg"),
        ("inline", "m.svg", "http://h.x/dir/m.svg"),
        ("source", "/v.mp4", "http://h.x/v.mp4"),
        ("srcset", "/s.webp", "http://h.x/s.webp"),
        ("stylesheet", "/a.css", "http://h.x/a.css"),
    ]


def one(df):
    return df.collect()[0]["html"]


def test_drop_scripts(spark):
    html = """<script src="/a.js"></script><SCRIPT>var React=1</SCRIPT><script id="react">keep()</script>
<script>x._next</script><script>x._NEXT</script><script src="">kept</script><p>"""
    assert one(rewrite.drop_scripts(pages(spark, html))) == (
        '<script id="react">keep()</script>\n<script>x._NEXT</script><script src="">kept</script><p>'
    )


def test_drop_preloads_and_attributes(spark):
    html = '<link rel="preload" href="/x"><link rel="a preload"><link rel="preloader"><link href="/s" crossorigin=x rel="stylesheet"><link rel="icon" crossorigin="x"><img srcset="a 1x" src="b"><img srcset="a 1x">'
    assert one(rewrite.drop_preloads(pages(spark, html))).startswith('<link rel="preloader">')
    assert one(rewrite.drop_attributes(pages(spark, html))).endswith(
        '<link href="/s" rel="stylesheet"><link rel="icon" crossorigin="x"><img src="b"><img srcset="a 1x">'
    )


def test_reveal_hidden(spark):
    html = '<head></head><p style="opacity:0">a</p><p style="opacity:0.5;transform: scale(0.9)">b</p><style>p{opacity:0}</style>opacity:0'
    assert one(rewrite.reveal_hidden(pages(spark, html))) == (
        f'<head>{fixed.REVEAL_STYLE}</head><p style="opacity:1">a</p><p style="opacity:0.5;transform:scale(1)">b</p>'
        "<style>p{opacity:0}</style>opacity:0"
    )


def test_rewrite_links(spark):
    html = """<a href="/">home</a><a class=x href='/dir/next?q=1#f'>n</a><a href="http://o.x/">o</a><a href="#t">t</a><!--<a href="/">-->$1 \\ <a href="/a$1.css">d</a>"""
    assert one(rewrite.rewrite_links(pages(spark, html))) == (
        """<a href="../index.html">home</a><a class=x href="next.html">n</a><a href="http://o.x/">o</a><a href="#t">t</a><!--<a href="/">-->$1 \\ <a href="../a$1.css">d</a>"""
    )


def paths(spark, *urls_):
    return joins.asset_paths(spark.createDataFrame([(u,) for u in urls_], "url string"))


def test_rewrite_assets(spark):
    held = paths(spark, "http://h.x/a.css", "http://h.x/p.png", "http://h.x/bg.jpg", "http://h.x/s.webp")
    html = """<link rel="stylesheet" href="/a.css"><link rel=icon href=/i.ico><img src="/p.png"><img src="http://cdn.x/p.png">
<img src="/_next/image?url=%2Fhero.png&amp;w=1"><img src="/_next/image?w=1"><source srcset="/s.webp 1x, /t 2x">
<style>@import "/a.css";</style><p style="a:url(/bg.jpg) b:url(/bg.jpg) c:url(data:x)">"""
    assert one(rewrite.rewrite_assets(pages(spark, html), held)) == (
        """<link rel="stylesheet" href="../a.css"><link rel=icon href="http://h.x/i.ico"><img src="../p.png"><img src="http://cdn.x/p.png">
<img src="../hero.png"><img src="/_next/image?w=1"><source srcset="../s.webp">
<style>@import "../a.css";</style><p style="a:url(../bg.jpg) b:url(../bg.jpg) c:url(data:x)">"""
    )


def test_pages_without_assets_survive(spark):
    assert one(rewrite.rewrite_assets(pages(spark, "<p>plain"), paths(spark, "http://h.x/a.css"))) == "<p>plain"
    assert rewrite.clean_pages(pages(spark, "", "<b>", "no tags"), paths(spark)).count() == 3


def test_rewrite_css(spark):
    sheets = spark.createDataFrame(
        [("http://h.x/c/s.css", "a{x:url(../f/a.woff2)} b{y:url('../i.png')} c{z:url(/gone.png)} d{url(../f/a.woff2)}"), ("http://h.x/e.css", "b{}")],
        "url string, body string",
    )
    assets = spark.createDataFrame([("http://h.x/f/a.woff2", "FONT" * 40), ("http://h.x/i.png", "IMG")], "url string, body string")
    got = {r.url: r.body for r in rewrite.rewrite_css(sheets, assets).collect()}
    import base64

    font = "data:font/woff2;base64," + base64.b64encode(b"FONT" * 40).decode()
    assert got["http://h.x/c/s.css"] == f"a{{x:url({font})}} b{{y:url('../i.png')}} c{{z:url(/gone.png)}} d{{url({font})}}"
    assert got["http://h.x/e.css"] == "b{}"


def test_character_references(spark, column):
    import html

    values = ["a&#47;b", "&#038;x", "&#x2F;&#X2f;", "caf&eacute;&nbsp;x", "&amp;lt;", "&#128;&#0;&#x110000;&#xD800;", "&nosuch;&", "&;&#;", "&apos;&quot;", "plain"]
    from pagelattice.functions import markup

    got = column("v string", [(v,) for v in values], markup.decode_references(F.col("v")))
    assert got == [html.unescape(v) for v in values]


@pytest.mark.parametrize("opening", ["<script>", "<style>", "<!-- ", "<a b ", "x <b y ", "/* a ", "// a ", "<a href='", '<a b="'])
def test_unclosed_markup_takes_linear_time(spark, opening):
    import time

    from pagelattice.operators import extract, rewrite, scan

    page = spark.createDataFrame([(1, "http://h.x/", opening * (1_000_000 // len(opening)))], "page_id long, url string, html string")
    captures = page.select(F.col("url").alias("source"), F.col("html").alias("text"), F.lit("text/css").alias("content_type"))
    start = time.time()
    extract.extract_links(page).collect()
    extract.asset_refs(page).collect()
    rewrite.drop_scripts(page).collect()
    scan.scan_js_css_comments(captures).collect()
    scan.scan_html_comments(captures).collect()
    assert time.time() - start < 60


def test_css_urls_are_those_of_the_plain_pattern(spark, column):
    import random
    import re

    from pagelattice.functions import fixed
    from pagelattice.operators import extract

    rng = random.Random(3)
    parts = ["url(", "url(", '"', "'", ")", " ", "a", "b/c", "\n", "(", "ur", "l("]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["url(aurl('x')", "url(\"url('x')", 'url("")', "url(a url(b)", "url('a\")", "url(aurl(b)c)"]
    got = column("v string", [(t,) for t in texts], extract.css_urls(F.col("v")))
    assert got == [re.findall(fixed.CSS_URL_PATTERN, t) for t in texts]


@pytest.mark.parametrize("opening", ["url(", "url('", "url(a ", "url(a'", "@import 'a "])
def test_unclosed_references_take_linear_time(spark, opening):
    """A megabyte within seconds, and twice as much within three times as long."""
    import time

    from pagelattice.operators import extract

    took = []
    for size in (1_000_000, 1_000_000, 2_000_000):
        sheet = spark.createDataFrame([("http://h.x/a.css", opening * (size // len(opening)))], "url string, body string")
        start = time.time()
        extract.extract_css_urls(sheet).collect()
        sheet.select(extract.css_imports(F.col("body"))).collect()
        took.append(time.time() - start)
    assert took[1] < 5 and took[2] < 3 * took[1] + 1


def test_reveal_style_place(spark):
    from pagelattice.functions import fixed
    from pagelattice.operators import rewrite

    pages = [
        "<html><head><!-- </head> --><script>var a='</head>'</script></head><body></body></html>",
        "<html><head><title>x</title><body>y</body></html>",
        "<p>no head</p>",
    ]
    frame = spark.createDataFrame([(i, "http://h.x/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.html for r in rewrite.reveal_hidden(frame).collect()}
    style = fixed.REVEAL_STYLE
    assert got[0] == pages[0].replace("</script></head>", f"</script>{style}</head>")
    assert got[1] == pages[1].replace("<body>", f"{style}<body>")
    assert got[2] == pages[2]

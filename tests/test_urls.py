"""URL expressions against the standard library."""

import itertools
import os
from urllib.parse import parse_qs, unquote, urljoin, urlparse

from pyspark.sql import functions as F

from pagelattice.functions import urls

HREFS = [
    "//c.x/a", "../b?q=1#f", "?p=2", "a", "./a", "../../..", "..", ".", "/a//b", "a/", "/a/./b/../c",
    "#x", "", "http://o.y/a/../b#f", "HTTP://o.y/A", "x.html?", "/?", "a;p=1", "/a/b/..", "../x/",
    "http:rel", "https:rel", "mailto:a@b", "data:xx", " /lead", "a b", "/ü?q=ä", "a\nb", "/..",
    "/../../q", "a?x#y?z", ".../x", "/.hid/x", "?", "b?a=../c", "g:h", "1:2", "/a:b", "a//b/../c",
    "/$1\\n", "/a//../b",
]
BASES = [
    "http://h.x/", "http://h.x", "http://h.x/a/c/d", "http://h.x/a/c/d?q=1#t", "HTTP://h.x/a;p/b",
    "https://u@h.x:80/a//c/./d",
]


def normalized(href, base):
    if href.startswith("//"):
        href = "https:" + href
    return urlparse(urljoin(base, href))._replace(fragment="").geturl()


def test_normalize_url_agrees_with_the_standard_library(column):
    rows = list(itertools.product(HREFS, BASES))
    got = column("h string, b string", rows, urls.normalize_url(F.col("h"), F.col("b")))
    wrong = [(r, g, normalized(*r)) for r, g in zip(rows, got) if g != normalized(*r)]
    assert wrong == []


def test_normalize_url_literal_rows(column):
    rows = [("//c.x/a", "http://h.x/"), ("../b?q=1#f", "http://h.x/a/c/d"), ("?p=2", "http://h.x/a")]
    got = column("h string, b string", rows, urls.normalize_url(F.col("h"), F.col("b")))
    assert got == ["https://c.x/a", "http://h.x/a/b?q=1", "http://h.x/a?p=2"]


def offline(url):
    path = unquote(urlparse(url).path)
    if "/_next/image" in path:
        query = parse_qs(urlparse(url).query)
        if "url" not in query:
            return None
        inner = unquote(query["url"][0]).lstrip("/")
        stem, ending = os.path.splitext(inner)
        width = query.get("w", [""])[0]
        return f"{stem}_w{width}{ending}" if width else inner
    if not path or path == "/":
        return "index.html"
    if not os.path.splitext(path)[1]:
        path += "index.html" if path.endswith("/") else ".html"
    return path.lstrip("/")


def test_local_path_agrees_with_the_standard_library(column):
    cases = [
        "http://h.x", "http://h.x/", "http://h.x/a/", "http://h.x/a", "http://h.x/a%20b.css",
        "http://h.x/a+b", "http://h.x/et.", "http://h.x/.hid", "http://h.x/a.b/c", "http://h.x/..x",
        "http://h.x/a;p.q", "http://h.x/a;p/b;q", "http://h.x/%zz", "http://h.x/a%", "http://h.x/f%C3%BCr?x=1#y",
        "http://h.x/_next/image?url=%2Fi%2Fp.png&w=64&q=75", "http://h.x/_next/image?w=64",
        "http://h.x/_next/image?url=&url=%2Fx", "http://h.x/_next/image?url=%252Fi+b.png",
        "http://h.x/a.tar.gz", "/rel/x?y",
    ]
    got = column("u string", [(c,) for c in cases], urls.local_path(F.col("u")))
    assert got == [offline(c) for c in cases]


def test_local_path_never_leaves_the_folder(column):
    cases = ["http://h.x/../../etc/x", "http://h.x/%2e%2e/%2E%2E/x.css", "http://h.x/_next/image?url=..%2F..%2Fx.png"]
    got = column("u string", [(c,) for c in cases], urls.local_path(F.col("u")))
    assert got == ["etc/x.html", "x.css", "x.png"]


def test_relative_path_agrees_with_the_standard_library(column):
    paths = ["s/a.css", "a.html", "x/y/p.html", "x/y/q/r.html", "x", "x/y", "a.html/b.html", "index.html", "x//y/z.css"]
    rows = list(itertools.product(paths, paths))
    got = column("t string, p string", rows, urls.relative_path(F.col("t"), F.col("p")))
    assert got == [os.path.relpath("/o/" + t, os.path.dirname("/o/" + p)) for t, p in rows]


def test_page_key(column):
    cases = {
        "http://h.x": "http://h.x/", "http://h.x?a=1": "http://h.x/", "http://h.x/a?b=1": "http://h.x/a",
        "http://h.x/a?b#c": "http://h.x/a#c", "http://h.x/_next/image?url=x": "http://h.x/_next/image?url=x",
    }
    assert column("u string", [(c,) for c in cases], urls.page_key(F.col("u"))) == list(cases.values())


def test_same_site_is_exact(column):
    rows = [("http://h.x/a", True), ("http://h.x:80/a", False), ("http://H.x/a", False), ("http://w.h.x/", False), ("/a", True), ("mailto:a@b", True)]
    got = column("u string, e boolean", rows, urls.same_site(F.col("u"), F.lit("h.x")))
    assert got == [e for _, e in rows]


def test_categories_and_extensions(column):
    rows = [
        ("http://h.x/A.CSS", None, "css", ".CSS"), ("http://h.x/a.mjs", "", "js", ""), ("http://h.x/a", "text/css", "css", ".css"),
        ("http://h.x/a", "text/html", "other", ".html"), ("http://h.x/a.bin", "Image/PNG", "image", ""),
        ("http://h.x/a.pdf?x.css", "video/mp4", "doc", ""), ("http://h.x/a", "audio/ogg", "media", ""),
        ("http://h.x/_next/image?url=%2Fa.avif", "image/png", "image", ".avif"), ("http://h.x/f", "font/woff2", "font", ".woff"),
        ("http://h.x/a.ts;v=1", None, "js", ""),
    ]
    schema = "u string, t string, c string, e string"
    assert column(schema, rows, urls.asset_category(F.col("u"), F.col("t"))) == [r[2] for r in rows]
    assert column(schema, rows, urls.file_extension(F.col("u"), F.col("t"))) == [r[3] for r in rows]


def test_srcset_site_key_and_proxy(column):
    sets = [("/a.png 1x, /b.png 2x", "/a.png"), ("/a.png, /b.png 2x", "/a.png,"), ("/_next/image?url=a,/b", "/_next/image?url=a"), ("  /x\t1x", "/x"), ("", "")]
    assert column("s string, e string", sets, urls.first_srcset(F.col("s"))) == [e for _, e in sets]
    assert column("u string", [("http://www.a.b.org:8/x",)], urls.site_key(F.col("u"))) == ["a_b_org:8_offline"]
    wrapped = [("/_next/image?url=%2Fi.png&w=3",), ("/_next/image?w=3",), ("/plain.png",)]
    got = column("u string", wrapped, urls.unwrap_image_proxy(F.col("u"), F.lit("http://h.x")))
    assert got == ["http://h.x/i.png", "/_next/image?w=3", "/plain.png"]

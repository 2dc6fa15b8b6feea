"""Robots rules against the standard library parser."""

import itertools
import time
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import robots

FILES = {
    "plain.x": "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow:\n",
    "first.x": "User-agent: *\nAllow: /a/b\nDisallow: /a\n",
    "two.x": "User-agent: Bot\nUser-agent: other\nDisallow: /bot\n\nUser-agent: *\nDisallow: /all",
    "runs.x": "User-agent: bot\nDisallow: /one\nUser-agent: *\nDisallow: /two\nUser-agent: *\nDisallow: /three\n",
    "blank.x": "User-agent: *\n\nDisallow: /lost\n\nUser-agent: *\nCrawl-delay: 3\n",
    "early.x": "Disallow: /early\nUser-agent: *\n# note\nDisallow: /late # why\n",
    "mixed.x": "﻿x\r\nUSER-AGENT : *\r\n disallow :/caf%C3%A9\r\nSitemap: http://h/x\r\nDisallow: /q?x=1\r\n",
    "empty.x": "",
    "junk.x": "hello\nno colon here\n: \n",
    "star.x": "User-agent: *\nDisallow: /*.gif\nDisallow: *\n",
    "inner.x": "User-agent: *\nDisallow: /x\n \nDisallow: /y\n",
    "later.x": "User-agent: a\nDisallow: /\n\nUser-agent: bot\nUser-agent: *\nDisallow: /shared\n\nUser-agent: bot\nDisallow: /own\n",
}
PATHS = ["", "/", "/a", "/a/b/c", "/bot", "/all", "/one", "/two", "/three", "/lost", "/early", "/late", "/caf%C3%A9", "/café/x", "/q?x=1&y", "/x", "/y", "/i.gif", "/shared", "/own", "/%61"]


@pytest.mark.parametrize("agent", ["*", "bot/2.0", "Mozilla/5.0"])
def test_verdicts_agree_with_the_standard_library(spark, agent):
    files = spark.createDataFrame(list(FILES.items()), "host string, body string")
    targets = [f"http://{h}{p}" for h, p in itertools.product(FILES, PATHS)]
    rows = spark.createDataFrame([(u,) for u in targets], "url string")
    got = {r.url: r.allowed for r in robots.robots_allowed(rows, robots.parse_rules(files, agent)).collect()}
    wrong = []
    for host, body in FILES.items():
        parser = RobotFileParser()
        parser.parse(body.strip().splitlines())
        for path in PATHS:
            url = f"http://{host}{path}"
            if got[url] != parser.can_fetch(agent, url):
                wrong.append((url, got[url]))
    assert wrong == []


@pytest.mark.parametrize("few", [0, 2])
def test_prefix_look_up_gives_the_same_verdicts(spark, few):
    files = spark.createDataFrame(list(FILES.items()), "host string, body string")
    targets = [f"http://{h}{p}" for h, p in itertools.product([*FILES, "none.x"], PATHS)] + ["/relative", None]
    rows = spark.createDataFrame([(u, i) for i, u in enumerate(targets * 2)], "url string, n int")
    rules = robots.parse_rules(files)
    plain = robots.RuleIndex(rules, few=1000).verdicts(rows).collect()
    looked_up = robots.RuleIndex(rules, few=few).verdicts(rows).collect()
    assert len(plain) == 2 * len(targets) and any(not r.allowed for r in plain)
    assert {(r.n, r.url, r.allowed) for r in looked_up} == {(r.n, r.url, r.allowed) for r in plain}


def test_a_host_with_very_many_rules(spark):
    rules = spark.range(50_000).selectExpr(
        "'big.x' AS host", "CAST(id AS int) AS rule_order", "id % 10 = 0 AS allow", "concat('/d', id, '/') AS path"
    )
    rows = spark.range(100_000).selectExpr("concat('http://big.x/d', id % 60000, '/p', id) AS url", "id")
    start = time.time()
    refused = robots.robots_allowed(rows, rules).where(~F.col("allowed")).agg(F.count("*"), F.sum("id")).first()
    ids = [i for i in range(100_000) if i % 60000 < 50_000 and i % 60000 % 10]
    assert tuple(refused) == (len(ids), sum(ids))
    assert time.time() - start < 60


def test_hosts_without_rules_are_open(spark):
    rows = spark.createDataFrame([("http://no.x/a",), ("/relative",)], "url string")
    rules = spark.createDataFrame([("h.x", 0, False, "/")], "host string, rule_order int, allow boolean, path string")
    assert [r.allowed for r in robots.robots_allowed(rows, rules).collect()] == [True, True]


def test_markup_bodies_hold_no_rules(spark):
    files = spark.createDataFrame(
        [("a", "<HTML>\nUser-agent: *\nDisallow: /"), ("b", " {\"x\": 1}\nDisallow: /"), ("c", "<!doctype html>\nCrawl-delay: 3")],
        "host string, body string",
    )
    assert robots.parse_rules(files).count() == 0
    report = robots.robots_report(files).collect()
    assert all(r.disallowed == 0 and r.crawl_delay is None for r in report)


def test_report_and_delays(spark):
    lines = "\n".join(f"Disallow: /p{i}:tail" for i in range(12))
    files = spark.createDataFrame(
        [("a", f"Crawl-delay: 2\ncrawl-delay: x\nCRAWL-DELAY: 5 : 7\n{lines}\nDisallow:\n Disallow: /indented"), ("b", "Crawl-delay: 0"), ("c", "")],
        "host string, body string",
    )
    report = {r.host: r for r in robots.robots_report(files).collect()}
    assert report["a"].crawl_delay == 5.0 and report["a"].disallowed == 12
    assert report["a"].disallowed_paths == [f"/p{i}" for i in range(10)]
    delays = {r.host: r.delay for r in robots.effective_delay(robots.crawl_delay(files), 0.3).collect()}
    assert delays == {"a": 5.0, "b": 0.3, "c": 0.3}

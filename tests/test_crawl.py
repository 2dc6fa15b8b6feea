"""Traversal against a plain breadth-first search."""

import random
from collections import deque

from pagelattice.operators import crawl


def graph(n=120, seed=11):
    rng = random.Random(seed)
    edges = {(i, rng.randint(0, n)) for i in range(n) for _ in range(2)}
    edges |= {(0, i) for i in range(1, n, 3)} | {(5, 5)}
    return sorted((f"http://h{s % 3}.x/{s}", f"http://h{d % 3}.x/{d}") for s, d in edges)


def walk(edges, seeds, allowed, max_depth=None):
    depth = {s: 0 for s in seeds}
    queue = deque(seeds)
    while queue:
        url = queue.popleft()
        if not allowed(url) or (max_depth is not None and depth[url] >= max_depth):
            continue
        for s, d in edges:
            if s == url and d not in depth:
                depth[d] = depth[url] + 1
                queue.append(d)
    return {(u, d, allowed(u)) for u, d in depth.items()}


def frames(spark, edges, seeds):
    return spark.createDataFrame(edges + edges[:5], "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "url string")


def test_depths_cycles_and_missing_targets(spark):
    edges, seeds = graph(), ["http://h0.x/0", "http://h1.x/7"]
    got = {tuple(r) for r in crawl.crawl_frontier(*frames(spark, edges, seeds)).collect()}
    assert got == walk(edges, seeds, lambda u: True)


def test_rules_block_expansion(spark):
    edges, seeds = graph(), ["http://h0.x/0"]
    rules = spark.createDataFrame(
        [("h0.x", 0, True, "/1"), ("h0.x", 1, False, "/9"), ("h1.x", 0, False, "/1")],
        "host string, rule_order int, allow boolean, path string",
    )
    def allowed(url):
        return not (url.startswith("http://h0.x/9") or url.startswith("http://h1.x/1"))
    got = {tuple(r) for r in crawl.crawl_frontier(*frames(spark, edges, seeds), rules).collect()}
    assert got == walk(edges, seeds, allowed)
    order = crawl.crawl_order(*frames(spark, edges, seeds), rules, max_depth=2).collect()
    assert {tuple(r) for r in order} == {(u, d) for u, d, a in walk(edges, seeds, allowed, 2) if a}


def test_refused_seed_and_empty_graph(spark):
    edges, seeds = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("http://h/a",)], "url string")
    rules = spark.createDataFrame([("h", 0, False, "/")], "host string, rule_order int, allow boolean, path string")
    assert crawl.crawl_order(edges, seeds).count() == 1
    assert crawl.crawl_order(edges, seeds, rules).count() == 0

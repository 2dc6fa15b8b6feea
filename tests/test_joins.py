"""Look-ups, skewed joins, snapshots and state."""

import random

from pyspark.sql import functions as F

from pagelattice import schemas
from pagelattice.operators import filters, joins, reports, skew, snapshots
from pagelattice.sources import state as state_io


def skewed(spark, n=6000):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 500)}") for i in range(n)] + [(-1, None)]
    return spark.createDataFrame(rows, "id bigint, k string")


def side(spark):
    return spark.createDataFrame([("hot", "h")] + [(f"k{i}", str(i)) for i in range(0, 500, 2)], "k string, v string")


def copies(spark, **keys):
    return spark.createDataFrame(list(keys.items()), "k string, _copies int")


def test_heavy_keys_are_few_and_weighted(spark):
    heavy = {r.k: r._copies for r in skew.heavy_keys(skewed(spark), "k", spread=64).collect()}
    assert heavy["hot"] == 32 and len(heavy) < 20
    assert skew.heavy_keys(spark.range(1000).select(F.col("id").cast("string").alias("k")), "k", spread=8).isEmpty()
    assert skew.heavy_keys(spark.createDataFrame([], "k string"), "k").isEmpty()


def test_every_heavy_key_is_found(spark):
    many = spark.range(20_000).select(F.format_string("k%d", F.col("id") % 2000).alias("k"))
    heavy = skew.heavy_keys(many, "k", spread=20_000)
    assert heavy.count() == 2000 and heavy.where("_copies <> 16").isEmpty()


def test_skew_join_equals_plain_join(spark):
    left, right = skewed(spark), side(spark)
    for how in ["left", "inner", "left_anti", "left_semi"]:
        columns = ["id", "k"] if how.startswith("left_") else ["id", "k", "v"]
        plain = left.join(right, "k", how).select(*columns)
        spread = skew.skew_join(left, right, "k", how, copies(spark, hot=16, k2=4, absent=2)).select(*columns)
        measured = skew.skew_join(left, right, "k", how).select(*columns)
        expected = sorted(map(repr, plain.collect()))
        assert sorted(map(repr, spread.collect())) == expected
        assert sorted(map(repr, measured.collect())) == expected


def test_hot_key_really_spreads(spark):
    rows = skew.salted(skewed(spark), "k", copies(spark, hot=16)).where("k = 'hot'")
    sizes = [r["count"] for r in rows.groupBy("_salt").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * min(sizes)


def test_equal_rows_and_maps_spread(spark):
    same = spark.range(0, 20_000, 1, 64).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    sizes = [r["count"] for r in skew.salted(same, "k", copies(spark, hot=16)).groupBy("_salt").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 5_000
    assert skew.skew_join(same, side(spark), "k", "left").where("v = 'h'").count() == 20_000


def test_unvisited_and_dangling(spark):
    links = spark.createDataFrame(
        [("s", "http://h/a?x"), ("s", "http://h/a"), ("t", "http://h/b"), ("t", "http://h"), ("u", "http://h/_next/image?url=1")],
        "src string, dst string",
    )
    pages = spark.createDataFrame([("http://h/b?q#f",), ("http://h/",)], "url string")
    assert sorted(r.key for r in joins.unvisited(links, pages.where("url = 'http://h/'")).collect()) == ["http://h/_next/image?url=1", "http://h/a", "http://h/b"]
    got = sorted(tuple(r) for r in joins.dangling_links(links, pages).collect())
    assert [g[1] for g in got] == ["http://h/a", "http://h/a?x", "http://h", "http://h/_next/image?url=1"]


def test_conditional_headers(spark):
    state = spark.createDataFrame([("a", "e", "m"), ("b", "", None), ("c", None, "m")], "url string, etag string, last_modified string")
    urls = spark.createDataFrame([(u,) for u in "abcd"], "url string")
    got = {r.url: (r.if_none_match, r.if_modified_since) for r in joins.conditional_headers(urls, state).collect()}
    assert got == {"a": ("e", "m"), "b": (None, None), "c": (None, "m"), "d": (None, None)}


def test_seed_assets_filters_before_look_up(spark):
    sites = spark.createDataFrame([("http://a",), ("http://a",), ("http://b",)], "site string")
    held = spark.createDataFrame([("http://a/x.png",)], "url string")
    got = joins.seed_assets(sites, ["/x.png", "/y.css"], held, filters.AssetFilter(exclude_types=["CSS"]))
    assert [tuple(r) for r in got.collect()] == [("http://b/x.png", "image", "x.png")]


def test_filters(spark):
    rows = spark.createDataFrame(
        [("http://h/a.css", "css", b"x" * 1024), ("http://h/b.js", "JS", b"x" * 2048), ("http://h/c", None, None), ("http://h/d.png", "image", b"x" * 2049)],
        "url string, category string, body binary",
    )
    names = lambda df: [r.url[9:] for r in df.orderBy("url").collect()]
    assert names(filters.filter_asset_types(rows, ["js", "OTHER"])) == ["b.js", "c"]
    assert names(filters.filter_asset_types(rows, exclude=["other", "Image"])) == ["a.css", "b.js"]
    assert names(filters.filter_url_patterns(rows, ["a", "d"], [r"\.css$"])) == ["d.png"]
    assert names(filters.filter_size(rows, 1, 2)) == ["a.css", "b.js", "c"]
    assert names(filters.filter_size(rows)) == ["a.css", "b.js", "c", "d.png"]


def state_rows(spark, rows):
    return spark.sql("SELECT 1").sparkSession.createDataFrame(
        rows, "url string, etag string, last_modified string, content_type string, local_path string, t string"
    ).select("url", "etag", "last_modified", "content_type", "local_path", F.to_timestamp("t").alias("ts"))


OLD, NEW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def test_snapshot_classes(spark):
    state = state_rows(spark, [("same", "1", None, "t", "p", OLD), ("diff", "1", "m", "t", "p", OLD), ("gone", "1", None, "t", "p", OLD), ("date", None, "m", "t", "p", OLD), ("none", "", None, "t", "p", OLD)])
    now = state_rows(spark, [("same", "1", None, "t", "p", NEW), ("same", "0", None, "t", "p", OLD), ("diff", "2", "m", "t", "p", NEW), ("date", "9", "m", "t", "p", NEW), ("none", "", None, "t", "p", NEW), ("new", "1", None, "t", "p", NEW)])
    got = {r.url: r.status for r in snapshots.snapshot_diff(now, state).collect()}
    assert got == {"same": "unchanged", "diff": "changed", "gone": "removed", "date": "unchanged", "none": "changed", "new": "new"}
    assert sorted(r.url for r in snapshots.changed_captures(now, state).collect()) == ["diff", "new", "none"]


def test_upsert_keeps_the_last_write(spark):
    state = state_rows(spark, [("a", "1", None, "t", "p", NEW), ("b", "1", None, "t", "p", NEW), ("c", "1", None, "t", "p", OLD)])
    now = state_rows(spark, [("a", "2", None, "t", "p", NEW), ("b", "2", None, "t", "p", OLD), ("d", "2", None, "t", "p", NEW)])
    assert {r.url: r.etag for r in snapshots.upsert_state(state, now).collect()} == {"a": "2", "b": "1", "c": "1", "d": "2"}


def test_state_log_counts_complete_saves(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state_io.load_state(spark, path).count() == 0
    first = state_rows(spark, [("a", "1", None, "t", "p", OLD)])
    assert state_io.save_state(first, path, buckets=4) == 0
    assert state_io.save_state(state_rows(spark, [("b", "1", None, "t", "p", NEW)]), path) == 1
    # A save that never ended.
    (tmp_path / "state" / "buckets=4" / "delta=7" / "bucket=0").mkdir(parents=True)
    loaded = state_io.load_state(spark, path)
    assert loaded.schema == schemas.STATE and sorted(r.url for r in loaded.collect()) == ["a", "b"]
    assert state_io.save_state(state_rows(spark, [("a", "2", None, "t", "p", NEW), ("b", "0", None, "t", "p", OLD)]), path) == 8
    assert {r.url: r.etag for r in state_io.load_state(spark, path).collect()} == {"a": "2", "b": "1"}


def files(folder):
    return {str(f.relative_to(folder)): f.stat().st_size for f in folder.rglob("*.parquet")}


def many_rows(spark, n, etag, ts, every=1):
    return spark.range(0, n, every).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.lit(etag).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit("t").alias("content_type"), F.lit("p").alias("local_path"), F.lit(ts).cast("timestamp").alias("ts"))


def test_a_save_writes_its_own_rows_alone(spark, tmp_path):
    path, folder = str(tmp_path / "state"), tmp_path / "state"
    state_io.save_state(many_rows(spark, 20_000, "1", OLD), path, buckets=64)
    before = files(folder)
    assert len(before) == 64
    state_io.save_state(many_rows(spark, 20_000, "2", NEW, every=5000), path)
    added = {f: n for f, n in files(folder).items() if f not in before}
    assert before.items() <= files(folder).items()
    assert 1 <= len(added) <= 4 and sum(added.values()) < sum(before.values()) / 10
    # A reader of these rows opens their buckets alone.
    log = state_io.state_log(spark, path)
    known = log.rows_for(many_rows(spark, 20_000, "2", NEW, every=5000))
    assert len(known.inputFiles()) <= 8
    assert {r.url for r in known.where("etag = '2'").collect()} == {f"http://h/{i}" for i in range(0, 20_000, 5000)}
    assert state_io.load_state(spark, path).groupBy("etag").count().orderBy("etag").collect()[0][1] == 20_000 - 4


def test_compaction_keeps_the_state_and_bounds_the_files(spark, tmp_path, monkeypatch):
    path, want, most = str(tmp_path / "state"), {}, 0
    for i in range(14):
        rows = [(f"u{j}", f"{i}", None, "t", "p", f"2024-01-{i + 1:02d} 00:00:00") for j in range(i % 3, 30, 3)]
        log = state_io.BucketLog(spark, path, schemas.STATE, "url", ("ts",), buckets=4, compact_at=3)
        log.append(state_rows(spark, rows))
        want |= {u: e for u, e, *_ in rows}
        assert {r.url: r.etag for r in log.rows().collect()} == want
        most = max(most, len(log._stored(None).inputFiles()))
    assert most <= 4 * 4 and len(files(tmp_path / "state")) <= 4 * 12


def test_a_crash_in_a_compaction_leaves_the_state(spark, tmp_path):
    path = str(tmp_path / "state")
    log = state_io.BucketLog(spark, path, schemas.STATE, "url", ("ts",), buckets=2)
    for i in range(3):
        log.append(state_rows(spark, [(f"u{i}", "1", None, "t", "p", OLD)]))
    # Parts of a base without _SUCCESS.
    log._write(log._stored(None).limit(1), "base=2")
    (tmp_path / "state" / "buckets=2" / "base=2" / "_SUCCESS").unlink()
    assert sorted(r.url for r in log.rows().collect()) == ["u0", "u1", "u2"]
    log.compact()
    assert sorted(r.url for r in log.rows().collect()) == ["u0", "u1", "u2"]
    assert log._layout()[1] == [] and log.append(state_rows(spark, [("u0", "2", None, "t", "p", NEW)])) == 3
    assert {r.url: r.etag for r in log.rows().collect()} == {"u0": "2", "u1": "1", "u2": "1"}


def test_first_n_and_sitemap(spark):
    rules = spark.createDataFrame([(h, i, f"/{i}") for h in "ab" for i in range(5)], "host string, rule_order int, path string")
    assert sorted((r.host, r.rule_order) for r in reports.first_n_per_site(rules, 2).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    pages = spark.createDataFrame([("http://h/x/a.html",), ("http://h/b",), ("http://h/",)], "url string")
    assert [(r.file, r.local_path) for r in reports.sitemap(pages).collect()] == [(".html", "index.html"), ("b.html", "b.html"), ("a.html", "x/a.html")]

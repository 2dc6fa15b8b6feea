"""WARC parts, streams and the plans of key jobs."""

import base64
import glob
import gzip
import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import urls
from pagelattice.operators import extract, reports, scan, snapshots
from pagelattice.sources import pages as page_io, state as state_io, warc
from pagelattice.streaming import jobs

STAMP = "TIMESTAMP '2024-02-01 00:00:00'"


def captures(spark, n=40):
    rows = [(i, f"http://h{i % 3}.x/p{i // 2 * 2}?v={i}", f"<!-- note {i} --><a href='/é{i}'>x</a> a{i}@b.org") for i in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)


def members(path):
    """Every gzip member of a file on its own."""
    import zlib

    data = open(path, "rb").read()
    while data:
        stream = zlib.decompressobj(31)
        yield stream.decompress(data)
        data = stream.unused_data


def test_warc_parts_hold_one_member_per_record(spark, tmp_path):
    pages = captures(spark)
    out = str(tmp_path / "warc")
    warc.write_warc(warc.responses(pages), out)
    files = glob.glob(f"{out}/*.warc.gz")
    assert len(files) > 1 and not glob.glob(f"{out}/_temporary*")
    found = {}
    for name in files:
        assert gzip.open(name).read().startswith(b"WARC/1.0\r\n")
        for record in members(name):
            head, rest = record.split(b"\r\n\r\n", 1)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert tail == b"\r\n\r\n"
            http, payload = block.split(b"\r\n\r\n", 1)
            assert http.decode().split("\r\n") == ["HTTP/1.1 200 OK", "Content-Type: text/html"]
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            found[fields["WARC-Target-URI"]] = payload.decode()
    assert found == {r.url: r.html for r in pages.collect()}


def test_warc_uses_recorded_headers_and_appends(spark, tmp_path):
    rows = spark.createDataFrame(
        [("http://h/x", 404, "Not Found", {"Server": "s"}, bytearray(b"\xff\x00"))],
        "url string, status int, reason string, headers map<string,string>, html binary",
    )
    out = str(tmp_path / "warc")
    for _ in range(2):
        warc.write_warc(warc.responses(rows), out)
    files = glob.glob(f"{out}/*.warc.gz")
    assert len(files) == 2
    assert b"HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\n\xff\x00\r\n\r\n" in gzip.open(files[0]).read()
    record = warc.warc_records(warc.responses(rows)).collect()[0]
    assert (record.status_line, record.payload_bytes) == ("404 Not Found", 2)


def sent(df):
    return sorted((r.target_uri, r.status_line, r.headers, bytes(r.payload), r.warc_date) for r in df.collect())


def test_warc_reads_back_whole_records(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            ("http://h/x", 404, "Not Found", {"Server": "s: t", "Via": "a"}, bytearray(b"\xff\x00\r\n\r\nWARC/1.0\r\n")),
            ("http://h/é", 200, "OK", {"Content-Type": "text/html"}, bytearray()),
            ("http://h/long", 200, "OK", {"Content-Type": "a/b"}, bytearray(bytes(range(256)) * 80_000)),
        ],
        "url string, status int, reason string, headers map<string,string>, html binary",
    )
    out, wanted = str(tmp_path / "warc"), warc.responses(rows)
    warc.write_warc(wanted, out)
    assert sent(warc.read_warc(spark, out)) == sent(wanted)
    warc.write_warc(warc.responses(captures(spark, 0)), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_sections_of_a_part_are_read_apart(spark, tmp_path):
    wanted, out = warc.responses(captures(spark)), str(tmp_path / "warc")
    warc.write_warc(wanted, out, parts=1, split=1000)
    read = warc.read_warc(spark, out)
    assert read.rdd.getNumPartitions() > 4
    assert sent(read) == sent(wanted)


def test_warc_reads_only_what_a_manifest_names(spark, tmp_path):
    wanted, out = warc.responses(captures(spark, 8)), str(tmp_path / "warc")
    warc.write_warc(wanted, out, parts=2)
    part = glob.glob(f"{out}/part-*.warc.gz")[0]
    # What a task that ran twice leaves, and the hidden manifest of a write that did not end.
    shutil.copy(part, f"{out}/part-stray.warc.gz")
    shutil.copy(glob.glob(f"{out}/_manifests/*.json")[0], f"{out}/_manifests/.unfinished")
    assert sent(warc.read_warc(spark, out)) == sent(wanted)
    warc.write_warc(wanted, out)
    assert sent(warc.read_warc(spark, out)) == sorted(sent(wanted) * 2)
    warc.write_warc(wanted.limit(1), out, overwrite=True)
    assert warc.read_warc(spark, out).count() == 1 and len(glob.glob(f"{out}/*.warc.gz")) == 1


def test_warc_of_other_tools_is_read_file_by_file(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nA: 1\r\na: 2\r\n\r\nbody"
    record = b"WARC/1.1\r\nwarc-type: response\r\nWARC-Target-URI: http://h/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    folder = tmp_path / "other"
    folder.mkdir()
    # All records in one member, as some tools compress them.
    (folder / "a.warc.gz").write_bytes(gzip.compress(info + record + record))
    (folder / "b.warc.gz").write_bytes(gzip.compress(record))
    rows = warc.read_warc(spark, str(folder)).collect()
    assert [(r.target_uri, bytes(r.payload), r.warc_date) for r in rows] == [("http://h/", b"body", None)] * 3
    whole = (folder / "b.warc.gz").read_bytes()
    (folder / "b.warc.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="end-of-stream|ends early"):
        warc.read_warc(spark, str(folder)).collect()


def landed(spark, tmp_path, name="in"):
    folder = str(tmp_path / name)
    captures(spark).write.parquet(folder)
    return folder


def test_stream_state_equals_batch_and_resumes(spark, tmp_path):
    folder, path, offsets = landed(spark, tmp_path), str(tmp_path / "state"), str(tmp_path / "offsets")
    stream = jobs.read_captures(spark, folder, files_per_batch=1)
    jobs.stream_state(stream, path, offsets, F.expr(STAMP)).awaitTermination()
    batch = snapshots.upsert_state(state_io.load_state(spark, str(tmp_path / "none")), snapshots.page_captures(captures(spark), F.expr(STAMP)))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(state_io.load_state(spark, path)) == rows(batch)
    extra = spark.createDataFrame([(99, "http://h0.x/p0?v=0", "changed"), (100, "http://h9.x/", "new")], "page_id bigint, url string, html string")
    extra.write.mode("append").parquet(folder)
    jobs.stream_state(jobs.read_captures(spark, folder), path, offsets, F.expr(STAMP)).awaitTermination()
    after = {r.url: r.etag for r in state_io.load_state(spark, path).collect()}
    assert len(after) == 41 and after["http://h0.x/p0?v=0"] == hashlib.md5(b"changed").hexdigest()


def test_replayed_batches_add_nothing(spark, tmp_path):
    """The same batch number of the same stream is one save, and one folder of kept captures."""
    folder, path, offsets, kept = landed(spark, tmp_path), tmp_path / "state", tmp_path / "offsets", tmp_path / "kept"
    for start, checkpoint in ((lambda at: jobs.stream_state(jobs.read_captures(spark, folder), str(path), at, F.expr(STAMP)), offsets), (lambda at: jobs.stream_dedupe(jobs.read_captures(spark, folder), str(kept), at), tmp_path / "o2")):
        start(str(checkpoint)).awaitTermination()
        done = [f for f in (path, kept) if f.exists()]
        before = [sorted(str(x) for f in done for x in f.rglob("delta=*"))]
        shutil.rmtree(checkpoint / "commits")  # as if the run had died before it told Spark
        start(str(checkpoint)).awaitTermination()
        assert [sorted(str(x) for f in done for x in f.rglob("delta=*"))] == before
    keys = [r.key for r in spark.read.parquet(str(kept)).collect()]
    assert len(keys) == len(set(keys)) == len({r.k for r in captures(spark).select(urls.captured_key(F.col("url")).alias("k")).collect()})


def test_state_batches_read_and_write_with_the_batch(spark, tmp_path):
    """A state 100 times the batch: few buckets are opened, and no more than the batch is written."""
    path, folder = str(tmp_path / "state"), str(tmp_path / "in")
    known = spark.range(500).select(F.concat(F.lit("http://h.x/p"), "id").alias("url"), F.lit("old").alias("html"), F.col("id").alias("page_id"))
    state_io.save_state(snapshots.page_captures(known, F.expr(STAMP)), path, buckets=64)
    before = {f: f.stat().st_size for f in (tmp_path / "state").rglob("*.parquet")}
    for i in range(3):
        known.where(f"page_id between {5 * i} and {5 * i + 4}").withColumn("html", F.lit("new")).select("page_id", "url", "html").write.mode("append").parquet(folder)
        jobs.stream_state(jobs.read_captures(spark, folder), path, str(tmp_path / "offsets"), F.expr(STAMP)).awaitTermination()
        now = {f: f.stat().st_size for f in (tmp_path / "state").rglob("*.parquet")}
        assert before.items() <= now.items() and len(now) - len(before) <= 5
        before = now
    etags = [r.etag for r in state_io.load_state(spark, path).collect()]
    assert len(etags) == 500 and etags.count(hashlib.md5(b"new").hexdigest()) == 15


def test_repeated_page_ids_of_a_batch_are_one_capture(spark, tmp_path):
    folder, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.createDataFrame([(1, "http://h/a", "x")] * 3 + [(1, "http://h/b", "y")], "page_id bigint, url string, html string").write.parquet(folder)
    jobs.stream_dedupe(jobs.read_captures(spark, folder), kept, str(tmp_path / "o")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(kept).collect()) == ["http://h/a", "http://h/b"]


def test_stream_findings_and_dedupe_equal_batch(spark, tmp_path):
    folder = landed(spark, tmp_path)
    out, kept = str(tmp_path / "found"), str(tmp_path / "kept")
    jobs.stream_findings(jobs.read_captures(spark, folder), out, str(tmp_path / "o1")).awaitTermination()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(spark.read.parquet(out)) == rows(scan.all_findings(scan.page_texts(captures(spark))))
    jobs.stream_dedupe(jobs.read_captures(spark, folder, files_per_batch=1), kept, str(tmp_path / "o2")).awaitTermination()
    keys = [r.key for r in spark.read.parquet(kept).collect()]
    expected = {r.k for r in captures(spark).select(urls.captured_key(F.col("url")).alias("k")).collect()}
    assert len(keys) == len(set(keys)) and set(keys) == expected


def test_stream_dedupe_within_watermark(spark, tmp_path):
    folder = str(tmp_path / "timed")
    captures(spark).withColumn("at", F.expr(STAMP)).write.parquet(folder)
    stream = spark.readStream.schema("page_id bigint, url string, html string, at timestamp").parquet(folder)
    jobs.stream_dedupe(stream, str(tmp_path / "kept"), str(tmp_path / "o"), within=("at", "1 hour")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).select("key").distinct().count() == spark.read.parquet(str(tmp_path / "kept")).count()


def test_only_html(spark):
    rows = spark.createDataFrame([("a", "text/html; charset=x"), ("b", "text/css"), ("c", None)], "url string, content_type string")
    assert [r.url for r in page_io.only_html(rows).collect()] == ["a"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_shuffle_free_and_single_pass(spark, tmp_path):
    folder = landed(spark, tmp_path)
    pages = page_io.scan_pages(spark, folder)
    for job in [extract.extract_links(pages), extract.asset_refs(pages), scan.all_findings(scan.page_texts(pages))]:
        assert "Exchange" not in plan(job) and "BatchEvalPython" not in plan(job)
    links = plan(extract.extract_links(pages))
    assert links.count("regexp_extract_all(html") == 1
    names = plan(pages.select(urls.site_key(F.col("url"))))
    assert "ReadSchema: struct<url:string>" in names


def test_first_n_cuts_before_the_shuffle(spark):
    rules = spark.createDataFrame([("h", 1, "/")], "host string, rule_order int, path string")
    text = plan(reports.first_n_per_site(rules.repartition(4), 2))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_state_upsert_combines_before_the_shuffle(spark, tmp_path):
    pages = page_io.scan_pages(spark, landed(spark, tmp_path))
    state = snapshots.page_captures(pages, F.expr(STAMP))
    text = plan(snapshots.upsert_state(state, state))
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1


def test_stream_queries_read_a_table_of_one_file_or_of_several(spark, tmp_path):
    """Files without an ending too, as the batch reader takes them."""
    from pagelattice.plans.catalog import QUERIES

    many, one = tmp_path / "many", tmp_path / "one"
    captures(spark).write.parquet(str(many / "pages.parquet"))
    part = min((many / "pages.parquet").glob("part-*"))
    part.rename(part.with_name("part-0"))
    captures(spark).coalesce(1).write.parquet(str(tmp_path / "single"))
    one.mkdir()
    shutil.copy(next((tmp_path / "single").glob("part-*")), one / "pages.parquet")
    rows = lambda df: sorted(map(repr, df.collect()))
    expected = {r.k for r in captures(spark).select(urls.captured_key(F.col("url")).alias("k")).collect()}
    for name in ("stream_dedupe", "stream_findings", "stream_state"):
        found = rows(QUERIES[name](spark, str(many)))
        assert found == rows(QUERIES[name](spark, str(one))) and found
        if name == "stream_dedupe":
            assert found == sorted(f"Row(key={k!r})" for k in expected)

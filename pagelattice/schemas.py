"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT, _STR, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

PAGES = _table(page_id=_LONG, url=_STR, html=_STR)
ASSETS = _table(asset_id=_LONG, url=_STR, content_type=_STR, body=_STR)
STATE = _table(
    url=_STR,
    etag=_STR,
    last_modified=_STR,
    content_type=_STR,
    local_path=_STR,
    ts=T.TimestampType(),
)
LINKS = _table(page_id=_LONG, src=_STR, dst=_STR)
ASSET_REFS = _table(page_id=_LONG, kind=_STR, ref=_STR, url=_STR)
FINDINGS = _table(
    kind=_STR,
    type=_STR,
    value=_STR,
    value_sha256=_STR,
    start=_INT,
    snippet=_STR,
    source=_STR,
)
ROBOTS_TEXT = _table(host=_STR, body=_STR)
ROBOTS_RULES = _table(host=_STR, rule_order=_INT, allow=_BOOL, path=_STR)
ROBOTS_DELAY = _table(host=_STR, crawl_delay=T.DoubleType())
CRAWL_ORDER = _table(url=_STR, depth=_INT)
WARC_RECORDS = _table(
    target_uri=_STR,
    warc_type=_STR,
    status_line=_STR,
    payload_bytes=_LONG,
    payload_sha256=_STR,
)

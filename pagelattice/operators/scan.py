"""Credentials, e-mail addresses and comments in captured text.

A scan is one pass over its input: every row yields one array of findings, exploded once. Nothing
is shuffled, so the scan runs unchanged on a stream. Credentials leave only in redacted form with
a digest and a position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from pagelattice.functions import fixed, text as tx, urls
from pagelattice.functions.binding import let
from pagelattice.operators.filters import is_address, is_code_remark, is_html_remark

_FINDING = "struct<kind:string,type:string,value:string,value_sha256:string,start:int,snippet:string>"

# A literal that every match of a pattern contains: texts without it skip the pattern.
_GUARDS = {"google_api": "AIza", "slack_token": "xox", "private_key": "PRIVATE KEY-----"}

# A look-ahead at the only characters a match can start with lets the search pass over the rest.
_STARTS = {"aws_key": "(?=A)", "generic_secret": "(?i)(?=[apst])"}

# Same matches as the plain pattern, found in linear time: a try starts only where a run of
# address characters starts (or where the last match ended), not at each of its characters.
_RUN = "[a-zA-Z0-9._%+-]"
_LINEAR_EMAIL = rf"(?:(?<!{_RUN})|\G){_RUN}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"


def _none() -> Column:
    return F.array().cast(f"array<{_FINDING}>")


def _finding(
    kind: str,
    type_: str | Column,
    value: Column,
    digest: Column | None = None,
    start: Column | None = None,
    snippet: Column | None = None,
) -> Column:
    absent = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(type_) if isinstance(type_, str) else type_).alias("type"),
        value.alias("value"),
        (absent if digest is None else digest).cast("string").alias("value_sha256"),
        (absent if start is None else start).cast("int").alias("start"),
        (absent if snippet is None else snippet).cast("string").alias("snippet"),
    )


def emails(text: Column) -> Column:
    """Addresses in the order found, image names left out."""
    found = F.filter(F.regexp_extract_all(text, F.lit(_LINEAR_EMAIL), F.lit(0)), is_address)
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit("@")), found).otherwise(none)


def email_findings(text: Column) -> Column:
    return F.transform(F.array_distinct(emails(text)), lambda e: _finding("email", "email", e))


def _mask(match: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(match))


def _hits(text: Column) -> Column:
    """Patterns that match with all their matches: array of (type, pattern, matches)."""
    none = F.array().cast("array<string>")
    tried = []
    for name, fixed_pattern in fixed.SECRET_PATTERNS.items():
        pattern = _STARTS.get(name, "") + fixed_pattern
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if name in _GUARDS:
            found = F.when(F.contains(text, F.lit(_GUARDS[name])), found).otherwise(none)
        tried.append(
            F.struct(
                F.lit(name).alias("type"), F.lit(pattern).alias("pattern"), found.alias("matches")
            )
        )
    return F.filter(F.array(*tried), lambda h: F.size(h["matches"]) > 0)


def _last(text: Column) -> Column:
    return F.substring(text, -20, 20)


def _first(text: Column) -> Column:
    return F.substring(text, 1, 20)


def _contexts(matches: Column, gaps: Column, i: Column) -> tuple[Column, Column]:
    """Up to 20 characters on both sides of match ``i``, other matches masked.

    No match is shorter than 15 characters, so two of them with the text between always fill
    the context.
    """

    def at(array: Column, place: Column, side: Callable[[Column], Column]) -> Column:
        return F.coalesce(side(F.get(array, place)), F.lit(""))

    before = F.concat(
        at(matches, i - 2, _mask), at(gaps, i - 1, _last), at(matches, i - 1, _mask), at(gaps, i, _last)
    )
    after = F.concat(
        at(gaps, i + 1, _first), at(matches, i + 1, _mask), at(gaps, i + 2, _first), at(matches, i + 2, _mask)
    )
    return _last(before), _first(after)


def _located(type_: Column, matches: Column, gaps: Column) -> Column:
    """Findings of one pattern from its matches and the pieces of text between them."""

    def entry(pair: Column, i: Column) -> Column:
        left, right = _contexts(matches, gaps, i)
        value = tx.redact(pair["match"])
        snippet = tx.strip_text(F.concat(left, value, right))
        return _finding("secret", type_, value, F.sha2(pair["match"], 256), pair["start"], snippet)

    def with_starts(starts: Column) -> Column:
        pairs = F.zip_with(
            matches, starts, lambda m, s: F.struct(m.alias("match"), s.alias("start"))
        )
        return F.transform(pairs, entry)

    earlier = F.concat(F.array(F.lit("")), matches)
    steps = F.zip_with(gaps, earlier, lambda g, e: F.length(g) + F.length(e))
    starts = let(F.slice(steps, F.lit(1), F.size(matches)), tx.running_totals)
    return let(starts, with_starts)


def secret_findings(text: Column) -> Column:
    """Every match of every pattern, with its position in code points.

    ``text`` must be a plain column. Positions come from the lengths of the pieces between
    matches, so a text with a great many matches still costs near linear time.
    """
    found = F.transform(
        _hits(text),
        lambda h: let(
            F.split(text, h["pattern"], -1), lambda gaps: _located(h["type"], h["matches"], gaps)
        ),
    )
    return F.flatten(found)


def _closed(text: Column, end: str) -> Column:
    """The text up to the last ``end``: no opening in it is searched to the text's end in vain."""
    return F.left(text, F.length(text) - F.length(F.substring_index(text, end, -1)))


def html_comments(text: Column) -> Column:
    raw = F.regexp_extract_all(_closed(text, "-->"), F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))
    return F.filter(F.transform(raw, tx.strip_text), is_html_remark)


def code_comments(text: Column) -> Column:
    """Line comments, then block comments, duplicates kept, long ones cut."""
    line = F.regexp_extract_all(_closed(text, "\n"), F.lit(r"(?d)//(.*?)\n"), F.lit(1))
    block = F.regexp_extract_all(_closed(text, "*/"), F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))
    kept = F.filter(F.transform(F.concat(line, block), tx.strip_text), is_code_remark)
    return F.transform(
        kept,
        lambda c: F.when(F.length(c) > 200, F.concat(F.left(c, F.lit(200)), F.lit("..."))).otherwise(c),
    )


def comment_findings(text: Column, content_type: Column) -> Column:
    html = F.transform(html_comments(text), lambda c: _finding("comment", "HTML", c))
    code = F.transform(code_comments(text), lambda c: _finding("comment", "JS/CSS", c))
    script = F.contains(content_type, F.lit("javascript")) | F.contains(content_type, F.lit("css"))
    return F.when(F.contains(content_type, F.lit("html")), html).when(script, code).otherwise(_none())


def _explode(captures: DataFrame, findings: Column) -> DataFrame:
    # explode_outer, because explode would make Spark evaluate the whole scan a second time in
    # an inferred "array is not empty" filter.
    rows = captures.select("source", F.explode_outer(findings).alias("f"))
    return rows.where(F.col("f").isNotNull()).select("f.*", "source")


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages as scanner input: (source, text, content_type)."""
    return pages.select(
        F.col("url").alias("source"), F.col("html").alias("text"), F.lit("text/html").alias("content_type")
    )


def asset_texts(assets: DataFrame) -> DataFrame:
    """Text assets as scanner input; the content type decides which comments are read.

    Images, fonts and media are left out before their bodies are read. Binary bodies are decoded.
    """
    text = urls.asset_category(F.col("url"), F.col("content_type")).isin("js", "css", "doc", "other")
    body = tx.decode_body(F.col("body")) if isinstance(assets.schema["body"].dataType, BinaryType) else F.col("body")
    return assets.where(text).select(F.col("url").alias("source"), body.alias("text"), "content_type")


def scan_emails(captures: DataFrame) -> DataFrame:
    return _explode(captures, email_findings(F.col("text")))


def scan_secrets(captures: DataFrame) -> DataFrame:
    return _explode(captures, secret_findings(F.col("text")))


def scan_html_comments(captures: DataFrame) -> DataFrame:
    found = F.transform(html_comments(F.col("text")), lambda c: _finding("comment", "HTML", c))
    return _explode(captures, found)


def scan_js_css_comments(captures: DataFrame) -> DataFrame:
    kind = F.col("content_type")
    script = F.contains(kind, F.lit("javascript")) | F.contains(kind, F.lit("css"))
    found = F.transform(code_comments(F.col("text")), lambda c: _finding("comment", "JS/CSS", c))
    return _explode(captures.where(script & ~F.contains(kind, F.lit("html"))), found)


def scan_comments(captures: DataFrame) -> DataFrame:
    """Comments of pages, scripts and style sheets, by content type."""
    return _explode(captures, comment_findings(F.col("text"), F.col("content_type")))


def all_findings(captures: DataFrame) -> DataFrame:
    """All kinds of findings in one long table, from one pass over the captures."""
    text, kind = F.col("text"), F.col("content_type")
    return _explode(
        captures, F.concat(secret_findings(text), email_findings(text), comment_findings(text, kind))
    )


def decode_captures(df: DataFrame, body: str = "body") -> DataFrame:
    """Binary captures as text; empty ones are dropped."""
    return df.withColumn("text", tx.decode_body(F.col(body))).where(F.col("text").isNotNull())

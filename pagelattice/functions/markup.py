"""Expressions over raw HTML and style text.

A page is read in one left-to-right pass of one pattern. Comments, scripts and style bodies are
consumed as whole tokens, so tags named inside them are never mistaken for tags of the page.
Quantifiers over quoted attributes are possessive, and what is never closed ends with the text, so
every try consumes what it reads: no character is read again for each broken tag before it.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from pagelattice.functions.binding import let

_REST_OF_TAG = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+'|["'])[^>"']*+)*+(?:>|\z)"""
# The leading "<" is shared by all alternatives, so other characters are passed over quickly.
_COMMENT = r"!--.*?(?:-->|\z)"
_SCRIPT = rf"script\b{_REST_OF_TAG}.*?(?:</script\s*>|\z)"
_STYLE = rf"style\b{_REST_OF_TAG}.*?(?:</style\s*>|\z)"
_OTHER = rf"[a-z]{_REST_OF_TAG}"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s>"']+)"""


# Characters by name, from the standard library's HTML 4 table, and by the numbers that HTML reads
# as Windows-1252.
_NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'"}
_RENUMBERED = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def _skipping(name: str) -> str:
    """Attributes in front of ``name``, so that only a real attribute of that name is read."""
    return rf"""(?:[\s/]+(?!{name}[\s=>/])[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?)*+"""


def _tag_with(name: str, attribute: str) -> str:
    return rf"{name}{_skipping(attribute)}[\s/]+{attribute}\s*=\s*{_VALUE}"


def _bare(value: Column) -> Column:
    quoted = F.substring(value, 1, 1).isin('"', "'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _numbered(point: Column) -> Column:
    """The character of a code point, as HTML reads it."""
    sign = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    unusable = (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    usual = F.when(unusable, F.lit("\ufffd")).otherwise(sign)
    return F.when(point.between(0x80, 0x9F), F.element_at(_table(_RENUMBERED), point.cast("int"))).otherwise(usual)


def decode_references(text: Column) -> Column:
    """Character references by number and by name, each decoded once; unknown names stay."""

    def decoded(piece: Column) -> Column:
        def sign(ref: Column) -> Column:
            hexed = F.lower(F.substring(ref, 2, 1)) == "x"
            number = F.when(hexed, F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).try_cast("bigint")
            return F.when(F.startswith(ref, F.lit("#")), let(number, _numbered)).otherwise(F.try_element_at(_table(_NAMED), ref))

        name = F.regexp_extract(piece, rf"(?s)^{_REFERENCE}", 0)
        rest = lambda n: F.substring(piece, F.length(n) + 1, F.length(piece))
        return let(
            name,
            lambda n: F.when(n == "", piece).otherwise(
                F.concat(F.coalesce(sign(F.substring(n, F.lit(2), F.length(n) - 2)), n), rest(n))
            ),
        )

    # Every piece but the first begins with a reference.
    pieces = F.split(text, rf"(?={_REFERENCE})", -1)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def unquote_value(raw: Column) -> Column:
    """Attribute value without its quotes, character references decoded."""
    return let(let(raw, _bare), decode_references)


def quote_value(text: Column) -> Column:
    """Text as a double-quoted attribute value."""
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute as written, quotes included; '' when the tag lacks it."""
    return F.regexp_extract(tag, rf"(?is)^<[a-z0-9]+{_skipping(name)}[\s/]+{name}\s*=\s*{_VALUE}", 1)


def attribute(tag: Column, name: str) -> Column:
    return unquote_value(raw_attribute(tag, name))


def plain_attribute(tag: Column, name: str) -> Column:
    """Attribute value without its quotes, entities as they are: enough for names and tests."""
    return let(raw_attribute(tag, name), _bare)


def has_attribute(tag: Column, name: str) -> Column:
    """Whether the attribute is there with a non-empty value."""
    return plain_attribute(tag, name) != ""


def set_attribute(tag: Column, name: str, value: Column) -> Column:
    """Tag with the value of an attribute replaced; the text around it stays byte for byte."""
    lead = rf"(?is)^(<[a-z0-9]+{_skipping(name)}[\s/]+{name}\s*=\s*){_VALUE}"
    # The new value is put in literally: '$' and '\\' have a meaning in replacement text.
    literal = F.replace(F.replace(quote_value(value), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(tag, F.lit(lead), F.concat(F.lit("$1"), literal))


def drop_attribute(tag: Column, name: str) -> Column:
    return F.regexp_replace(
        tag,
        rf"""(?is)^(<[a-z0-9]+{_skipping(name)})[\s/]+{name}(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']*))?(?=[\s/>])""",
        "$1",
    )


def has_rel(tag: Column, test: Callable[[Column], Column]) -> Column:
    """Whether any white-space separated token of ``rel`` passes the test."""
    return F.exists(F.split(plain_attribute(tag, "rel"), r"\s+"), test)


def attribute_values(html: Column, tag: str, name: str) -> Column:
    """Values of one attribute over all tags of one kind, in page order."""
    pattern = rf"(?is)<(?:{_COMMENT}|{_SCRIPT}|{_STYLE}|{_tag_with(tag, name)}|{_OTHER})"
    raw = F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda r: r != "")
    return F.transform(raw, unquote_value)


_TOKENS = rf"(?is)<(?:{_COMMENT}|{_SCRIPT}|{_STYLE}|/head\s*>|{_OTHER})"
_ASSET_TOKENS = (
    rf"(?is)<(?:{_COMMENT}|{_SCRIPT}|({_STYLE}"
    rf"|(?:link|img|source)\b{_REST_OF_TAG}"
    rf"|[a-z][a-z0-9]*{_skipping('style')}[\s/]+style\s*={_REST_OF_TAG})|{_OTHER})"
)


def asset_tokens(html: Column) -> Column:
    """Tags and style blocks that can refer to an asset, in page order."""
    found = F.regexp_extract_all(html, F.lit(_ASSET_TOKENS), F.lit(1))
    return F.transform(F.filter(found, lambda t: t != ""), lambda t: F.concat(F.lit("<"), t))


def tag_name(token: Column) -> Column:
    """Lower-cased element name; '' for a comment."""
    return F.lower(F.regexp_extract(token, r"^<([A-Za-z][A-Za-z0-9]*)", 1))


def tokens(html: Column) -> Column:
    """All comments, script and style blocks and opening tags, in page order."""
    return F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(0))


def between_tokens(html: Column) -> Column:
    """The text before, between and after the tokens: one entry more than ``tokens``."""
    return F.split(html, _TOKENS, -1)


def reassemble(gaps: Column, parts: Column) -> Column:
    """Page from the text between tokens and the (rewritten) tokens."""
    woven = F.zip_with(gaps, parts, lambda gap, part: F.concat(gap, F.coalesce(part, F.lit(""))))
    return F.array_join(woven, "")

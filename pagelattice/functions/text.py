"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagelattice.functions import fixed


def strip_text(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def redact(text: Column) -> Column:
    """First five and last three characters."""
    return F.concat(F.substring(text, 1, 5), F.lit("..."), F.substring(text, -3, 3))


def decode_body(body: Column) -> Column:
    """UTF-8 text of a binary body with undecodable bytes dropped; null when empty."""
    text = body.cast("string")
    valid = F.when(F.is_valid_utf8(text), text).otherwise(
        F.translate(F.make_valid_utf8(text), "�", "")
    )
    return F.when(F.octet_length(body) > 0, valid)


_BLOCK = 256


def running_totals(numbers: Column) -> Column:
    """Inclusive prefix sums of an int array.

    Works in blocks so that the cost stays near linear for rows with very many entries:
    growing one accumulator array over the whole row would copy it at every step.
    """
    zero = F.lit(0)
    blocks = F.transform(
        F.sequence(zero, F.floor((F.size(numbers) - 1) / F.lit(_BLOCK)).cast("int")),
        lambda b: F.slice(numbers, b * F.lit(_BLOCK) + 1, F.lit(_BLOCK)),
    )
    offsets = F.aggregate(
        blocks,
        F.array(zero),
        lambda acc, block: F.array_append(
            acc, F.element_at(acc, -1) + F.aggregate(block, zero, lambda s, x: s + x)
        ),
    )
    inner = F.zip_with(
        blocks,
        F.slice(offsets, F.lit(1), F.size(blocks)),
        lambda block, offset: F.aggregate(
            block,
            F.array().cast("array<int>"),
            lambda acc, x: F.array_append(
                acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), offset) + x
            ),
        ),
    )
    return F.when(F.size(numbers) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))

"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once.

    A Column used several times is evaluated several times inside a lambda, where Spark shares
    no subexpressions; a lambda variable is bound once.
    """
    return F.transform(F.array(value), body)[0]

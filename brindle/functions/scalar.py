"""Scalar functions whose reading differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def int_div(a: Column, b: Column, kind: T.DataType) -> Column:
    """Truncating division, in the common integer type of its operands; a zero divisor is an error."""
    return F.call_function("div", a, b).cast(kind)


def try_int_div(a: Column, b: Column, kind: T.DataType) -> Column:
    """The same with null for a zero divisor."""
    return F.when(b == 0, F.lit(None)).otherwise(F.call_function("div", a, b)).cast(kind)


def ascii_upper(s: Column) -> Column:
    """upper() on a-z only, byte for byte."""
    return F.translate(s, _LOWER, _UPPER)


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def shown(predicate: Column) -> Column:
    """A predicate as a select-list value that is false where it is null."""
    return F.coalesce(predicate, F.lit(False))

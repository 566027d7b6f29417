"""Comparison and ordering of schemaless attributes: numbers where both sides can be, text where neither is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def number(text: Column) -> Column:
    """The double a string spells, or null. Suffixes such as 5d, which a plain cast takes, are no numbers."""
    return F.when(text.rlike(f"(?i){_NUMBER}"), F.trim(text).try_cast("double"))


def compare(left: Column, op: str, right: Column, left_is_number: bool, right_is_number: bool) -> Column:
    """left op right, false if either is missing.

    Two numbers compare as numbers, a number and a string if the string spells one, two strings as bytes. A pair that
    can't be ordered is only unequal."""
    if left_is_number and right_is_number:
        a, b = left.cast("double"), right.cast("double")
    elif left_is_number or right_is_number:
        a = left.cast("double") if left_is_number else number(left)
        b = right.cast("double") if right_is_number else number(right)
    else:
        a, b = left, right
    base = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    told = F.coalesce(base, F.lit(op == "!="))
    return left.isNotNull() & right.isNotNull() & told


def order_keys(value: Column, is_number: bool, descending: bool = False) -> list[Column]:
    """Keys of a total order: numbers and what spells one first, by value; then text; then what is missing."""
    n = value.cast("double") if is_number else number(value)
    rank = F.when(n.isNotNull(), 0).when(value.isNotNull(), 1).otherwise(2)
    keys = [rank, n, value.cast("string")]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]

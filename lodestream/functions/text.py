"""Tokenizers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column, least_bytes: int = 2) -> Column:
    """Lower-cased runs of letters and digits of at least so many bytes: 2 for ranked search, 1 for recall."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: F.octet_length(t) >= least_bytes)


def occurrences(text: Column, part: str) -> Column:
    """How often part stands in text, without overlaps."""
    if not part:
        return F.lit(0).cast("bigint")
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")

"""Read-only SQL over the events view of a log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BLOCKED = re.compile(r"\b(parquet|csv|json|orc|text|avro|binaryfile|delta|jdbc)\s*\.\s*[`'\"]", re.I)

_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: Functions that run code of their caller's choice.
_REFLECTION = re.compile(r"(?i)\b(java_method|reflect|try_reflect)\s*\(")


def guard(text: str) -> str:
    """The one query of text; anything but SELECT, WITH, VALUES, FROM or EXPLAIN, and reads of files by path, is refused."""
    # Literals first: what looks like a comment within one isn't.
    bare = _TOKENS.sub(lambda m: m[0] if m[0][0] in "'\"`" else " ", text).strip().rstrip(";").strip()
    outside = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", bare)
    if ";" in outside:
        raise ValueError("one statement at a time")
    if not re.match(r"\(*\s*(select|with|values|from|explain)\b", outside, re.I):
        raise ValueError("only queries are allowed")
    if _BLOCKED.search(outside) or re.search(r"\b(insert\s+(into|overwrite)|create\s+(table|view|or))\b", outside, re.I):
        raise ValueError("only queries over the given tables are allowed")
    if m := _REFLECTION.search(re.sub("`", "", outside)):
        raise ValueError(f"{m[1]} is not allowed")
    return bare


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of a query over tables, each under its name; no view outlives the call."""
    bare = guard(text).replace("{", "{{").replace("}", "}}")
    names = sorted(tables, key=len, reverse=True)
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", bare)
    if names:
        rx = re.compile(rf"(?i)\b(from|join|,)(\s+)({'|'.join(names)})\b(\s+(?!(?:on|where|group|order|join|left|right|full|inner|cross|limit|union|having|using|natural|semi|anti|window|qualify|lateral|intersect|except|tablesample|pivot|offset)\b)(?:as\s+)?[a-z_]\w*)?")
        parts = [p if i % 2 else rx.sub(lambda m: f"{m[1]}{m[2]}{{{m[3].lower()}}}{m[4] or f' AS {m[3]}'}", p) for i, p in enumerate(parts)]
    used = {n: t for n, t in tables.items() if f"{{{n.lower()}}}" in "".join(parts)}
    return spark.sql("".join(parts), **used)

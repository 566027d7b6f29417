"""Sketches, digests and the small expression language of filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_min(rows: DataFrame, key: str, eps: float, confidence: float, keys: list) -> DataFrame:
    """(key, estimate): never below the true count, above it by eps of all rows at most with that confidence.

    Counters are sums by (depth, cell), so they merge before and after a shuffle; a key's estimate is its least one."""
    width, depth = math.ceil(2 / eps), max(1, math.ceil(-math.log2(1 - confidence)))
    cell = lambda c, i: F.pmod(F.xxhash64(F.lit(i), c), F.lit(width))
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), cell(F.col(key), i).alias("cell")) for i in range(depth)))).alias("x")).groupBy("x.i", "x.cell").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.sparkSession.createDataFrame([(k,) for k in keys], rows.select(key).schema)
    asked = asked.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), cell(F.col(key), i).alias("cell")) for i in range(depth)))).alias("x")).select(key, "x.i", "x.cell")
    return asked.join(cells, ["i", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def merkle_root(rows: DataFrame, order: Column, leaf: Column, block: int = 4096) -> DataFrame:
    """One row: the SHA-256 root over leaves in order (a position from 0). Blocks are folded where they are, then the roots of blocks,
    level by level; an odd last hash goes up as it is. No task folds more than a block."""

    def fold(hashes: list[bytes]) -> bytes:
        while len(hashes) > 1:
            hashes = [hashlib.sha256(hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
        return hashes[0]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        return pd.DataFrame([(int(pdf["i"].iloc[0]) // block, fold([bytes(x) for x in pdf["h"]]))], columns=["i", "h"])

    now = rows.select(order.cast("bigint").alias("i"), F.unhex(F.sha2(leaf.cast("binary"), 256)).alias("h"))
    size = now.agg(F.max("i")).first()[0]
    while size is not None and size >= 0:
        now = now.groupBy(F.floor(F.col("i") / block).alias("b")).applyInPandas(run, "i bigint, h binary")
        if size < block:
            break
        size //= block
    return now.select(F.lower(F.hex("h")).alias("root"))


class HyperLogLog:
    """A sketch of distinct 64-bit hashes, for hosts without the engine's own; p is 4 to 16."""

    def __init__(self, p: int = 12):
        self.p, self.registers = p, np.zeros(1 << p, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        h = hashes.astype(np.uint64)
        rest = (h << np.uint64(self.p)) | np.uint64((1 << self.p) - 1)
        rank = (64 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint8) + 1
        np.maximum.at(self.registers, (h >> np.uint64(64 - self.p)).astype(np.int64), rank)

    def merge(self, other: HyperLogLog) -> HyperLogLog:
        np.maximum(self.registers, other.registers, out=self.registers)
        return self

    def estimate(self) -> float:
        m = len(self.registers)
        raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -self.registers.astype(float))
        zeros = int((self.registers == 0).sum())
        return m * math.log(m / zeros) if raw <= 2.5 * m and zeros else raw


_ARITH, _COMPARE, _LOGIC = ("add", "sub", "mul"), ("gt", "lt", "eq"), ("and", "or")


def expression(node: tuple, types: dict[str, str]) -> tuple[Column, str]:
    """(column, type) of a typed expression: ("const", v), ("column", name), (op, a, b) or ("not", a); types are i64, f64
    and bool and never mix."""
    op = node[0]
    if op == "const":
        v = node[1]
        kind = "bool" if isinstance(v, bool) else "i64" if isinstance(v, int) else "f64"
        return F.lit(v), kind
    if op == "column":
        return F.col(node[1]), types[node[1]]
    args = [expression(a, types) for a in node[1:]]
    kinds = {k for _, k in args}
    if len(kinds) != 1:
        raise TypeError(f"{op} of {sorted(kinds)}")
    kind, c = kinds.pop(), [x for x, _ in args]
    if op in _ARITH and kind != "bool":
        return {"add": lambda: c[0] + c[1], "sub": lambda: c[0] - c[1], "mul": lambda: c[0] * c[1]}[op](), kind
    if op in _COMPARE and (kind != "bool" or op == "eq"):
        return {"gt": lambda: c[0] > c[1], "lt": lambda: c[0] < c[1], "eq": lambda: c[0] == c[1]}[op](), "bool"
    if op in _LOGIC and kind == "bool":
        return (c[0] & c[1]) if op == "and" else (c[0] | c[1]), "bool"
    if op == "not" and kind == "bool":
        return ~c[0], "bool"
    raise TypeError(f"{op} of {kind}")


def run_length(values: Iterator) -> list[tuple]:
    """(value, count) of runs, as column encodings keep them."""
    out: list[list] = []
    for v in values:
        if out and out[-1][0] == v:
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return [tuple(x) for x in out]

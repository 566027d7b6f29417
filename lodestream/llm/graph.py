"""Connected components of an undirected graph of integer nodes, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _digest(df: DataFrame):
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root: the least node that it is connected with.

    edges: u, v (bigint), in any order, repeats and loops allowed; null ends are left out. Each round writes its edges to
    the shared folder, so lineage stays short and a lost executor costs one round at most. The rounds grow with the
    logarithm of the number of nodes.
    """
    now = Written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now.df)
    for _ in range(most_rounds if seen[0] else 0):
        after = Written(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now, last = after, seen
        seen = _digest(now.df)
        if seen == last:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.df.select(F.col("v").alias("node")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))

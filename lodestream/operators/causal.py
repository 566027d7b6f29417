"""Causes of episodes along their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.graph import bfs, materialize


def parent_edges(episodes: DataFrame) -> DataFrame:
    """(effect, cause) of all episodes whose cause is in the snapshot too."""
    e = episodes.select(F.col("id").alias("effect"), F.posexplode("parents").alias("rank", "cause"))
    return e.join(episodes.select(F.col("id").alias("cause")), "cause", "left_semi").select("effect", "cause", "rank")


def provenance(episodes: DataFrame, id_: str) -> DataFrame:
    return episodes.where(F.col("id") == id_).select(F.explode("parents").alias("parent"))


def ancestors(episodes: DataFrame, id_: str, depth: int = 64) -> DataFrame:
    return bfs(parent_edges(episodes), id_, depth, "effect", "cause")


def why(episodes: DataFrame, id_: str, depth: int = 64) -> DataFrame:
    """(depth, id, is_root) of an episode and all that led to it; a root has no cause within the snapshot."""
    found = ancestors(episodes, id_, depth).unionByName(episodes.where(F.col("id") == id_).select(F.col("id").alias("node"), F.lit(0).alias("depth")))
    caused = parent_edges(episodes).select(F.col("effect").alias("node")).distinct().withColumn("caused", F.lit(True))
    return found.join(caused, "node", "left").select("depth", F.col("node").alias("id"), F.col("caused").isNull().alias("is_root"))


def why_until(episodes: DataFrame, effect: str, cause: str, depth: int = 64) -> list[str] | None:
    """The shortest chain from effect to cause, ties by the order of parents; None if there is none."""
    edges = materialize(parent_edges(episodes))
    spark = episodes.sparkSession
    paths = spark.createDataFrame([(effect, [effect], [0])], "node string, path array<string>, ranks array<int>")
    seen = paths.select("node")
    for _ in range(depth):
        hit = paths.where(F.col("node") == cause).select("path").first()
        if hit:
            return list(hit[0])
        step = edges.join(paths, edges["effect"] == paths["node"]).select(F.col("cause").alias("node"), F.concat("path", F.array("cause")).alias("path"), F.concat("ranks", F.array("rank")).alias("ranks"))
        step = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min_by("path", "ranks").alias("path"), F.min("ranks").alias("ranks"))
        paths = materialize(step)
        if paths.isEmpty():
            return None
        seen = materialize(seen.union(paths.select("node")))
    hit = paths.where(F.col("node") == cause).select("path").first()
    return list(hit[0]) if hit else None

"""Entity identity over time: mentions, merges and splits folded in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.graph import components

INTERVALS = "key string, entity_id string, from_lsn bigint, to_lsn bigint"


def _fold(rows) -> list[tuple]:
    at: dict[str, tuple[str, int]] = {}
    group: dict[str, set[str]] = {}
    out: list[tuple] = []

    def put(key: str, entity: str, lsn: int) -> None:
        if key in at:
            old, since = at[key]
            if since < lsn:
                out.append((key, old, since, lsn))
            group[old].discard(key)
        at[key] = (entity, lsn)
        group.setdefault(entity, set()).add(key)

    for lsn, op, a, b in rows:
        if op == "mention":
            if a not in at:
                put(a, a, lsn)
        elif op == "split":
            if a in at:
                put(a, f"{a}@{lsn}", lsn)
        else:
            for k in (a, b):
                if k not in at:
                    put(k, k, lsn)
            x, y = at[a][0], at[b][0]
            if x != y:
                for k in sorted(group[max(x, y)]):
                    put(k, min(x, y), lsn)
    return out + [(k, e, s, None) for k, (e, s) in at.items()]


def entity_intervals(episodes: DataFrame) -> DataFrame:
    """key, entity_id, from_lsn, to_lsn (null: open). Groups of keys that merges ever connect are folded apart from each
    other, in order; a key that no merge names is a group of its own and needs only its first mention and splits."""
    a = F.col("attrs")
    op = F.lower(a["er_op"])
    ops = episodes.select(
        "lsn",
        F.when((op == "merge") & a["er_a"].isNotNull() & a["er_b"].isNotNull(), "merge").when((op == "split") & a["er_key"].isNotNull(), "split").when(a["entity_key"].isNotNull(), "mention").alias("op"),
        F.when(op == "merge", a["er_a"]).when(op == "split", a["er_key"]).otherwise(a["entity_key"]).alias("a"),
        F.when(op == "merge", a["er_b"]).alias("b"),
    ).where("op IS NOT NULL")
    merges = ops.where("op = 'merge'").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    group = components(merges).select(F.col("node").alias("a"), F.col("community").alias("g"))
    # Later mentions of a key change nothing.
    first = Window.partitionBy("a").orderBy("lsn")
    rows = ops.where("op <> 'mention'").unionByName(ops.where("op = 'mention'").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"))
    rows = rows.join(group, "a", "left").withColumn("g", F.coalesce("g", "a"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("lsn")
        return pd.DataFrame(_fold(pdf[["lsn", "op", "a", "b"]].itertuples(index=False)), columns=["key", "entity_id", "from_lsn", "to_lsn"]).astype({"from_lsn": "Int64", "to_lsn": "Int64"})

    return rows.groupBy("g").applyInPandas(run, INTERVALS)


def _at(intervals: DataFrame, as_of: int | None) -> DataFrame:
    if as_of is None:
        return intervals.where("to_lsn IS NULL")
    return intervals.where((F.col("from_lsn") < as_of) & (F.col("to_lsn").isNull() | (F.col("to_lsn") >= as_of)))


def resolve(intervals: DataFrame, key: str, as_of: int | None = None) -> DataFrame:
    return _at(intervals, as_of).where(F.col("key") == key).select("entity_id")


def cluster(intervals: DataFrame, entity: str, as_of: int | None = None) -> DataFrame:
    return _at(intervals, as_of).where(F.col("entity_id") == entity).select("key").orderBy("key")

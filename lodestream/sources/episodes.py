"""The event log: one immutable row per episode, and what is derived from it by replaying it in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in ("hyp", "sph", "euc")])
EPISODES = T.StructType(
    [
        T.StructField("lsn", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("ts_hlc", T.LongType(), False),
        T.StructField("agent_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", EMBEDDING),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("parents", T.ArrayType(T.StringType()), False),
        T.StructField("valid_from", T.LongType()),
        T.StructField("valid_to", T.LongType()),
    ]
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(ts) -> F.Column:
    """Milliseconds of a timestamp without zone."""
    return F.unix_millis(F.col(ts).cast("timestamp")) if isinstance(ts, str) else F.unix_millis(ts.cast("timestamp"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the events table. An event's parent is the one before it of the same user, and it holds until the next."""
    user = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, sf_dir, "events").withColumn("ms", ms("ts"))
    k = F.get_json_object("props", "$.k")
    before = F.lag("event_id").over(user)
    return e.select(
        F.col("event_id").alias("lsn"),
        F.concat(F.lit("e"), "event_id").alias("id"),
        F.shiftleft("ms", 16).alias("ts_hlc"),
        F.concat(F.lit("u"), "user_id").alias("agent_id"),
        F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.col("event_type").alias("kind"),
        F.col("props").alias("content"),
        F.lit(None).cast(EMBEDDING).alias("embedding"),
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), k).alias("attrs"),
        F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), before))).alias("parents"),
        F.col("ms").alias("valid_from"),
        F.lead("ms").over(user).alias("valid_to"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose attributes say that a user touches a key: an assertion per event, a retraction per error."""
    e = from_events(spark, sf_dir)
    value, k = F.col("attrs")["value"], F.col("attrs")["k"]
    # One literal map, so that the optimizer puts its entries in place of lookups; a concatenation would be made anew for each.
    attrs = F.create_map(
        F.lit("value"), value, F.lit("k"), k,
        F.lit("edge_from"), F.col("agent_id"), F.lit("edge_to"), F.concat(F.lit("k"), k), F.lit("edge_type"), F.lit("touch"),
        F.lit("edge_op"), F.when(F.col("kind") == "error", "retract").otherwise("assert"), F.lit("hypothesis"), F.col("kind"),
        F.lit("stance"), F.when(F.col("kind") == "view", "refute").otherwise("support"),
        F.lit("confidence"), F.round(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), value.cast("double") / 500)), 6).cast("string"),
    )
    return e.withColumn("attrs", attrs)


def snapshot(episodes: DataFrame, lsn: int | None = None, timestamp_ms: int | None = None) -> DataFrame:
    """What is visible AS OF an LSN (exclusive) or a time in ms (inclusive): one predicate, pushed to the scan."""
    if lsn is not None:
        return episodes.where(F.col("lsn") < lsn)
    if timestamp_ms is not None:
        later = episodes.where(F.shiftright("ts_hlc", 16) > timestamp_ms).agg(F.min("lsn").alias("bound"))
        return episodes.crossJoin(later).where(F.col("bound").isNull() | (F.col("lsn") < F.col("bound"))).drop("bound")
    return episodes


def valid_at(episodes: DataFrame, t: float) -> DataFrame:
    """World validity at t: the native half-open interval, else numeric attributes; open where neither is there."""
    from lodestream.functions.compare import number

    frm = F.coalesce(F.col("valid_from").cast("double"), number(F.col("attrs")["valid_from"]))
    to = F.coalesce(F.col("valid_to").cast("double"), number(F.col("attrs")["valid_to"]))
    return episodes.where((frm.isNull() | (frm <= t)) & (to.isNull() | (to > t)))


def head(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.coalesce(F.max("lsn") + 1, F.lit(0)).alias("head"))


def events_view(episodes: DataFrame) -> DataFrame:
    """The ten columns of the SQL table: absent validity is 0."""
    zero = F.lit(0).cast("bigint")
    return episodes.select("lsn", "id", "agent_id", "session_id", "ts_hlc", "kind", "content", F.to_json("attrs").alias("attrs_json"), F.coalesce("valid_from", zero).alias("valid_from"), F.coalesce("valid_to", zero).alias("valid_to"))


def mirror(episodes: DataFrame) -> DataFrame:
    """The twelve columns of the Parquet mirror: absent validity is null."""
    return episodes.select("lsn", "id", "agent_id", "session_id", "ts_hlc", "kind", F.col("content").cast("binary").alias("content"), F.to_json("attrs").alias("attrs_json"), F.to_json("parents").alias("parents_json"), "valid_from", "valid_to", F.to_json("embedding").alias("embedding_json"))

"""Reports over the log: fields and values, window differences, sources, footprints, zone maps, the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.compare import number


def postings(episodes: DataFrame) -> DataFrame:
    return episodes.select("lsn", F.explode("attrs").alias("field", "value"))


def field_values(episodes: DataFrame, field: str) -> DataFrame:
    return episodes.select(F.col("attrs")[field].alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def field_span(episodes: DataFrame, field: str, value: str) -> DataFrame:
    return episodes.where(F.col("attrs")[field] == value).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def fields(episodes: DataFrame) -> DataFrame:
    return postings(episodes).groupBy("field").agg(F.countDistinct("value").alias("n_values"))


def diff(episodes: DataFrame, start: int, end: int, top: int) -> DataFrame:
    """Values per field in [start, end) against the window of the same length before: new, silent or active, the top ones."""
    before = max(0, start - (end - start))
    now = (F.col("lsn") >= start) & (F.col("lsn") < end)
    rows = postings(episodes.where((F.col("lsn") >= before) & (F.col("lsn") < end))).groupBy("field", "value").agg(F.sum(now.cast("bigint")).alias("n_now"), F.sum((~now).cast("bigint")).alias("n_before"))
    state = F.when(F.col("n_before") == 0, "new").when(F.col("n_now") == 0, "silent").otherwise("active")
    order = Window.partitionBy("field").orderBy((F.col("n_before") == 0).desc(), (F.col("n_now") == 0).desc(), F.greatest("n_now", "n_before").desc(), "value")
    return rows.withColumn("state", state).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def sources(episodes: DataFrame) -> DataFrame:
    t = F.shiftright("ts_hlc", 16)
    return episodes.groupBy("agent_id").agg(F.count(F.lit(1)).alias("events"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"))


def source_detail(episodes: DataFrame, agent: str) -> DataFrame:
    mine = episodes.where(F.col("agent_id") == agent)
    return mine.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions"), F.avg(F.octet_length("content")).alias("mean_bytes"))


def footprint(episodes: DataFrame, agent: str) -> DataFrame:
    t = F.shiftright("ts_hlc", 16)
    return episodes.where(F.col("agent_id") == agent).groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"))


def accesses(episodes: DataFrame, agent: str) -> DataFrame:
    audit = F.col("attrs")["audit"]
    return episodes.where(audit.isNotNull() & (F.contains(audit, F.lit(agent)) | F.contains(F.col("content"), F.lit(agent))))


def zone_map(episodes: DataFrame, segment_rows: int) -> DataFrame:
    seg = F.floor(F.col("lsn") / segment_rows)
    return episodes.groupBy(seg.alias("segment")).agg(F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.min("ts_hlc").alias("min_ts"), F.max("ts_hlc").alias("max_ts"), F.min("agent_id").alias("min_agent"), F.max("agent_id").alias("max_agent"))


def ledger(ops: DataFrame) -> DataFrame:
    """(key, value) after all of ops (lsn, op, key, value): the last one of a key counts, a delete takes it away."""
    return ops.groupBy("key").agg(F.max_by(F.struct("op", "value"), "lsn").alias("x")).where("x.op <> 'delete'").select("key", F.col("x.value").alias("value"))


def threshold_scores(feedback: DataFrame) -> DataFrame:
    """Precision, recall and F1 for each distinct score as a threshold; feedback: score, good."""
    by = feedback.groupBy("score").agg(F.sum(F.col("good").cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("score"))  # a row per distinct score
    c = by.select("score", F.sum("tp").over(w).alias("tp"), F.sum("n").over(w).alias("n")).crossJoin(feedback.agg(F.coalesce(F.sum(F.col("good").cast("bigint")), F.lit(0)).alias("all")))
    p, r = F.col("tp") / F.col("n"), F.coalesce(F.try_divide(F.col("tp"), F.col("all")), F.lit(0.0))
    return c.select("score", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def adapt(episodes: DataFrame, rule: str = "flag_anomaly", default: float = 1.5) -> DataFrame:
    """The threshold with the best F1 on confirmed and rejected feedback, the lowest of equals; the default without any."""
    a = F.col("attrs")
    fb = episodes.where(a["feedback_rule"] == rule).select(number(a["score"]).alias("score"), (a["verdict"] == "confirm").alias("good")).where("score IS NOT NULL")
    best = threshold_scores(fb).orderBy(F.desc(F.round("f1", 9)), "score").limit(1)
    n = fb.agg(F.count(F.lit(1)).alias("samples"))
    return n.join(best, F.lit(True), "left").select("samples", F.coalesce("score", F.lit(default)).alias("threshold"), F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def decide(metrics: DataFrame, edges: DataFrame, done: DataFrame | None = None, z: float = 1.5, belief: float = 0.7) -> DataFrame:
    """(rule, subject, score, action_id) of the rules: outliers by degree, and edges of fraud partners that are believed.
    Actions that are in done (action_id) aren't proposed again."""
    a = metrics.where(F.col("z_score") >= z).select(F.lit("flag_anomaly").alias("rule"), F.col("node").alias("subject"), F.col("z_score").alias("score"))
    b = edges.where((F.col("etype") == "fraud_partner") & (F.col("belief") >= belief)).select(F.lit("flag_fraud").alias("rule"), F.col("edge_id").alias("subject"), F.col("belief").alias("score"))
    out = a.unionByName(b).withColumn("action_id", F.concat_ws(":", "rule", "subject"))
    return out if done is None else out.join(done.select("action_id"), "action_id", "left_anti").select(*out.columns)

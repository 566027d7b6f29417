"""The log as a stream: history and then the live tail, windows over it, and folds that follow it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def subscribe(spark: SparkSession, folder: str, schema, from_lsn: int = 0, key: str = "event_id", files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder of events as they come, from a sequence number on; offsets are in the checkpoint, so there is no gap."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).where(F.col(key) >= from_lsn)


def windowed(stream: DataFrame, ts: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts by event type and window; what is later than `late` behind the stream's time is left out."""
    t = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return t.groupBy(F.window("__ts", size, slide) if slide else F.window("__ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    return stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([key]).drop("__ts")


def follow(stream: DataFrame, sinks: list, checkpoint: str) -> StreamingQuery:
    """Each batch goes to every sink in order; the first that fails ends the stream, and the batch comes again on restart."""

    def each(batch: DataFrame, epoch: int) -> None:
        for sink in sinks:
            sink(batch, epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, counted by a stream that runs until it has read what is there."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = f"counts_{uuid.uuid4().hex}"
    base = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestream-")).rstrip("/")
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet") if "://" not in sf_dir else spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events*.parquet")
    q = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/streams/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


LEDGER = "key string, value string, lsn bigint, deleted boolean"


def ledger_stream(stream: DataFrame) -> DataFrame:
    """(key, value, lsn, deleted) whenever a key's newest operation changes; stream: lsn, op, key, value.

    The state of a key is its newest operation. One that comes late, with a smaller sequence number, changes nothing."""

    def run(key, frames, state):
        import pandas as pd

        had = state.get if state.exists else ("", -1, True)
        now = had
        for f in frames:
            for lsn, op, value in f[["lsn", "op", "value"]].itertuples(index=False):
                if lsn > now[1]:
                    now = (value, int(lsn), op == "delete")
        if now != had:
            state.update(now)
            yield pd.DataFrame([(str(key[0]), *now)], columns=["key", "value", "lsn", "deleted"])

    return stream.groupBy("key").applyInPandasWithState(run, LEDGER, "value string, lsn bigint, deleted boolean", "append", "NoTimeout")


class View:
    """A table that follows the log batch by batch: fold(state or None, batch) gives the next state.

    States are written whole under path, by the number of the batch, so a batch that comes again after a failure writes
    the same state from the same one before it."""

    def __init__(self, spark: SparkSession, path: str, fold):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold

    def apply(self, batch: DataFrame, epoch: int) -> None:
        before = self.spark.read.parquet(f"{self.path}/{epoch - 1}") if epoch else None
        self.fold(before, batch).write.mode("overwrite").parquet(f"{self.path}/{epoch}")

    def at(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{epoch}")

"""One object for all that can be asked of a log: the query language, SQL, reports, appends, exports."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.sketches import merkle_root
from lodestream.operators import reports, retrieval
from lodestream.plans.gql import GqlError, Session, parse, required_access
from lodestream.plans.sql import sql
from lodestream.sources.episodes import events_view, mirror, snapshot
from lodestream.sources.log import Log, cold_compaction, deleted


class Forbidden(PermissionError):
    """A statement that writes, by a principal who may only read."""


class TooLarge(ValueError):
    """A result beyond the rows that a caller allows."""


class Engine:
    """Queries and appends over the log at path."""

    def __init__(self, spark: SparkSession, path: str, audit: bool = False):
        self.spark, self.log, self.audited = spark, Log(spark, path), audit

    # queries

    def query(self, text: str, may_write: bool = True, principal: str = "local") -> DataFrame:
        """The rows of a statement. CREATE and DECIDE append what they make, and give its sequence number."""
        s = parse(text)
        writes = required_access(s) == "write"
        if writes and not may_write:
            raise Forbidden(s.name)
        out = Session(self.log.episodes()).run(text)
        if writes and s.name == "CREATE":
            rows = out.select("agent_id", "session_id", "kind", "attrs")
            first, _ = self.log.append(rows)
            out = self.spark.createDataFrame([(first,)], "lsn bigint")
        elif writes and s.name == "DECIDE":
            done = out.select(F.lit("Action").alias("kind"), F.lit("decide").alias("agent_id"), F.create_map(F.lit("action_id"), F.col("action_id"), F.lit("rule"), F.col("rule"), F.lit("subject"), F.col("subject"), F.lit("score"), F.col("score").cast("string")).alias("attrs"))
            first, n = self.log.append(done)
            out = self.log.scan(first, first + n).select("lsn", F.col("attrs")["action_id"].alias("action_id"), F.col("attrs")["rule"].alias("rule"), F.col("attrs")["subject"].alias("subject"))
        if self.audited:
            self.audit("query", principal, True, text)
        return out

    def sql(self, text: str, as_of: int | None = None, most_rows: int | None = None) -> DataFrame:
        """A read-only query over the table events. most_rows: results beyond it are an error, never cut."""
        out = sql(self.spark, text, events=events_view(snapshot(self.log.episodes(), as_of)))
        if most_rows is not None and out.limit(most_rows + 1).count() > most_rows:
            raise TooLarge(f"more than {most_rows} rows")
        return out

    def recall(self, text: str, k: int, scorer: Column | None = None) -> DataFrame:
        """lsn, id, content and score of the best k by ranked text and activation, fused and then scored."""
        e = self.log.episodes()
        head, now = e.agg(F.coalesce(F.max("lsn") + 1, F.lit(0)), F.coalesce(F.max(F.shiftright("ts_hlc", 16)), F.lit(0))).first()
        return engine_recall(e, text, k, head, float(now), scorer)

    def nearest(self, vector, k: int) -> DataFrame:
        """The k episodes whose hyperbolic part is nearest to vector, which is pulled into the ball; no tombstones."""
        return nearest_hyperbolic(self.log.episodes(), vector, k)

    # appends

    def append(self, batch: DataFrame) -> tuple[int, int]:
        return self.log.append(batch)

    def one(self, kind: str, attrs: dict[str, str], agent: str = "system", content: str | None = None) -> int:
        rows = self.spark.createDataFrame([(kind, agent, content, attrs)], "kind string, agent_id string, content string, attrs map<string,string>")
        return self.log.append(rows)[0]

    def telemetry(self, values: dict[str, float]) -> int:
        """A SystemMetric row per value; the first one's sequence number."""
        rows = self.spark.createDataFrame([("SystemMetric", "system", {"metric": k, "value": repr(float(v))}) for k, v in sorted(values.items())], "kind string, agent_id string, attrs map<string,string>")
        return self.log.append(rows)[0]

    def audit(self, operation: str, principal: str, ok: bool, what: str) -> int:
        return self.one("Observation", {"audit": what, "operation": operation, "principal": principal, "ok": str(ok).lower()}, "audit")

    def feedback(self, agent: str, rule: str, score: float, confirmed: bool) -> int:
        return self.one("RetrievalFeedback", {"feedback_rule": rule, "score": repr(float(score)), "verdict": "confirm" if confirmed else "reject"}, agent)

    # exports and upkeep

    def mirror(self, path: str, first: int = 0, to: int | None = None) -> None:
        """The twelve columns as Parquet, ordered by sequence number within each file."""
        mirror(self.log.scan(first, to)).sortWithinPartitions("lsn").write.parquet(path)

    def cold(self, path: str, rows: int | None = None) -> DataFrame:
        """A mirror that was written before; rows: how many it had, checked."""
        df = self.spark.read.parquet(path)
        if rows is not None and df.count() != rows:
            raise ValueError(f"{path} doesn't have {rows} rows")
        return df

    def compact_cold(self, path: str, out: str) -> bool:
        """Writes the mirror without what tombstones of the log name, if enough of it is dead."""
        left = cold_compaction(self.spark.read.parquet(path), deleted(self.log.episodes()))
        if left is not None:
            left.write.parquet(out)
        return left is not None

    def batches(self, as_of: int | None = None) -> DataFrame:
        """lsn, agent_id, kind, ts_hlc, content_len."""
        return snapshot(self.log.episodes(), as_of).select("lsn", "agent_id", "kind", "ts_hlc", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("content_len"))

    def ticket(self, text: str) -> DataFrame:
        """What a flight ticket asks for: events, or events?as_of=N."""
        name, _, rest = text.partition("?")
        if name != "events" or rest and not (rest.startswith("as_of=") and rest[6:].isdigit()):
            raise GqlError(f"no ticket {text}")
        return self.batches(int(rest[6:]) if rest else None)

    def stats(self) -> dict:
        e = self.log.episodes()
        n, first, last, agents = e.agg(F.count(F.lit(1)), F.min("ts_hlc"), F.max("ts_hlc"), F.approx_count_distinct("agent_id")).first()
        return {"episodes": n, "head": self.log.head(), "commits": len(self.log.commits()), "first_ms": None if first is None else first >> 16, "last_ms": None if last is None else last >> 16, "agents_about": agents}

    def commitment(self, as_of: int | None = None) -> DataFrame:
        """One row: the root over all episodes of the snapshot in order."""
        e = snapshot(self.log.episodes(), as_of)
        return merkle_root(e, F.col("lsn"), F.to_json(F.struct(*(F.col(c) for c in e.columns))))

    def replay_proof(self, fold: Callable[[DataFrame], DataFrame]) -> tuple[bool, int]:
        """Whether a derived table comes out the same when it is derived again, and its digest."""

        def digest() -> int:
            df = fold(self.log.episodes())
            return df.agg(F.coalesce(F.bit_xor(F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in df.columns))))), F.lit(0))).first()[0]

        a, b = digest(), digest()
        return a == b, a

    def diff(self, start: int, end: int, top: int = 20) -> DataFrame:
        return reports.diff(self.log.episodes(), start, end, top)


def nearest_hyperbolic(episodes: DataFrame, vector, k: int) -> DataFrame:
    """lsn, id, dist of the k nearest by the hyperbolic part alone; rows without one and rows that tombstones name are out."""
    from lodestream.functions import vectors

    n = sum(x * x for x in vector) ** 0.5
    q = [x * min(1.0, (1 - vectors.EDGE) / n) if n else x for x in vector]
    rows = episodes.where(F.size(F.col("embedding.hyp")) == len(q)).join(deleted(episodes), "id", "left_anti")
    return rows.select("lsn", "id", vectors.hyperbolic(F.col("embedding.hyp"), vectors.vector(q)).alias("dist")).orderBy("dist", "lsn").limit(k)


def engine_recall(episodes: DataFrame, text: str, k: int, head: int, now: float, scorer: Column | None = None, depth: int = 200) -> DataFrame:
    """Text (BM25) and activation channels, depth each, by rank fusion; then the linear scorer. An episode's accesses are
    its own time and those of the episodes that name it as a parent."""
    ranked = lambda df, score: df.select("id", (F.row_number().over(retrieval.Window.orderBy(F.desc(score), "id")) - 1).alias("rank"))  # noqa: E731  depth rows at most
    words = retrieval.bm25(episodes, text, depth).withColumnRenamed("key", "lsn").join(episodes.select("lsn", "id"), "lsn")
    t = F.shiftright("ts_hlc", 16)
    seen = episodes.select("id", t.alias("at")).unionByName(episodes.select(F.explode("parents").alias("id"), t.alias("at")))
    active = retrieval.activation(seen, now).withColumnRenamed("score", "activation").orderBy(F.desc("activation"), "id").limit(depth)
    features = words.select("id", F.col("score").alias("text_score")).join(active, "id", "full").join(episodes.select("id", "lsn", "content"), "id")
    features = features.withColumn("distance", F.lit(None).cast("double")).withColumn("head", F.lit(head))
    best = retrieval.retrieve([ranked(words, "score"), ranked(active, "activation")], features, k, depth, scorer)
    return best.join(episodes.select("id", "lsn", "content"), "id").select("lsn", "id", "content", F.col("final").alias("score")).orderBy(F.desc("score"), "id")


def to_ipc(df: DataFrame) -> bytes:
    """A result as one Arrow stream; for results that a caller can hold."""
    t = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def ipc_parts(df: DataFrame) -> DataFrame:
    """(part): a row per batch, each an Arrow stream of its own, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["part"])

    return df.mapInArrow(run, "part binary")


def from_arrow(spark: SparkSession, t: pa.Table) -> DataFrame:
    """A put: rows with agent_id and kind at least."""
    if missing := {"agent_id", "kind"} - set(t.schema.names):
        raise ValueError(f"no {', '.join(sorted(missing))}")
    return spark.createDataFrame(t)


#: Named operators that users add: name -> callable; the number is the major version that they were written for.
PLUGIN_API = 1
_PLUGINS: dict[str, Callable] = {}


def register(name: str, run: Callable, api: int = PLUGIN_API) -> None:
    if api != PLUGIN_API:
        raise ValueError(f"{name} is for version {api}, this is {PLUGIN_API}")
    _PLUGINS[name] = run


def plugin(name: str) -> Callable:
    return _PLUGINS[name]


def sandboxed(run: Callable, *args, **how):
    """(result, None), or (None, what went wrong)."""
    try:
        return run(*args, **how), None
    except Exception as e:  # noqa: BLE001  whatever a plugin does
        return None, f"{type(e).__name__}: {e}"

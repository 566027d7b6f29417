"""The store, the facade over it, exports, sealing, streams and the SQL guard."""

import pyarrow as pa
import pytest
from logs import edge, episodes
from pyspark.sql import functions as F

from lodestream import engine
from lodestream.functions import crypto, sketches
from lodestream.plans.sql import guard, sql
from lodestream.sources.log import Conflict, Log, cold_compaction, deleted
from lodestream.streaming import tail

BATCH = "id string, agent_id string, kind string, content string, attrs map<string,string>"


def batch(spark, *ids, **attrs):
    return spark.createDataFrame([(i, "alice", "Message", f"text {i}", attrs) for i in ids], BATCH)


@pytest.fixture
def db(spark, tmp_path):
    return engine.Engine(spark, str(tmp_path / "log"))


def test_appends_are_gapless_and_ordered(spark, db):
    assert db.log.head() == 0 and db.log.episodes().count() == 0
    assert db.append(batch(spark, "a", "b", "c")) == (0, 3)
    assert db.append(spark.range(100).select(F.concat(F.lit("x"), "id").alias("id")).repartition(4)) == (3, 100)
    assert db.append(batch(spark)) == (103, 0)
    rows = db.log.episodes().orderBy("lsn").collect()
    assert [r.lsn for r in rows] == list(range(103))
    assert all(a.ts_hlc < b.ts_hlc for a, b in zip(rows, rows[1:]))
    assert [r.id for r in rows[:3]] == ["a", "b", "c"]
    assert rows[50].kind == "Observation" and rows[50].attrs == {}
    assert db.log.read(1).first().content == "text b"
    assert [r.lsn for r in db.log.scan(2, 90, 4).collect()] == [2, 3, 4, 5]
    assert db.log.episodes(3).count() == 3


def test_conflicts(spark, db, tmp_path):
    db.append(batch(spark, "a"))
    with pytest.raises(Conflict):
        db.log.append(batch(spark, "b"), expected=0)
    assert db.log.append(batch(spark, "b"), expected=1) == (1, 1)
    late = Log(spark, str(tmp_path / "log"))
    seen = late.commits()
    db.append(batch(spark, "c"))
    late.commits = lambda: seen
    with pytest.raises(Conflict):
        late.append(batch(spark, "d"))
    assert [r.id for r in db.log.episodes().orderBy("lsn").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        db.append(batch(spark, "e", __mine="x"))


def test_idempotent_appends(spark, db):
    keyed = lambda *rows: spark.createDataFrame(rows, "key string, content string, attrs map<string,string>")
    got = {r.key: (r.lsn, r.duplicate) for r in db.log.append_idempotent(keyed(("k1", "x", {"a": "1"}), ("k1", "x", {"a": "1"}), ("k2", "y", {}))).collect()}
    assert sorted(got) == ["k1", "k2"] and {d for _, d in got.values()} == {False}
    again = {r.key: (r.lsn, r.duplicate) for r in db.log.append_idempotent(keyed(("k1", "x", {"a": "1"}), ("k3", "z", {}))).collect()}
    assert again["k1"] == (got["k1"][0], True) and again["k3"][1] is False
    assert db.log.head() == 3
    with pytest.raises(Conflict):
        db.log.append_idempotent(keyed(("k1", "other", {"a": "1"})))
    assert db.log.head() == 3


def test_compaction_changes_nothing(spark, db):
    for i in range(3):
        db.append(batch(spark, f"a{i}", f"b{i}"))
    before = db.log.episodes().orderBy("lsn").collect()
    db.log.compact(rows_per_file=4)
    assert len(db.log.commits()) == 1
    assert db.log.episodes().orderBy("lsn").collect() == before
    assert db.append(batch(spark, "z")) == (6, 1)
    assert db.log.episodes().count() == 7


def test_statements_that_write(spark, db):
    db.append(spark.createDataFrame([({"edge_from": "p", "edge_to": "q", "edge_type": "fraud_partner", "confidence": "0.9"},)], "attrs map<string,string>"))
    assert db.query('CREATE (n:message {a: "x"})').first().lsn == 1
    got = db.query("DECIDE()").collect()
    assert [r.action_id for r in got] == ["flag_fraud:p->q#fraud_partner"]
    assert db.query("DECIDE()").count() == 0
    assert db.log.head() == 3
    with pytest.raises(engine.Forbidden):
        db.query("DECIDE()", may_write=False)
    assert db.query("EXPLAIN DECIDE()", may_write=False).count() == 1


def test_upkeep_rows(spark, tmp_path):
    db = engine.Engine(spark, str(tmp_path / "log"), audit=True)
    db.telemetry({"rss": 5, "cpu": 0.5})
    db.feedback("alice", "flag_anomaly", 2.0, True)
    db.query("MATCH (n) RETURN n")
    kinds = [r.kind for r in db.log.episodes().orderBy("lsn").collect()]
    assert kinds == ["SystemMetric", "SystemMetric", "RetrievalFeedback", "Observation"]
    assert db.query("ADAPT()").first().samples == 1
    assert db.stats()["episodes"] == 5
    assert db.replay_proof(lambda e: e.select("id", "kind"))[0]
    a, b = db.commitment(3).first().root, db.commitment(4).first().root
    assert len(a) == 64 and a != b


def test_sql_over_the_log(spark, db):
    db.append(batch(spark, "a", "b", "c"))
    assert db.sql("SELECT count(*) AS n FROM events").first().n == 3
    assert db.sql("SELECT count(*) AS n FROM events", as_of=2).first().n == 2
    assert [r.valid_from for r in db.sql("SELECT valid_from FROM events").collect()] == [0, 0, 0]
    with pytest.raises(engine.TooLarge):
        db.sql("SELECT * FROM events", most_rows=2)


@pytest.mark.parametrize("text", ["CREATE EXTERNAL TABLE t STORED AS CSV LOCATION 'x'", "CREATE TABLE t AS SELECT 1", "INSERT INTO events VALUES (1)", "SET a = b", "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "COPY events TO 'x'"])
def test_sql_that_is_refused(text):
    with pytest.raises(ValueError):
        guard(text)


def test_sql_with_odd_texts(spark):
    t = spark.createDataFrame([("events, x {y}", 1)], "a string, b int")
    assert sql(spark, "SELECT a FROM events WHERE a = 'events, x {y}' -- from events", events=t).count() == 1
    assert sql(spark, "EXPLAIN SELECT 1").count() == 1


def test_mirror_and_cold(spark, db, tmp_path):
    db.append(batch(spark, *(f"i{k}" for k in range(10))))
    db.mirror(f"{tmp_path}/m")
    m = db.cold(f"{tmp_path}/m", 10)
    assert m.columns == "lsn id agent_id session_id ts_hlc kind content attrs_json parents_json valid_from valid_to embedding_json".split()
    with pytest.raises(ValueError):
        db.cold(f"{tmp_path}/m", 11)
    dead = deleted(episodes(spark, [{"attrs": {"tombstone_of": f"i{k}"}} for k in range(4)]))
    assert cold_compaction(m, dead) is None
    assert cold_compaction(m, dead, least=5).count() == 6
    assert cold_compaction(m, dead, ratio=0.5, least=5) is None
    assert db.compact_cold(f"{tmp_path}/m", f"{tmp_path}/n") is False


def test_arrow(spark, db):
    db.append(batch(spark, "a", "b"))
    t = engine.from_ipc(engine.to_ipc(db.ticket("events?as_of=1")))
    assert t.num_rows == 1 and t.schema.names == ["lsn", "agent_id", "kind", "ts_hlc", "content_len"]
    assert sum(engine.from_ipc(r.part).num_rows for r in engine.ipc_parts(db.batches()).collect()) == 2
    put = engine.from_arrow(spark, pa.table({"agent_id": ["x"], "kind": ["Message"]}))
    assert db.append(put) == (2, 1)
    with pytest.raises(ValueError):
        engine.from_arrow(spark, pa.table({"agent_id": ["x"]}))
    with pytest.raises(ValueError):
        db.ticket("events?as_of=x")


def test_recall_and_nearest(spark, tmp_path):
    rows = [{"id": "a", "content": "river bank", "embedding": ([0.1], [], [])}, {"id": "b", "content": "fire", "embedding": ([0.8], [], []), "parents": ["a"]}, {"id": "c", "attrs": {"tombstone_of": "b"}}]
    db = engine.Engine(spark, str(tmp_path / "log"))
    db.append(episodes(spark, rows))
    assert db.recall("river", 3).first().id == "a"
    assert [r.id for r in db.nearest([2.0], 5).collect()] == ["a"]
    assert db.recall("river", 0).count() == 0


def test_sealed_contents(spark, tmp_path):
    e = episodes(spark, [{"agent_id": "a", "content": "one"}, {"agent_id": "b", "content": "two"}, {"agent_id": "a", "content": None}])
    crypto.new_keys(e).write.parquet(f"{tmp_path}/k")
    keys = spark.read.parquet(f"{tmp_path}/k")
    shut = crypto.seal(e, keys)
    shut.write.parquet(f"{tmp_path}/s")
    shut = spark.read.parquet(f"{tmp_path}/s")
    assert "one" not in [r.content for r in shut.collect()]
    assert [r.content for r in crypto.unseal(shut, keys).orderBy("lsn").collect()] == ["one", "two", None]
    assert [r.content for r in crypto.unseal(shut, crypto.shred(keys, "a")).orderBy("lsn").collect()] == [None, "two", None]


def test_sketches(spark):
    rows = spark.range(10_000).select((F.col("id") % 100).alias("k"))
    est = {r.k: r.estimate for r in sketches.count_min(rows, "k", 0.01, 0.99, [1, 5, 1000]).collect()}
    assert est[1] >= 100 and est[5] >= 100 and est[1000] <= 400
    import numpy as np

    h = sketches.HyperLogLog(12)
    x = np.arange(50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    h.add(x * np.uint64(0xBF58476D1CE4E5B9))
    assert abs(h.estimate() - 50_000) < 2500
    assert sketches.run_length("aabbb") == [("a", 2), ("b", 3)]
    with pytest.raises(TypeError):
        sketches.expression(("add", ("const", 1), ("const", 2.0)), {})


def test_streams_follow_in_order(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(10 * i + k, "a" if k % 2 else "b", "x") for k in range(10)], "event_id bigint, key string, value string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    seen, calls = [], []
    view = tail.View(spark, str(tmp_path / "view"), lambda before, b: (b.groupBy("key").count() if before is None else before.union(b.groupBy("key").count()).groupBy("key").agg(F.sum("count").alias("count"))))
    sinks = [lambda b, n: calls.append(("first", n)), lambda b, n: (calls.append(("second", n)), seen.extend(r.event_id for r in b.collect())), view.apply]
    tail.follow(tail.subscribe(spark, src, schema, 5), sinks, str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == list(range(5, 30))
    assert calls == [(w, n) for n in range(3) for w in ("first", "second")]
    assert {r.key: r["count"] for r in view.at(2).collect()} == {"a": 13, "b": 12}
    seen.clear()
    tail.follow(tail.subscribe(spark, src, schema, 5), sinks, str(tmp_path / "c")).awaitTermination()
    assert seen == []


def test_plugins():
    engine.register("double", lambda x: 2 * x)
    assert engine.sandboxed(engine.plugin("double"), 4) == (8, None)
    assert engine.sandboxed(lambda: 1 // 0)[1].startswith("ZeroDivisionError")
    with pytest.raises(ValueError):
        engine.register("old", print, api=0)


def test_edges_of_parents_and_types(spark):
    from lodestream.operators import graph

    ops = graph.edge_ops(episodes(spark, [{"id": "a"}, {"id": "b", "parents": ["a"]}, edge("x", "y", "NotRelated"), edge("x", "y", "Zed", stance="against")])).collect()
    assert {(r.edge_id, r.polarity) for r in ops} == {("a->b#custom:provenance", 1), ("x->y#not_related", -1), ("x->y#custom:zed", -1)}


def test_an_idempotent_append_sees_another_writer(spark, tmp_path, monkeypatch):
    """One that appends the same key between the look for keys and the append: the key is there once."""
    from pyspark.sql import functions as F

    path, kept = f"{tmp_path}/log", Log.keys
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, content string")
    raced = []

    def keys(self, to=None):
        found = kept(self, to)
        if not raced:
            raced.append(True)
            Log(spark, path).append_idempotent(rows.where("key = 'a'"))
        return found

    monkeypatch.setattr(Log, "keys", keys)
    got = {r.key: (r.lsn, r.duplicate) for r in Log(spark, path).append_idempotent(rows).collect()}
    assert got == {"a": (0, True), "b": (1, False)}
    assert sorted(r.k for r in Log(spark, path).keys().select(F.col("k")).collect()) == ["a", "b"]


def test_sql_reads_literals_before_comments():
    from lodestream.plans.sql import guard

    assert guard("SELECT '--x' AS a, 1 AS b FROM events -- end") == "SELECT '--x' AS a, 1 AS b FROM events"
    assert guard("SELECT '/*' AS a /* it's */ , '*/' AS b") == "SELECT '/*' AS a   , '*/' AS b"
    assert guard("SELECT 'reflect(' AS a") == "SELECT 'reflect(' AS a"
    for bad in ("SELECT java_method('java.lang.System', 'exit', 1)", "SELECT `reflect` ('a', 'b')", "SELECT try_reflect('a')", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            guard(bad)


def test_conditions_on_ends_reach_below_the_windows(spark):
    from lodestream.operators import graph

    ops = spark.createDataFrame([(i, "t", 1.0, "s", f"n{i % 5}", f"n{i % 7}", "a", None, 1, None, None) for i in range(40)], "lsn bigint, etype string, confidence double, source string, src string, dst string, op string, hypothesis string, polarity int, world_from bigint, world_to bigint").selectExpr("*", "concat(src, '->', dst, '#', etype) AS edge_id")
    plan = graph.match_edges(graph.edge_intervals(ops), graph.edge_versions(ops), src="n1")._jdf.queryExecution().optimizedPlan().toString()
    for side in plan.split("Join LeftOuter")[1].split("Aggregate")[:1] + plan.split("Aggregate")[-1:]:
        assert "= n1" in side.split("Window")[-1]

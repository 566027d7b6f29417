"""Queries of the event-log operators over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import vectors
from lodestream.operators import causal, entity, graph, reports, retrieval
from lodestream.plans.gql import Session
from lodestream.sources.episodes import events_view, from_events, load, snapshot, touches, valid_at

# What the SQL side knows of the episodes and their edges.
_EP = """ep AS (
  SELECT event_id AS lsn, 'e' || event_id AS id, 'u' || user_id AS agent_id, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_type AS kind, props AS content,
    (epoch_us(ts) // 1000) AS ms, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY event_id) AS until,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events)"""
_OPS = """ops AS (
  SELECT lsn, agent_id AS src, 'k' || k AS dst, agent_id || '->k' || k || '#custom:touch' AS edge_id, CASE WHEN kind = 'error' THEN 'r' ELSE 'a' END AS op, kind AS hypothesis,
    CASE WHEN kind = 'view' THEN -1 ELSE 1 END AS polarity, round(greatest(1e-4::DOUBLE, least((1 - 1e-4)::DOUBLE, value / 500)), 6) AS confidence FROM ep),
iv AS (SELECT edge_id, src, dst, lsn AS opened, lead(lsn) OVER (PARTITION BY edge_id ORDER BY lsn) AS closed, op FROM (
    SELECT *, lag(op) OVER (PARTITION BY edge_id ORDER BY lsn) AS p FROM ops) WHERE op IS DISTINCT FROM p AND NOT (op = 'r' AND p IS NULL)),
intervals AS (SELECT edge_id, src, dst, opened, closed FROM iv WHERE op = 'a'),
versions AS (SELECT edge_id, hypothesis, arg_min(confidence, lsn) AS confidence, arg_min(polarity, lsn) AS polarity, min(lsn) AS since FROM ops WHERE op = 'a' GROUP BY edge_id, hypothesis),
belief AS (SELECT edge_id, 1 / (1 + exp(-sum(polarity * ln(greatest(1e-4::DOUBLE, least((1 - 1e-4)::DOUBLE, confidence)) / (1 - greatest(1e-4::DOUBLE, least((1 - 1e-4)::DOUBLE, confidence))))))) AS belief FROM versions GROUP BY edge_id)"""
_W = f"WITH {_EP} "
_G = f"WITH {_EP}, {_OPS} "
_QUERY = [0.1, -0.05, 0.2, 0.0] * 16
_Q = "[" + ",".join(map(str, _QUERY)) + "]"
_DIST = f"sqrt(list_sum(list_transform(range(1, 65), lambda i: ((embedding[i])::DOUBLE - ({_Q})[i]::DOUBLE) ** 2)))"
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= %d)"
_WORDS = "the und"


def _rounded(c: str, n: int = 4) -> F.Column:
    return F.round(c, n).alias(c)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("lsn"), "label", "embedding")
    part = lambda a, n: F.slice("embedding", a, n).cast("array<double>")
    return e.withColumn("p", F.struct(part(1, 32).alias("hyp"), part(33, 16).alias("sph"), part(49, 16).alias("euc")))


def _open(spark, d, src=None):
    ops = graph.edge_ops(touches(spark, d))
    return graph.match_edges(graph.edge_intervals(ops), graph.edge_versions(ops), src)


def _gql(text: str, source=from_events):
    return lambda s, d: Session(source(s, d)).run(text)


def p01(s: SparkSession, d: str) -> DataFrame:
    return Session(from_events(s, d)).run("MATCH (n:purchase) WHERE n.value > 50 AS OF LSN 5000 RETURN n.lsn, n.agent_id ORDER BY n.value DESC LIMIT 20").select(F.col("`n.lsn`").alias("lsn"), F.col("`n.agent_id`").alias("agent_id"))


def _first_columns(text: str, *names: str, source=from_events):
    """A GQL query whose columns are renamed."""

    def run(s, d):
        df = Session(source(s, d)).run(text)
        return df.toDF(*names)

    return run


def _idempotent(s, d):
    """Of appends under one key (user and type) the first counts; a later one with another payload is a conflict."""
    e = load(s, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.withColumn("first", F.first("event_id").over(w)).withColumn("was", F.first("props").over(w)).groupBy("user_id", "event_type", F.col("first").alias("lsn")).agg(F.sum((F.col("props") != F.col("was")).cast("bigint")).alias("conflicts"))


def _asof(s, d):
    """Each purchase with the last view of the same user before it: one window over the union, no range join."""
    e = load(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "view_id")


def _hyp(s, d):
    v = _vectors(s, d)
    q = vectors.vector(_QUERY[:32])
    return v.withColumn("dist", vectors.hyperbolic(F.col("p.hyp"), q)).orderBy("dist", "lsn").limit(10).select("lsn", _rounded("dist"))


def _centroid(s, d):
    v = _vectors(s, d).select("label", F.posexplode("embedding").alias("i", "x"))
    return v.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


def _docs(s, d):
    return load(s, d, "documents").select(F.col("doc_id").alias("lsn"), F.col("text").alias("content"), "source")


def _rrf(s, d):
    docs = _docs(s, d)
    lists = []
    for q in ("the", "and"):
        top = retrieval.substring_search(docs, q, 50)
        lists.append(top.select(F.col("key").alias("id"), (F.row_number().over(Window.orderBy(F.desc("score"), F.desc("key"))) - 1).alias("rank")))
    return retrieval.rrf(lists).select("id", F.round("score", 8).alias("score"))


def _activation(s, d):
    e = load(s, d, "events")
    return retrieval.activation(e.select(F.concat(F.lit("u"), "user_id").alias("id"), F.col("event_id").alias("at")), 2_000_000.0).orderBy(F.desc("score"), "id").limit(20).select("id", _rounded("score"))


def _mrr(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("example"), (F.col("event_id") == F.min("event_id").over(Window.partitionBy("user_id"))).alias("relevant"), F.floor("value").alias("c"))
    return retrieval.mrr(e, "c").select(F.round("mrr", 6).alias("mrr"))


def _f1(s, d):
    fb = load(s, d, "events").select(F.floor(F.col("value") / 10).alias("score"), (F.col("event_type") == "purchase").alias("good"))
    return reports.threshold_scores(fb).select("score", _rounded("precision", 6), _rounded("recall", 6), _rounded("f1", 6))


def _adapt(s, d):
    e = from_events(s, d)
    fb = F.create_map(F.lit("feedback_rule"), F.lit("flag_anomaly"), F.lit("score"), F.floor(F.col("attrs")["value"].cast("double") / 10).cast("string"), F.lit("verdict"), F.when(F.col("kind") == "purchase", "confirm").otherwise("reject"))
    return reports.adapt(e.withColumn("attrs", fb)).select("samples", "threshold", _rounded("f1", 6))


def _ledger(s, d):
    e = load(s, d, "events")
    return reports.ledger(e.select(F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").alias("key"), F.col("event_type").alias("value")))


def _why(s, d):
    return causal.why(from_events(s, d), "e390").select("depth", "id", "is_root")


def _simulate(s, d):
    return Session(touches(s, d)).run('SIMULATE ADD EDGE ("u1", "touch", "nowhere") THEN NEIGHBORS("u1")').select("node", "etype")


def _intervals(s, d):
    return graph.edge_intervals(graph.edge_ops(touches(s, d))).select("edge_id", "opened", "closed")


def _beliefs(s, d):
    return graph.beliefs(graph.edge_versions(graph.edge_ops(touches(s, d)))).select("edge_id", _rounded("belief"))


def _entity(s, d):
    e = load(s, d, "customer")
    ep = e.select(F.col("c_custkey").alias("lsn"), F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("er_op"), F.lit("merge"), F.lit("er_a"), F.concat(F.lit("n"), "c_nationkey"), F.lit("er_b"), F.concat(F.lit("n"), F.pmod(F.col("c_nationkey") + 5, F.lit(25))))).otherwise(F.create_map(F.lit("entity_key"), F.concat(F.lit("n"), "c_nationkey"))).alias("attrs"))
    return entity.entity_intervals(ep).where("to_lsn IS NULL").select("key", "entity_id")


def _hll(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 12)).alias("parts"))


def _cms(s, d):
    from lodestream.functions.sketches import count_min

    return count_min(load(s, d, "events"), "user_id", eps=0.001, confidence=0.99, keys=[1, 2, 3, 4, 5])


def _leiden(s, d):
    return graph.communities(_open(s, d))


def _stream(s, d):
    from lodestream.streaming.tail import counts_by_kind

    return counts_by_kind(s, d)


def _merkle(s, d):
    from lodestream.functions.sketches import merkle_root

    e = load(s, d, "events")
    return merkle_root(e, F.col("event_id"), F.concat_ws("|", "event_id", "user_id", "event_type", "props"))



#: name -> (query, SQL or None)
EVENTLOG: dict[str, tuple] = {
    "p01_scan_filter": (p01, f"{_W}SELECT lsn, agent_id FROM ep WHERE kind = 'purchase' AND value > 50 AND lsn < 5000 ORDER BY value DESC, lsn LIMIT 20"),
    "p02_label": (_first_columns("MATCH (n:PURCHASE) RETURN n.lsn", "lsn"), f"{_W}SELECT lsn FROM ep WHERE kind = 'purchase'"),
    "p05_missing_operand": (_first_columns('MATCH (n) WHERE n.nothing != "x" RETURN n.lsn', "lsn"), f"{_W}SELECT lsn FROM ep WHERE false"),
    "p06_valid_at": (lambda s, d: valid_at(from_events(s, d), 1_705_000_000_000).select("lsn"), f"{_W}SELECT lsn FROM ep WHERE ms <= 1705000000000 AND (until IS NULL OR until > 1705000000000)"),
    "p09_project_all": (lambda s, d: Session(from_events(s, d)).run("MATCH (n) WHERE n.lsn < 50 RETURN *").select("lsn", "id", "agent_id", "session_id", "kind", "content"), f"{_W}SELECT lsn, id, agent_id, session_id, kind, content FROM ep WHERE lsn < 50"),
    "p10_project_edge": (_first_columns('MATCH (a)-[r:touch]->(b) RETURN a.id, r.type, b.id', "a", "t", "b", source=touches), f"{_G}SELECT src AS a, 'custom:touch' AS t, dst AS b FROM intervals WHERE closed IS NULL"),
    "p11_edge_filter": (_first_columns('MATCH (a)-[r]->(b) WHERE r.belief > 0.9 AND a.id != "u1" RETURN r.id', "edge_id", source=touches), f"{_G}SELECT edge_id FROM intervals JOIN belief USING (edge_id) WHERE closed IS NULL AND belief > 0.9 AND src <> 'u1'"),
    "p20_filtered_property": (lambda s, d: from_events(s, d).where((F.col("attrs")["k"] == "7") & (F.col("kind") == "click")).select("lsn"), f"{_W}SELECT lsn FROM ep WHERE k = 7 AND kind = 'click'"),
    "s04_as_of_lsn": (lambda s, d: snapshot(from_events(s, d), 250).select("lsn", "kind"), f"{_W}SELECT lsn, kind FROM ep WHERE lsn < 250"),
    "s04_as_of_ts": (lambda s, d: snapshot(from_events(s, d), timestamp_ms=1_705_000_000_000).select("lsn"), f"{_W}SELECT lsn FROM ep WHERE lsn < coalesce((SELECT min(lsn) FROM ep WHERE ms > 1705000000000), (SELECT max(lsn) + 1 FROM ep))"),
    "s07_attr_eq": (_first_columns('MATCH (n) WHERE n.k = "42" RETURN n.lsn, n.kind', "lsn", "kind"), f"{_W}SELECT lsn, kind FROM ep WHERE k = 42"),
    "s08_attr_range": (_first_columns("MATCH (n) WHERE n.k >= 10 AND n.k < 13 RETURN n.lsn", "lsn"), f"{_W}SELECT lsn FROM ep WHERE k >= 10 AND k < 13"),
    "s08_inverted_range": (_first_columns("MATCH (n) WHERE n.k > 100 AND n.k < 10 RETURN n.lsn", "lsn"), f"{_W}SELECT lsn FROM ep WHERE false"),
    "s09_builtin_eq": (_first_columns('MATCH (n) WHERE n.agent_id = "u5" RETURN n.lsn', "lsn"), f"{_W}SELECT lsn FROM ep WHERE agent_id = 'u5'"),
    "s12_merge_dedup": (lambda s, d: (lambda e: e.where("lsn < 600").unionByName(e.where("lsn >= 400")).withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lsn")))).where("rn = 1").select("lsn", "id"))(from_events(s, d)), f"{_W}SELECT lsn, id FROM ep"),
    "s14_events_view": (lambda s, d: events_view(from_events(s, d)).select("lsn", "kind", "valid_from", "valid_to"), f"{_W}SELECT lsn, kind, ms AS valid_from, coalesce(until, 0) AS valid_to FROM ep"),
    "s15_batches": (lambda s, d: from_events(s, d).select("lsn", "agent_id", "kind", F.octet_length("content").cast("bigint").alias("content_len")), f"{_W}SELECT lsn, agent_id, kind, strlen(content)::BIGINT AS content_len FROM ep"),
    "t01_order_numeric_first": (_first_columns("MATCH (n) RETURN n.lsn ORDER BY n.k ASC LIMIT 40", "lsn"), f"{_W}SELECT lsn FROM ep ORDER BY k, lsn LIMIT 40"),
    "k03_idempotent": (_idempotent, "SELECT user_id, event_type, lsn, CAST(sum(CASE WHEN props <> was THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM (SELECT *, first_value(event_id) OVER w AS lsn, first_value(props) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) GROUP BY user_id, event_type, lsn"),
    "k10_cold_compaction": (lambda s, d: (lambda e: e.select("lsn").join(e.where("kind = 'error'").select((F.col("lsn") - 1).alias("lsn")), "lsn", "left_anti"))(from_events(s, d)), f"{_W}SELECT lsn FROM ep WHERE lsn NOT IN (SELECT lsn - 1 FROM ep WHERE kind = 'error')"),
    "j_asof": (_asof, "SELECT event_id, view_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events) WHERE event_type = 'purchase'"),
    "j04_children": (lambda s, d: from_events(s, d).select(F.explode("parents").alias("parent"), F.col("id").alias("child")), f"{_W}SELECT 'e' || parent AS parent, id AS child FROM ep WHERE parent IS NOT NULL"),
    "j02_graph_match": (lambda s, d: _open(s, d, "u3").select("edge_id", _rounded("belief")), f"{_G}SELECT edge_id, round(belief, 4) AS belief FROM intervals JOIN belief USING (edge_id) WHERE closed IS NULL AND src = 'u3'"),
    "j03_neighbors": (lambda s, d: Session(touches(s, d)).run('NEIGHBORS("u7", "touch") AS OF LSN 6000').select("node", _rounded("belief")), f"{_EP and 'WITH '}{_EP.replace('FROM events)', 'FROM events WHERE event_id < 6000)')}, {_OPS} SELECT dst AS node, round(belief, 4) AS belief FROM intervals JOIN belief USING (edge_id) WHERE closed IS NULL AND src = 'u7'"),
    "g_edge_intervals": (_intervals, f"{_G}SELECT edge_id, opened, closed FROM intervals"),
    "a06_metrics": (lambda s, d: graph.metrics(_open(s, d)).select("node", "degree", _rounded("centrality", 6), _rounded("z_score", 4)), f"{_G}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM intervals WHERE closed IS NULL UNION ALL SELECT dst FROM intervals WHERE closed IS NULL) GROUP BY node) SELECT node, degree, round(degree / ((SELECT count(*) FROM deg) - 1), 6) AS centrality, round((degree - (SELECT avg(degree) FROM deg)) / (SELECT stddev_pop(degree) FROM deg), 4) AS z_score FROM deg"),
    "a08_belief": (_beliefs, f"{_G}SELECT edge_id, round(belief, 4) AS belief FROM belief"),
    "a09_hypotheses": (lambda s, d: graph.edge_versions(graph.edge_ops(touches(s, d))).where("edge_id LIKE 'u2->%'").select("edge_id", "hypothesis", _rounded("confidence", 6), "polarity", "since"), f"{_G}SELECT edge_id, hypothesis, round(confidence, 6) AS confidence, polarity, since FROM versions WHERE edge_id LIKE 'u2->%'"),
    "g01_traverse": (lambda s, d: graph.bfs(from_events(s, d).select(F.explode("parents").alias("src"), F.col("id").alias("dst")), "e10", 5), f"{_W.replace('WITH', 'WITH RECURSIVE')}, r(node, depth) AS (SELECT 'e10', 0 UNION ALL SELECT ep.id, depth + 1 FROM r JOIN ep ON r.node = 'e' || ep.parent WHERE depth < 5) SELECT node, depth FROM r WHERE depth > 0"),
    "g02_community": (lambda s, d: graph.components(load(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.col("n_name").alias("dst"))), "SELECT n_name AS node, min(least(n_name, 'r' || n_regionkey)) OVER (PARTITION BY n_regionkey) AS community FROM nation UNION SELECT 'r' || n_regionkey, min(least(n_name, 'r' || n_regionkey)) OVER (PARTITION BY n_regionkey) FROM nation"),
    "g03_leiden": (_leiden, None),
    "g05_provenance": (lambda s, d: Session(from_events(s, d)).run('PROVENANCE("e900")'), f"{_W}SELECT 'e' || parent AS parent FROM ep WHERE id = 'e900' AND parent IS NOT NULL"),
    "g07_why": (_why, f"{_W.replace('WITH', 'WITH RECURSIVE')}, r(id, depth) AS (SELECT 'e390', 0 UNION ALL SELECT 'e' || ep.parent, depth + 1 FROM r JOIN ep ON ep.id = r.id WHERE ep.parent IS NOT NULL AND depth < 64) SELECT depth, id, (SELECT parent IS NULL FROM ep WHERE ep.id = r.id) AS is_root FROM r"),
    "g09_resolve": (_entity, None),
    "g11_decide": (lambda s, d: reports.decide(graph.metrics(_open(s, d)), _open(s, d)).select("rule", "subject", _rounded("score"), "action_id"), f"{_G}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM intervals WHERE closed IS NULL UNION ALL SELECT dst FROM intervals WHERE closed IS NULL) GROUP BY node), z AS (SELECT node, (degree - (SELECT avg(degree) FROM deg)) / (SELECT stddev_pop(degree) FROM deg) AS z FROM deg) SELECT 'flag_anomaly' AS rule, node AS subject, round(z, 4) AS score, 'flag_anomaly:' || node AS action_id FROM z WHERE z >= 1.5"),
    "g13_simulate": (_simulate, f"{_G}SELECT dst AS node, 'custom:touch' AS etype FROM intervals WHERE closed IS NULL AND src = 'u1' UNION ALL SELECT 'nowhere', 'custom:touch'"),
    "g16_dense_map": (lambda s, d: load(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.row_number().over(Window.orderBy("c_custkey")) - 1).cast("bigint").alias("dense")), "SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS dense FROM customer"),
    "a11_mrr": (_mrr, "WITH e AS (SELECT user_id, event_id = min(event_id) OVER (PARTITION BY user_id) AS rel, floor(value) AS c FROM events), r AS (SELECT user_id, c FROM e WHERE rel) SELECT round(avg(1 / (higher + (equal + 1) / 2)), 6) AS mrr FROM (SELECT e.user_id, sum(CASE WHEN e.c > r.c THEN 1 ELSE 0 END) AS higher, sum(CASE WHEN e.c = r.c THEN 1 ELSE 0 END) AS equal FROM e JOIN r USING (user_id) GROUP BY e.user_id)"),
    "a13_f1": (_f1, "WITH b AS (SELECT floor(value / 10)::BIGINT AS score, sum((event_type = 'purchase')::INTEGER) AS tp, count(*) AS n FROM events GROUP BY 1), c AS (SELECT score, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS a FROM b), d AS (SELECT score, tp / n AS p, tp / a AS r FROM c) SELECT score, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM d"),
    "a14_adapt": (_adapt, "WITH b AS (SELECT floor(value / 10)::DOUBLE AS score, sum((event_type = 'purchase')::INTEGER) AS tp, count(*) AS n FROM events GROUP BY 1), c AS (SELECT score, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS a FROM b), d AS (SELECT score, coalesce(2 * (tp / n) * (tp / a) / nullif(tp / n + tp / a, 0), 0) AS f1 FROM c) SELECT (SELECT count(*) FROM events) AS samples, score AS threshold, round(f1, 6) AS f1 FROM d ORDER BY round(f1, 9) DESC, score LIMIT 1"),
    "a15_activation": (_activation, "WITH r AS (SELECT 'u' || user_id AS id, greatest(2000000.0::DOUBLE - event_id, 1) AS age, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), g AS (SELECT id, sum(CASE WHEN n <= 8 THEN age ** -0.5 END) AS recent, count(*) AS n, max(age) AS t1, max(CASE WHEN n <= 8 THEN age END) AS tk FROM r GROUP BY id) SELECT id, round(ln(recent + CASE WHEN n > 8 THEN (n - 8) * (sqrt(t1) - sqrt(tk)) / (0.5 * (t1 - tk)) ELSE 0 END), 4) AS score FROM g ORDER BY ln(recent + CASE WHEN n > 8 THEN (n - 8) * (sqrt(t1) - sqrt(tk)) / (0.5 * (t1 - tk)) ELSE 0 END) DESC, id LIMIT 20"),
    "a17_field_values": (lambda s, d: reports.field_values(from_events(s, d), "k"), f"{_W}SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM ep GROUP BY k"),
    "a18_field_span": (lambda s, d: reports.field_span(from_events(s, d), "k", "12"), f"{_W}SELECT min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM ep WHERE k = 12"),
    "a19_fields": (lambda s, d: reports.fields(from_events(s, d)), f"{_W}SELECT 'value' AS field, count(DISTINCT value) AS n_values FROM ep UNION ALL SELECT 'k', count(DISTINCT k) FROM ep"),
    "a20_diff": (lambda s, d: reports.diff(from_events(s, d).withColumn("attrs", F.map_filter("attrs", lambda k, v: k == "k")), 600, 700, 10).select("value", "n_now", "n_before", "state", "rank"), f"{_W}, g AS (SELECT CAST(k AS VARCHAR) AS value, CAST(sum(CASE WHEN lsn >= 600 THEN 1 ELSE 0 END) AS BIGINT) AS n_now, CAST(sum(CASE WHEN lsn < 600 THEN 1 ELSE 0 END) AS BIGINT) AS n_before FROM ep WHERE lsn >= 500 AND lsn < 700 GROUP BY k) SELECT * FROM (SELECT value, n_now, n_before, CASE WHEN n_before = 0 THEN 'new' WHEN n_now = 0 THEN 'silent' ELSE 'active' END AS state, row_number() OVER (ORDER BY n_before = 0 DESC, n_now = 0 DESC, greatest(n_now, n_before) DESC, value) AS rank FROM g) WHERE rank <= 10"),
    "a21_sources": (lambda s, d: reports.sources(from_events(s, d)), f"{_W}SELECT agent_id, count(*) AS events, min(lsn) AS first_lsn, max(lsn) AS last_lsn, min(ms) AS first_ms, max(ms) AS last_ms FROM ep GROUP BY agent_id"),
    "a22_source_detail": (lambda s, d: reports.source_detail(from_events(s, d), "u4").withColumn("mean_bytes", F.round("mean_bytes", 6)), f"{_W}SELECT kind, count(*) AS events, count(DISTINCT session_id) AS sessions, round(avg(strlen(content)), 6) AS mean_bytes FROM ep WHERE agent_id = 'u4' GROUP BY kind"),
    "a23_footprint": (lambda s, d: reports.footprint(from_events(s, d), "u9"), f"{_W}SELECT kind, count(*) AS events, min(ms) AS first_ms, max(ms) AS last_ms FROM ep WHERE agent_id = 'u9' GROUP BY kind"),
    "a27_zone_map": (lambda s, d: reports.zone_map(from_events(s, d), 1000).select("segment", "min_lsn", "max_lsn", "min_agent", "max_agent"), f"{_W}SELECT CAST(floor(lsn / 1000) AS BIGINT) AS segment, min(lsn) AS min_lsn, max(lsn) AS max_lsn, min(agent_id) AS min_agent, max(agent_id) AS max_agent FROM ep GROUP BY 1"),
    "a28_ledger": (_ledger, "SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"),
    "a29_merkle_root": (_merkle, None),
    "st01_stream_counts": (_stream, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "a03_hll": (_hll, None),
    "a04_cms": (_cms, None),
    "v01_dist_euc": (lambda s, d: _vectors(s, d).select("lsn", F.round(vectors.euclidean(F.col("embedding"), vectors.vector(_QUERY)), 4).alias("dist")), f"SELECT vec_id AS lsn, round({_DIST}, 4) AS dist FROM embeddings"),
    "v02_dist_sph": (lambda s, d: _vectors(s, d).select("lsn", F.round(vectors.spherical(F.col("p.sph"), vectors.vector(_QUERY[32:48])), 4).alias("dist")), f"SELECT vec_id AS lsn, round(acos(greatest(-1, least(1, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))))), 4) AS dist FROM (SELECT vec_id, embedding[33:48]::DOUBLE[] AS e, ({_Q})[33:48]::DOUBLE[] AS q FROM embeddings)"),
    "v03_dist_hyp": (_hyp, f"SELECT vec_id AS lsn, round(acosh(1 + 2 * d / ((1 - list_dot_product(e, e)) * (1 - list_dot_product(q, q)))), 4) AS dist FROM (SELECT *, list_sum(list_transform(range(1, 33), lambda i: (e[i] - q[i]) ** 2)) AS d FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e, ({_Q})[1:32]::DOUBLE[] AS q FROM embeddings)) ORDER BY acosh(1 + 2 * d / ((1 - list_dot_product(e, e)) * (1 - list_dot_product(q, q)))), vec_id LIMIT 10"),
    "v04_dist_product": (lambda s, d: _vectors(s, d).select("lsn", F.round(vectors.product(F.col("p"), vectors.vector(_QUERY)), 3).alias("dist")), f"SELECT vec_id AS lsn, round(sqrt(acosh(1 + 2 * list_sum(list_transform(range(1, 33), lambda i: (h[i] - q[i]) ** 2)) / ((1 - list_dot_product(h, h)) * (1 - list_dot_product(q[1:32], q[1:32])))) ** 2 + acos(greatest(-1, least(1, list_dot_product(s, q[33:48]) / (sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(q[33:48], q[33:48])))))) ** 2 + list_sum(list_transform(range(1, 17), lambda i: (e[i] - q[48 + i]) ** 2))), 3) AS dist FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS h, embedding[33:48]::DOUBLE[] AS s, embedding[49:64]::DOUBLE[] AS e, ({_Q})::DOUBLE[] AS q FROM embeddings)"),
    "v06_nearest": (lambda s, d: retrieval.nearest(_vectors(s, d), F.col("embedding"), _QUERY, 10).select("lsn", F.round("dist", 4).alias("dist")), f"SELECT vec_id AS lsn, round({_DIST}, 4) AS dist FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 10"),
    "v08_filtered_knn": (lambda s, d: retrieval.nearest(_vectors(s, d).where("label = 3"), F.col("embedding"), _QUERY, 10).select("lsn", F.round("dist", 4).alias("dist")), f"SELECT vec_id AS lsn, round({_DIST}, 4) AS dist FROM embeddings WHERE label = 3 ORDER BY {_DIST}, vec_id LIMIT 10"),
    "v12_centroid": (_centroid, "SELECT label, (i - 1)::INTEGER AS i, round(avg(x), 4) AS mean FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i"),
    "t05_quantized_topm": (lambda s, d: _vectors(s, d).select("lsn", vectors.quantize(vectors.euclidean(F.col("embedding"), vectors.vector(_QUERY)), 1000.0).alias("key")).orderBy("key", "lsn").limit(15), f"SELECT vec_id AS lsn, CAST(floor({_DIST} * 1000) AS BIGINT) AS key FROM embeddings ORDER BY 2, 1 LIMIT 15"),
    "r01_recall": (lambda s, d: retrieval.recall(_docs(s, d), _WORDS, 20).select(F.col("key").alias("lsn"), _rounded("score")), f"WITH t AS (SELECT doc_id, {_TOK % 1} AS t FROM documents), x AS (SELECT doc_id, w, len(list_filter(t, lambda y: y = w)) AS tf FROM t, (VALUES ('the'), ('und')) AS q(w)), df AS (SELECT w, count(*) AS df FROM x WHERE tf > 0 GROUP BY w), s AS (SELECT doc_id, sum(tf * greatest(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 1e-4::DOUBLE)) AS score FROM x JOIN df USING (w) WHERE tf > 0 GROUP BY doc_id) SELECT doc_id AS lsn, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id DESC LIMIT 20"),
    "r02_bm25": (lambda s, d: retrieval.bm25(_docs(s, d), _WORDS, 20).select(F.col("key").alias("lsn"), _rounded("score")), f"WITH t AS (SELECT doc_id, {_TOK % 2} AS t FROM documents), a AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS avgdl FROM t), x AS (SELECT doc_id, len(t) AS len, w, len(list_filter(t, lambda y: y = w)) AS tf FROM t, (VALUES ('the'), ('und')) AS q(w)), df AS (SELECT w, count(*) AS df FROM x WHERE tf > 0 GROUP BY w), s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM x JOIN df USING (w), a WHERE tf > 0 GROUP BY doc_id) SELECT doc_id AS lsn, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20"),
    "r03_substring_tf": (lambda s, d: retrieval.substring_search(_docs(s, d), "the", 20).select(F.col("key").alias("lsn"), "score"), "SELECT doc_id AS lsn, ((length(t) - length(replace(t, 'the', ''))) // 3)::BIGINT AS score FROM (SELECT doc_id, lower(text) AS t FROM documents) ORDER BY 2 DESC, 1 DESC LIMIT 20"),
    "r04_tokenize": (lambda s, d: retrieval.word_counts(load(s, d, "documents"), "doc_id", "text"), f"SELECT w, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK % 2}) AS w FROM documents) GROUP BY w"),
    "r05_rrf": (_rrf, "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, w, ((length(t) - length(replace(t, w, ''))) // 3) AS s FROM d, (VALUES ('the'), ('and')) AS q(w)), r AS (SELECT doc_id, row_number() OVER (PARTITION BY w ORDER BY s DESC, doc_id DESC) AS rank FROM c WHERE s > 0) SELECT doc_id AS id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM r WHERE rank <= 50 GROUP BY doc_id"),
}

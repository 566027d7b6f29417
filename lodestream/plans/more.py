"""More queries over the driver's tables: geometry, ranking, appends, exports and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.engine import engine_recall, nearest_hyperbolic
from lodestream.functions import crypto, vectors
from lodestream.functions.sketches import expression
from lodestream.operators import causal, geometry, reports, retrieval
from lodestream.plans.eventlog import _DIST, _Q, _QUERY, _docs, _vectors, _W
from lodestream.sources.episodes import from_events, load, mirror, snapshot
from lodestream.sources.log import Log, cold_compaction, duplicates_merged
from lodestream.streaming.tail import ledger_stream, windowed

_HYP = "embedding[1:32]::DOUBLE[]"


def _folder(spark: SparkSession, what: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else tempfile.mkdtemp(prefix="lodestream-")
    return f"{base.rstrip('/')}/{what}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").selectExpr(*columns.split(";"))


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives when it has read all there is, by way of a folder (append) or memory (complete)."""
    name = f"drained_{uuid.uuid4().hex}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", _folder(spark, "streams")).trigger(availableNow=True)
    if mode == "complete":
        w.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    out = _folder(spark, "stream-output")
    w.format("parquet").start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _embedded(s, d):
    return _vectors(s, d).select("lsn", F.concat(F.lit("v"), "lsn").alias("id"), F.col("p").alias("embedding"), F.create_map().cast("map<string,string>").alias("attrs"))


def _v07(s, d):
    return nearest_hyperbolic(_embedded(s, d), _QUERY[:32], 10).select("lsn", "id", F.round("dist", 4).alias("dist"))


def _v10(s, d):
    e = _vectors(s, d)
    ball = vectors.to_ball(F.transform("embedding", lambda x: x * F.lit(5.0)))
    return e.select("lsn", F.round(vectors.norm(ball), 5).alias("in_ball"), F.round(vectors.to_sphere(F.slice("embedding", 1, 8))[0], 5).alias("on_sphere"))


def _v11(s, d):
    h = _vectors(s, d).select("lsn", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("x"), F.transform(F.slice("embedding", 9, 8), lambda x: x.cast("double")).alias("y"))
    moved = vectors.mobius_add(F.transform("x", lambda a: -a), F.col("y"))
    return h.select(
        "lsn",
        F.round(2 * F.atanh(vectors.norm(moved)), 4).alias("dist"),
        F.round(vectors.norm(vectors.exp_map0(F.col("x"))), 5).alias("exp_norm"),
        F.round(vectors.log_map0(vectors.exp_map0(F.col("x")))[0], 5).alias("back"),
        F.round(vectors.exp_map(F.col("x"), vectors.log_map(F.col("x"), F.col("y")))[0], 4).alias("there"),
    )


def _sample(s, d):
    v = _vectors(s, d).select("lsn", "p")
    pair = v.select(F.col("lsn").alias("i"), F.col("p").alias("a")).join(v.select((F.col("lsn") - 1).alias("i"), F.col("p").alias("b")), "i")
    return pair.select((1 + F.col("i") % 3).cast("double").alias("graph_dist"), "a", "b")


_FIT = f"""WITH v AS (SELECT vec_id AS i, {_HYP} AS h, embedding[33:48]::DOUBLE[] AS s, embedding[49:64]::DOUBLE[] AS e FROM embeddings),
p AS (SELECT 1.0::DOUBLE + a.i % 3 AS g, list_sum(list_transform(range(1, 33), lambda k: (a.h[k] - b.h[k]) ** 2)) AS dh, list_dot_product(a.h, a.h) AS na, list_dot_product(b.h, b.h) AS nb,
  acos(greatest(-1, least(1, list_dot_product(a.s, b.s) / (sqrt(list_dot_product(a.s, a.s)) * sqrt(list_dot_product(b.s, b.s)))))) AS ds, list_sum(list_transform(range(1, 17), lambda k: (a.e[k] - b.e[k]) ** 2)) AS de
  FROM v a JOIN v b ON b.i = a.i + 1),
grid AS (SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) AS c(ci, c), (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) AS k(ki, k2), (VALUES (0, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 0.5), (2, 1.0, 0.5, 0.0), (3, 1.0, 0.0, 1.0)) AS w(wi, w1, w2, w3))
SELECT (ci * 12 + ki * 4 + wi)::INTEGER AS n, round(avg(abs(sqrt(w1 * (acosh(1 + 2 * c * dh / ((1 - c * least(na, (1 - 1e-5) ** 2 / c)) * (1 - c * least(nb, (1 - 1e-5) ** 2 / c)))) / sqrt(c)) ** 2 + w2 * (ds / sqrt(k2)) ** 2 + w3 * de) - g) / g), 4) AS distortion
FROM p, (SELECT ci, ki, wi, c::DOUBLE AS c, k2::DOUBLE AS k2, w1::DOUBLE AS w1, w2::DOUBLE AS w2, w3::DOUBLE AS w3 FROM grid) GROUP BY ci, ki, wi"""


def _fuse(s, d):
    docs = load(s, d, "documents")
    text = retrieval.substring_search(_docs(s, d), "the", 50).select(F.col("key").alias("id"), F.col("key").alias("lsn"), F.col("score").cast("double").alias("value"))
    near = retrieval.nearest(_vectors(s, d), F.col("embedding"), _QUERY, 50).select(F.col("lsn").alias("id"), "lsn", (1 / (1 + F.col("dist"))).alias("value"))
    around = docs.orderBy(F.desc("n_chars"), "doc_id").limit(50).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("lsn"), F.col("n_chars").cast("double").alias("value"))
    return retrieval.fuse(around, near, text, 30, 1000).select("id", F.round("score", 6).alias("score"))


_FUSE = f"""WITH t AS (SELECT doc_id AS id, ((length(t) - length(replace(t, 'the', ''))) // 3)::DOUBLE AS x FROM (SELECT doc_id, lower(text) AS t FROM documents) ORDER BY 2 DESC, 1 DESC LIMIT 50),
v AS (SELECT vec_id AS id, 1 / (1 + {_DIST}) AS x FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 50), g AS (SELECT doc_id AS id, n_chars::DOUBLE AS x FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50),
w AS (SELECT id, coalesce(g.x, 0) / (SELECT max(x) FROM g) AS a, coalesce(v.x, 0) / (SELECT max(x) FROM v) AS b, coalesce(t.x, 0) / (SELECT max(x) FROM t) AS c FROM g FULL JOIN v USING (id) FULL JOIN t USING (id)),
s AS (SELECT id, (a + b + c) * exp(-0.0005::DOUBLE * (1000 - id)) AS score FROM w)
SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 30"""


def _rerank(s, d):
    docs = _docs(s, d)
    top = retrieval.substring_search(docs, "the", 60)
    ranked = top.select(F.col("key").alias("id"), (F.row_number().over(Window.orderBy(F.desc("score"), F.desc("key"))) - 1).alias("rank"))
    features = top.select(F.col("key").alias("id"), (F.col("key") % 7 / 2).alias("distance"), (F.col("score") / 10).alias("text_score"), (F.col("key") % 5 - 7).cast("double").alias("activation"), F.col("key").alias("lsn"), F.lit(1000).alias("head"))
    return retrieval.retrieve([ranked], features, 20, 40).select("id", F.round("final", 6).alias("final"))


_RERANK = """WITH t AS (SELECT doc_id AS id, ((length(t) - length(replace(t, 'the', ''))) // 3) AS s FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE t LIKE '%the%' ORDER BY 2 DESC, 1 DESC LIMIT 40),
f AS (SELECT id, 1 / (1 + (id % 7) / 2.0::DOUBLE) + 0.5::DOUBLE * tanh(s / 10) + 0.3::DOUBLE * greatest((id % 5 - 7)::DOUBLE, -5) / 5 + 0.1::DOUBLE * id / 1000 AS x FROM t)
SELECT id, round(x, 6) AS final FROM f ORDER BY x DESC, id LIMIT 20"""


def _why_until(s, d):
    """The chain from e390 to the third cause back, or to the last one there is; itself if it has none."""
    e = from_events(s, d)
    back = causal.ancestors(e, "e390", 3).orderBy(F.desc("depth")).select("node").first()
    path = causal.why_until(e, "e390", back[0]) if back else ["e390"]
    return s.createDataFrame([(i, x) for i, x in enumerate(path)], "step int, id string")


def _weights(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("example"), (F.col("event_id") == F.min("event_id").over(Window.partitionBy("user_id"))).alias("relevant"), F.floor("value").alias("a"), (F.col("event_id") % 10).alias("b"), F.lit(1).alias("c"))
    return retrieval.learn_weights(e, ["a", "b", "c"]).select(*(F.round(c, 6).alias(c) for c in "abc"))


_MRR = "(SELECT avg(1 / (higher + (equal + 1) / 2)) FROM (SELECT e.user_id, sum(CASE WHEN e.{0} > r.{0} THEN 1 ELSE 0 END) AS higher, sum(CASE WHEN e.{0} = r.{0} THEN 1 ELSE 0 END) AS equal FROM e JOIN e r ON e.user_id = r.user_id AND r.rel GROUP BY e.user_id))"


def _accesses(s, d):
    e = from_events(s, d).withColumn("attrs", F.when(F.col("kind") == "view", F.create_map(F.lit("audit"), F.concat(F.lit("read "), "agent_id"))).otherwise(F.col("attrs")))
    return reports.accesses(e, "u9").select("lsn")


def _append(s, d):
    log = Log(s, _folder(s, "logs"))
    e = load(s, d, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("content"))
    log.append(e.where("kind <> 'error'"), expected=0)
    log.append(e.where("kind = 'error'"))
    return log.episodes().agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("last"), F.countDistinct("lsn").alias("numbers"), F.min(F.when(F.col("kind") == "error", F.col("lsn"))).alias("first_error"), F.countDistinct("ts_hlc").alias("times"))


def _mirror(s, d):
    path = _folder(s, "mirrors")
    mirror(from_events(s, d)).write.parquet(path)
    return s.read.parquet(path).select("lsn", "kind", F.col("content").cast("string").alias("content"), "parents_json", "valid_from", "valid_to", F.get_json_object("attrs_json", "$.k").alias("k"))


def _seal(s, d):
    """Contents sealed and opened again, after one agent's key is gone."""
    e = from_events(s, d)
    path = _folder(s, "keys")
    crypto.new_keys(e).write.parquet(path)
    keys = s.read.parquet(path)
    return crypto.unseal(crypto.seal(e, keys), crypto.shred(keys, "u3")).select("lsn", "content")


def _cold(s, d):
    e = from_events(s, d)
    dead = e.where("kind IN ('error', 'view', 'click')").select("id")
    return cold_compaction(e, dead, least=10).select("lsn")


def _merged(s, d):
    e = from_events(s, d).select("lsn", F.col("agent_id").alias("id"), "kind")
    return duplicates_merged(e.where("lsn < 500"), e.where("lsn >= 400"))


def _fold(s, d):
    """The ledger by a stateful stream: a key's newest operation."""
    out = _drained(s, ledger_stream(_stream(s, d, "event_id AS lsn;CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op;CAST(user_id AS STRING) AS key;event_type AS value")), "append")
    last = out.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "lsn").alias("x"))
    return last.where("NOT x.deleted").select(F.col("key").cast("bigint").alias("key"), "x.value")


def _windows(s, d):
    out = _drained(s, windowed(_stream(s, d, "ts;event_type"), "ts", "1 hour", "1 day"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _spread(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("int").alias("dst"))
    return retrieval.spread(e, 0.25)


def _distill(s, d):
    e = _vectors(s, d)
    return retrieval.distill(e.select("lsn", "embedding", "label"), "embedding", F.col("label"), threshold=1.4)


def _recall(s, d):
    e = _docs(s, d).select("lsn", F.concat(F.lit("d"), "lsn").alias("id"), "content", F.shiftleft("lsn", 16).alias("ts_hlc"), F.array().cast("array<string>").alias("parents"))
    return engine_recall(e, "the und", 10, 1000, 1e6).select("lsn", "id", F.round("score", 6).alias("score"))


def _expression(s, d):
    mask, _ = expression(("and", ("gt", ("column", "l_quantity"), ("const", 10.0)), ("not", ("lt", ("mul", ("column", "l_extendedprice"), ("column", "l_discount")), ("const", 1500.0)))), {"l_quantity": "f64", "l_extendedprice": "f64", "l_discount": "f64"})
    return load(s, d, "lineitem").where(mask).select("l_orderkey", "l_linenumber")


def _sphere_mid(s, d):
    part = lambda a: F.slice("embedding", a, 8).cast("array<double>")
    return _vectors(s, d).select("lsn", F.round(vectors.norm(geometry.sphere_midpoint(part(1), part(9))), 5).alias("n"), F.round(geometry.sphere_midpoint(part(1), part(9))[0], 5).alias("x"))


_X8 = "embedding[1:8]::DOUBLE[]"
_Y8 = "embedding[9:16]::DOUBLE[]"

#: name -> (query, SQL or None)
MORE: dict[str, tuple] = {
    "v05_square_distance": (lambda s, d: _vectors(s, d).select("lsn", F.round(vectors.square_distance(F.col("embedding"), vectors.vector(_QUERY)), 4).alias("d2")), f"SELECT vec_id AS lsn, round(list_sum(list_transform(range(1, 65), lambda i: ((embedding[i])::DOUBLE - ({_Q})[i]::DOUBLE) ** 2)), 4) AS d2 FROM embeddings"),
    "v07_nearest_hyp": (_v07, f"SELECT vec_id AS lsn, 'v' || vec_id AS id, round(acosh(1 + 2 * d / ((1 - list_dot_product(e, e)) * (1 - list_dot_product(q, q)))), 4) AS dist FROM (SELECT *, list_sum(list_transform(range(1, 33), lambda i: (e[i] - q[i]) ** 2)) AS d FROM (SELECT vec_id, {_HYP} AS e, ({_Q})[1:32]::DOUBLE[] AS q FROM embeddings)) ORDER BY acosh(1 + 2 * d / ((1 - list_dot_product(e, e)) * (1 - list_dot_product(q, q)))), vec_id LIMIT 10"),
    "v10_projections": (_v10, f"SELECT vec_id AS lsn, round(least(1 - 1e-5, 5 * sqrt(list_dot_product(e, e))), 5) AS in_ball, round(x[1] / sqrt(list_dot_product(x, x)), 5) AS on_sphere FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {_X8} AS x FROM embeddings)"),
    "v11_gyro_maps": (_v11, f"SELECT vec_id AS lsn, round(acosh(1 + 2 * list_sum(list_transform(range(1, 9), lambda i: (x[i] - y[i]) ** 2)) / ((1 - list_dot_product(x, x)) * (1 - list_dot_product(y, y)))), 4) AS dist, round(tanh(sqrt(list_dot_product(x, x))), 5) AS exp_norm, round(x[1], 5) AS back, round(y[1], 4) AS there FROM (SELECT vec_id, {_X8} AS x, {_Y8} AS y FROM embeddings)"),
    "v12_hyp_centroid": (lambda s, d: geometry.hyperbolic_centroid(_vectors(s, d).select("label", F.col("p.hyp").alias("h")), "label", "h").select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 5)), f"SELECT label, (k - 1)::INTEGER AS i, round(sum(g * x[k]) / sum(g), 5) AS x FROM (SELECT label, e AS x, 1 / sqrt(1 - list_dot_product(e, e)) AS g, unnest(range(1, 33)) AS k FROM (SELECT label, {_HYP} AS e FROM embeddings)) GROUP BY label, k"),
    "v12_sph_midpoint": (_sphere_mid, f"SELECT vec_id AS lsn, 1.0::DOUBLE AS n, round(m[1] / sqrt(list_dot_product(m, m)), 5) AS x FROM (SELECT vec_id, list_transform(range(1, 9), lambda i: (x[i] + y[i]) / 2) AS m FROM (SELECT vec_id, {_X8} AS x, {_Y8} AS y FROM embeddings))"),
    "v13_distortion": (lambda s, d: geometry.distortions(_sample(s, d)).select("n", F.round("distortion", 4).alias("distortion")), _FIT),
    "v13_fit_signature": (lambda s, d: geometry.fit_signature(_sample(s, d)).select("n", F.round("distortion", 4).alias("distortion")), f"SELECT * FROM ({_FIT}) ORDER BY distortion, n LIMIT 1"),
    "r06_rerank": (_rerank, _RERANK),
    "r08_engine_recall": (_recall, None),
    "r09_fuse": (_fuse, _FUSE),
    "r10_spread": (_spread, "SELECT dst AS id, count(*) * 0.25::DOUBLE AS boost FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM (SELECT DISTINCT user_id AS src, CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst FROM events)) WHERE n <= 64 GROUP BY dst"),
    "r11_distill": (_distill, None),
    "g06_ancestors": (lambda s, d: causal.ancestors(from_events(s, d), "e390", 2), f"{_W.replace('WITH', 'WITH RECURSIVE')}, r(node, depth) AS (SELECT 'e390', 0 UNION ALL SELECT 'e' || ep.parent, depth + 1 FROM r JOIN ep ON ep.id = r.node WHERE ep.parent IS NOT NULL AND depth < 2) SELECT node, depth FROM r WHERE depth > 0"),
    "g08_why_until": (_why_until, f"{_W.replace('WITH', 'WITH RECURSIVE')}, r(id, step) AS (SELECT 'e390', 0 UNION ALL SELECT 'e' || ep.parent, step + 1 FROM r JOIN ep ON ep.id = r.id WHERE ep.parent IS NOT NULL AND step < 3) SELECT step, id FROM r"),
    "a12_fusion_weights": (_weights, f"WITH e AS (SELECT user_id, event_id = min(event_id) OVER (PARTITION BY user_id) AS rel, floor(value) AS a, event_id % 10 AS b, 1 AS c FROM events) SELECT round({_MRR.format('a')}, 6) AS a, round({_MRR.format('b')}, 6) AS b, round({_MRR.format('c')}, 6) AS c"),
    "a24_accesses": (_accesses, f"{_W}SELECT lsn FROM ep WHERE kind = 'view' AND agent_id LIKE '%u9%'"),
    "k01_append": (_append, "SELECT count(*) AS n, count(*) - 1 AS last, count(*) AS numbers, count(*) FILTER (WHERE event_type <> 'error') AS first_error, count(*) AS times FROM events"),
    "k08_mirror": (_mirror, f"{_W}SELECT lsn, kind, content, CASE WHEN parent IS NULL THEN '[]' ELSE '[\"e' || parent || '\"]' END AS parents_json, ms AS valid_from, until AS valid_to, CAST(k AS VARCHAR) AS k FROM ep"),
    "k10_threshold_compaction": (_cold, "SELECT event_id AS lsn FROM events WHERE event_type NOT IN ('error', 'view', 'click')"),
    "s12_view_and_tail": (_merged, f"{_W}SELECT max(lsn) AS lsn, agent_id AS id, arg_max(kind, lsn) AS kind FROM ep GROUP BY agent_id"),
    "f_seal_and_shred": (_seal, f"{_W}SELECT lsn, CASE WHEN agent_id <> 'u3' THEN content END AS content FROM ep"),
    "p18_typed_expression": (_expression, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND NOT (l_extendedprice * l_discount < 1500)"),
    "st07_ledger_fold": (_fold, "SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"),
    "st10_stream_windows": (_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type"),
}


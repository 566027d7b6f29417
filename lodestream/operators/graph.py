"""The temporal graph that episodes spell out: edge lives, evidence, belief, neighbourhoods, paths and communities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.compare import number

TYPES = {"fraudpartner": "fraud_partner", "fraud_partner": "fraud_partner", "sociode": "socio_de", "socio_de": "socio_de", "pagou": "pagou", "similara": "similar_a", "similar_a": "similar_a", "notrelated": "not_related", "not_related": "not_related"}


def edge_type_key(name: str) -> str:
    low = name.lower()
    return TYPES.get(low, f"custom:{low}")


def _type_key(c: Column) -> Column:
    """A lookup instead of a case per type, so that c stands twice in the plan and not once a type."""
    low = F.lower(c)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), low), F.concat(F.lit("custom:"), low))


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: loops keep short lineages and survive lost executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = at.get() if at.isDefined() else tempfile.mkdtemp(prefix="lodestream-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/loops/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What an edge is known by.
EDGE = ("edge_id", "src", "dst", "etype")


def edge_ops(episodes: DataFrame) -> DataFrame:
    """One row per edge and episode: assertions and retractions, with evidence.

    An episode with edge_from and edge_to speaks of that edge and of nothing else; any other asserts an edge from each
    of its parents to itself."""
    a = F.col("attrs")
    explicit = a["edge_from"].isNotNull() & a["edge_to"].isNotNull()
    kind = F.when(a["edge_type"].isNotNull(), _type_key(a["edge_type"])).otherwise(F.lit("custom:provenance"))
    common = [F.col("lsn"), kind.alias("etype"), F.coalesce(number(a["confidence"]), F.lit(1.0)).alias("confidence"), F.coalesce(a["rule"], F.lit("provenance")).alias("source")]
    edge_id = F.concat("src", F.lit("->"), "dst", F.lit("#"), "etype")
    named = episodes.where(explicit).select(
        *common, a["edge_from"].alias("src"), a["edge_to"].alias("dst"),
        F.when(F.lower(a["edge_op"]).isin("retract", "close"), "r").otherwise("a").alias("op"),
        F.coalesce(a["hypothesis"], a["rule"]).alias("hypothesis"),
        F.when(F.lower(a["stance"]).isin("refute", "against"), -1).when(a["stance"].isNotNull(), 1).otherwise(F.when(kind == "not_related", -1).otherwise(1)).alias("polarity"),
        F.coalesce(F.col("valid_from"), number(a["valid_from"]).cast("bigint")).alias("world_from"), F.coalesce(F.col("valid_to"), number(a["valid_to"]).cast("bigint")).alias("world_to"),
    )
    parents = episodes.where(~explicit).select(
        *common, F.explode("parents").alias("src"), F.col("id").alias("dst"), F.lit("a").alias("op"), F.lit(None).cast("string").alias("hypothesis"),
        F.when(kind == "not_related", -1).otherwise(1).alias("polarity"), F.col("valid_from").alias("world_from"), F.col("valid_to").alias("world_to"),
    )
    out = named.unionByName(parents).withColumn("edge_id", edge_id)
    return out.withColumn("hypothesis", F.coalesce("hypothesis", "edge_id"))


def edge_intervals(ops: DataFrame) -> DataFrame:
    """edge_id, src, dst, etype, opened, closed (null: open): gaps and islands of assertions and retractions.

    An edge's ends and type are keys beside its id, so that conditions on them are pushed below the windows."""
    by = Window.partitionBy(*EDGE).orderBy("lsn")
    turns = ops.withColumn("p", F.lag("op").over(by)).where(~F.col("op").eqNullSafe(F.col("p")) & ~((F.col("op") == "r") & F.col("p").isNull()))
    return turns.withColumn("closed", F.lead("lsn").over(by)).where("op = 'a'").select("edge_id", "src", "dst", "etype", F.col("lsn").alias("opened"), "closed")


def edge_versions(ops: DataFrame) -> DataFrame:
    """edge_id, src, dst, etype, hypothesis, confidence, polarity, source, since: the first evidence of each hypothesis."""
    first = F.min_by(F.struct("confidence", "polarity", "source"), "lsn").alias("x")
    return ops.where("op = 'a'").groupBy(*EDGE, "hypothesis").agg(first, F.min("lsn").alias("since")).select(*EDGE, "hypothesis", "x.confidence", "x.polarity", "x.source", "since")


def belief_of(polarity: Column, confidence: Column) -> Column:
    """Aggregate: log odds of clamped confidences add up."""
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), confidence))
    return 1 / (1 + F.exp(-F.sum(polarity * F.log(p / (1 - p)))))


def beliefs(versions: DataFrame, as_of: int | None = None) -> DataFrame:
    v = versions if as_of is None else versions.where(F.col("since") < as_of)
    return v.groupBy(*EDGE).agg(belief_of(F.col("polarity"), F.col("confidence")).alias("belief"), F.count(F.lit(1)).alias("n_hypotheses"))


def alive(intervals: DataFrame, as_of: int | None = None) -> DataFrame:
    """Edges that are open at the head, or were just before an LSN."""
    if as_of is None:
        return intervals.where("closed IS NULL")
    at = as_of - 1
    return intervals.where((F.col("opened") <= at) & (F.col("closed").isNull() | (F.col("closed") > at)))


def match_edges(intervals: DataFrame, versions: DataFrame, src: str | None = None, etype: str | None = None, dst: str | None = None, as_of: int | None = None) -> DataFrame:
    e, v = alive(intervals, as_of), versions
    for c, value in (("src", src), ("dst", dst), ("etype", None if etype is None else edge_type_key(etype))):
        if value is not None:
            e, v = e.where(F.col(c) == value), v.where(F.col(c) == value)
    return e.join(beliefs(v, as_of), list(EDGE), "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))


def neighbors(intervals: DataFrame, versions: DataFrame, node: str, etype: str | None = None, as_of: int | None = None, least: float = 0.0) -> DataFrame:
    return match_edges(intervals, versions, node, etype, None, as_of).where(F.col("belief") >= least).select(F.col("dst").alias("node"), "etype", "belief", F.lit(1.0).alias("weight"))


def hypotheses(versions: DataFrame, edge_id: str, as_of: int | None = None) -> DataFrame:
    v = versions.where(F.col("edge_id") == edge_id)
    v = v if as_of is None else v.where(F.col("since") < as_of)
    return v.select("hypothesis", "polarity", "confidence", "source", "since").orderBy("hypothesis")


def bfs(edges: DataFrame, start: str, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth) within depth hops of start, start left out. A frontier join per hop; what has been seen is anti-joined."""
    spark = edges.sparkSession
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        frontier = materialize(e.join(frontier, e["a"] == frontier["node"], "left_semi").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier))
    return seen.where("depth > 0")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, community): the least node of each undirected component. Labels fall to the least neighbour's, then jump to
    their own label's label, so rounds grow with the logarithm of a component's width."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    both = materialize(both.union(both.select("b", "a")).distinct())
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    labels = materialize(nodes.select("n", F.col("n").alias("l")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("l").alias("m"))
        low = labels.join(near, labels["n"] == near["a"], "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("k"))
        jump = labels.select(F.col("n").alias("k"), F.col("l").alias("j"))
        after = materialize(low.join(jump, "k", "left").select("n", F.least("k", F.coalesce("j", "k")).alias("l"), (F.least("k", F.coalesce("j", "k")) != F.col("l")).alias("moved")))
        labels = after.select("n", "l")
        if after.where("moved").isEmpty():
            return labels.select(F.col("n").alias("node"), F.col("l").alias("community"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def metrics(edges: DataFrame) -> DataFrame:
    """node, degree (a loop counts twice), centrality and z-score of the degree over all nodes."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    whole = d.agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("sd"))
    out = d.crossJoin(F.broadcast(whole))  # one row
    return out.select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"), F.when(F.col("sd") > 0, (F.col("degree") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z_score"))


def communities(edges: DataFrame, weight: str = "belief", rounds: int = 20) -> DataFrame:
    """(node, community) by greedy modularity within each connected component: nodes move to the neighbouring community
    with the largest gain, communities become nodes, until nothing gains. Loops are dropped. A component is optimised in
    one task, as arrays of numbers in the order of names (about 100 bytes an edge), so this is for components that fit
    there; components() has no such limit."""
    e = materialize(edges.select("src", "dst", F.col(weight).cast("double").alias("w")))
    comp = components(e)
    roots = materialize(comp.select("community").distinct().withColumn("root", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("root").orderBy("node")) - 1
    nodes = materialize(comp.join(roots, "community").select("node", "root", place.alias("i")))
    ends = nodes.select(F.col("node").alias("dst"), F.col("i").alias("j"))
    rows = e.where("src <> dst").join(nodes.withColumnRenamed("node", "src"), "src").join(ends, "dst").select("root", "i", "j", "w")

    def run(key, table):
        import pyarrow as pa

        i, j, w = (table[c].to_numpy() for c in ("i", "j", "w"))
        to = _modularity(i, j, w, rounds)
        return pa.table([pa.array([key[0].as_py()] * len(to), pa.int64()), pa.array(range(len(to)), pa.int32()), pa.array(to, pa.int32())], ["root", "i", "c"])

    found = rows.groupBy("root").applyInArrow(run, "root bigint, i int, c int")
    named = found.join(nodes.select("root", F.col("i").alias("c"), F.col("node").alias("community")), ["root", "c"]).select("root", "i", "community")
    return nodes.join(named, ["root", "i"], "left").select("node", F.coalesce("community", "node").alias("community"))


def _modularity(i, j, w, rounds: int):
    """The least member of the community of each node. Nodes are 0 to n - 1, all of them on an edge; i <> j.

    Nodes are visited in their order, each sees what those before it have done. Ties stay, else go to the least."""
    import numpy as np

    def adjacency(a, b, w, n):
        """Rows by (a, b), equal ones summed, without a = b: where each a begins, the bs, the weights."""
        key = a.astype(np.int64) * n + b
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        a, b = np.divmod(key[first], n)
        w = np.add.reduceat(w, first)
        degree = np.bincount(a, weights=w, minlength=n)
        apart = a != b
        return degree, np.concatenate(([0], np.cumsum(np.bincount(a[apart], minlength=n)))), b[apart], w[apart], (a, b, w)

    n = int(max(i.max(), j.max())) + 1
    degree, begin, near, much, rows = adjacency(np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((w, w)), n)
    total = float(degree.sum()) or 1.0
    of = np.arange(n)  # the node of this level that each of the first level's is in
    for _ in range(rounds):
        at, volume, sums = np.arange(n), degree.copy(), np.zeros(n)
        starts, degrees = begin.tolist(), degree.tolist()
        moved, gained = True, False
        while moved:
            moved = False
            for v in range(n):
                part = slice(starts[v], starts[v + 1])
                to, d, own = at[near[part]], degrees[v], at[v]
                np.add.at(sums, to, much[part])
                volume[own] -= d
                gains = sums[to] - volume[to] * d / total
                stay = sums[own] - volume[own] * d / total
                best, most = own, gains.max(initial=stay)
                if most > stay:
                    best = to[gains == most].min()
                    at[v], moved, gained = best, True, True
                volume[best] += d
                sums[to] = 0.0
        if not gained:
            break
        kept, new = np.unique(at, return_inverse=True)
        of = new[of]
        n = len(kept)
        degree, begin, near, much, rows = adjacency(new[rows[0]], new[rows[1]], rows[2], n)
    least = np.full(n, len(of))
    np.minimum.at(least, of, np.arange(len(of)))
    return least[of]


def overlay(intervals: DataFrame, add: tuple[str, str, str] | None = None, remove: tuple[str, str, str] | None = None) -> DataFrame:
    """Intervals of a world in which an edge is there, or isn't; the log stays as it is."""
    if remove:
        s, t, d = remove
        return intervals.where(~((F.col("src") == s) & (F.col("dst") == d) & (F.col("etype") == edge_type_key(t)) & F.col("closed").isNull()))
    s, t, d = add
    k = edge_type_key(t)
    one = intervals.sparkSession.createDataFrame([(f"{s}->{d}#{k}", s, d, k, 0)], "edge_id string, src string, dst string, etype string, opened bigint")
    return intervals.join(one.select("edge_id"), "edge_id", "left_anti").unionByName(one.withColumn("closed", F.lit(None).cast("bigint")))

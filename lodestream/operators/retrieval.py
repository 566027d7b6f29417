"""Nearest neighbours, ranked text and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import occurrences, tokens
from lodestream.functions.vectors import euclidean, vector
from lodestream.operators.graph import materialize


def nearest(rows: DataFrame, embedding: Column, query, k: int, key: str = "lsn") -> DataFrame:
    """The k rows nearest to query, exact: a distance per row and a bounded heap per task. Ties by key; k = 0 is empty."""
    return rows.withColumn("dist", euclidean(embedding, vector(query))).where("dist IS NOT NULL").orderBy("dist", key).limit(k)


def _terms(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def term_rows(docs: DataFrame, key: str, text: str, query: list[str], least_bytes: int) -> DataFrame:
    """(key, len, term, tf) of the query's terms only: other terms never leave the scan."""
    wanted = sorted(set(query))
    t = docs.select(F.col(key).alias("key"), tokens(F.col(text), least_bytes).alias("t"))
    return t.select("key", F.size("t").alias("len"), F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.size(F.filter("t", lambda x: x == w)).alias("tf")) for w in wanted))).alias("x")).select("key", "len", "x.term", "x.tf").where("tf > 0") if wanted else t.select("key", F.lit(0).alias("len"), F.lit("").alias("term"), F.lit(0).alias("tf")).limit(0)


def recall(docs: DataFrame, query: str, k: int, key: str = "lsn", text: str = "content", corpus: DataFrame | None = None) -> DataFrame:
    """tf x idf with idf = max(ln(1 + (N - df + .5) / (df + .5)), 1e-4); a term asked for twice counts twice. Ties: later first.

    N is the size of corpus (the head, also for a snapshot), df is counted in docs."""
    q = _terms(query)
    rows = term_rows(docs, key, text, q, 1)
    n = (docs if corpus is None else corpus).agg(F.count(F.lit(1)).alias("n"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)
    idf = F.greatest(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-4))
    weight = F.lit(0)
    for t in set(q):
        weight = F.when(F.col("term") == t, q.count(t)).otherwise(weight)
    terms = df.select("term", (idf * weight).alias("w"))
    return rows.join(F.broadcast(terms), "term").groupBy("key").agg(F.sum(F.col("tf") * F.col("w")).alias("score")).orderBy(F.desc("score"), F.desc("key")).limit(k)  # a row per query term


def bm25(docs: DataFrame, query: str, k: int, key: str = "lsn", text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over tokens of two bytes and more; ties: earlier first."""
    q = [t for t in _terms(query) if len(t.encode()) > 1]
    rows = term_rows(docs, key, text, q, 2)
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.size(tokens(F.col(text)))), F.lit(1.0)).alias("avgdl"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(whole)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.lit(0)
    for t in set(q):
        weight = F.when(F.col("term") == t, q.count(t)).otherwise(weight)
    terms = df.select("term", "avgdl", (idf * weight).alias("w"))
    score = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return rows.join(F.broadcast(terms), "term").groupBy("key").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "key").limit(k)  # a row per query term


def substring_search(docs: DataFrame, part: str, k: int, key: str = "lsn", text: str = "content") -> DataFrame:
    return docs.select(F.col(key).alias("key"), occurrences(F.lower(text), part.lower()).alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("key")).limit(k)


def rrf(lists: list[DataFrame], k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of (id, rank from 0) lists; ties by id."""
    rows = lists[0].select("id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1 / (k + F.col("rank") + 1)).alias("score")).orderBy(F.desc("score"), "id")


def linear_rerank(distance: Column, text_score: Column, activation: Column, lsn: Column, head: Column) -> Column:
    """1/(1+d) + .5 tanh(bm25) + .3 max(activation, -5)/5 + .1 lsn/head; a missing part adds nothing."""
    zero = F.lit(0.0)
    return F.coalesce(1 / (1 + distance), zero) + 0.5 * F.coalesce(F.tanh(text_score), zero) + 0.3 * F.coalesce(F.greatest(activation, F.lit(-5.0)) / 5, zero) + 0.1 * F.coalesce(lsn / head, zero)


def retrieve(lists: list[DataFrame], features: DataFrame, k: int, first: int = 200, scorer=None) -> DataFrame:
    """Two stages: the best `first` by rank fusion, then a scorer (a column over features: id, distance, text_score,
    activation, lsn, head) orders them."""
    scorer = scorer or linear_rerank(*(F.col(c) for c in ("distance", "text_score", "activation", "lsn", "head")))
    return rrf(lists).limit(first).join(features, "id").withColumn("final", scorer).orderBy(F.desc("final"), "id").select("id", "final").limit(k)


def normalised(c: str) -> Column:
    """A channel over its largest value."""
    m = F.max(c).over(Window.partitionBy(F.lit(0)))
    return F.when(m > 0, F.col(c) / m).otherwise(0.0)


def fuse(graph: DataFrame, near: DataFrame, text: DataFrame, k: int, head: int, weights=(1.0, 1.0, 1.0), decay: float = 0.0005) -> DataFrame:
    """Graph belief, 1/(1+distance) and text score of candidates (id, lsn, value), each over its maximum, weighted, and
    less for what is older. Candidates are a few per channel (limited before), so one task normalises them."""
    both = None
    for name, c in (("g", graph), ("v", near), ("t", text)):
        one = c.select("id", "lsn", F.col("value").alias("x"), F.lit(name).alias("c"))
        both = one if both is None else both.unionByName(one)
    wide = both.groupBy("id").agg(F.max("lsn").alias("lsn"), *(F.coalesce(F.max(F.when(F.col("c") == n, F.col("x"))), F.lit(0.0)).alias(n) for n in "gvt"))
    score = sum((w * normalised(n) for w, n in zip(weights, "gvt", strict=True)), F.lit(0.0)) * F.exp(-decay * (head - F.col("lsn")))
    return wide.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).select("id", "score", "g", "v", "t")


def activation(accesses: DataFrame, now: float, decay: float = 0.5, exact: int = 8) -> DataFrame:
    """(id, score) of accesses (id, at): ln of the summed powers of ages, the last `exact` ones each, the others as if spread evenly since the first."""
    w = Window.partitionBy("id").orderBy(F.desc("at"))
    rows = accesses.withColumn("n", F.row_number().over(w))
    age = lambda c: F.greatest(F.lit(now) - c, F.lit(1.0))
    g = rows.groupBy("id").agg(F.sum(F.when(F.col("n") <= exact, F.pow(age(F.col("at")), -decay))).alias("recent"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min(F.when(F.col("n") <= exact, F.col("at"))).alias("kth"))
    t1, tk = age(F.col("first")), age(F.col("kth"))
    tail = F.when((F.col("n") > exact) & (t1 > tk), (F.col("n") - exact) * (F.pow(t1, 1 - decay) - F.pow(tk, 1 - decay)) / ((1 - decay) * (t1 - tk))).otherwise(F.when(F.col("n") > exact, (F.col("n") - exact) * F.pow(t1, -decay)).otherwise(0.0))
    return g.select("id", F.log(F.col("recent") + tail).alias("score"))


def spread(edges: DataFrame, weight: float, fan: int = 64) -> DataFrame:
    """(id, boost): one hop, at most fan neighbours of each source, in order of node."""
    w = Window.partitionBy("src").orderBy("dst")
    return edges.select("src", "dst").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= fan).groupBy(F.col("dst").alias("id")).agg((F.count(F.lit(1)) * weight).alias("boost"))


def mrr(examples: DataFrame, channel: str) -> DataFrame:
    """Mean reciprocal rank of the relevant candidate; ties get their average rank. examples: example, relevant, and channels."""
    right = examples.where("relevant").select("example", F.col(channel).alias("s"))
    ranks = examples.join(right, "example").groupBy("example", "s").agg(F.sum((F.col(channel) > F.col("s")).cast("int")).alias("higher"), F.sum((F.col(channel) == F.col("s")).cast("int")).alias("equal"))
    return ranks.agg(F.avg(1 / (F.col("higher") + (F.col("equal") + 1) / 2)).alias("mrr"))


def distill(episodes: DataFrame, embedding: str, window: Column, threshold: float = 0.8, least: int = 3, most: int = 64) -> DataFrame:
    """Facts of each window's episodes: an episode joins the first cluster whose first member is nearer than threshold;
    clusters of least members and more, the first most ones, are facts with confidence n / (n + 2). Windows bound a task."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        clusters: list[list] = []
        for r in pdf.sort_values("lsn").itertuples():
            v = np.asarray(r.v, float)
            at = next((c for c in clusters if np.linalg.norm(c[0] - v) < threshold), None)
            if at:
                at[1].append(r.lsn)
            else:
                clusters.append([v, [r.lsn]])
        facts = [c for c in clusters if len(c[1]) >= least][:most]
        return pd.DataFrame([(int(pdf["w"].iloc[0]), c[1], len(c[1]) / (len(c[1]) + 2)) for c in facts], columns=["window", "sources", "confidence"])

    rows = episodes.select("lsn", F.col(embedding).alias("v"), window.cast("bigint").alias("w")).where("v IS NOT NULL")
    return rows.groupBy("w").applyInPandas(run, "window bigint, sources array<bigint>, confidence double")


def learn_weights(examples: DataFrame, channels: list[str]) -> DataFrame:
    """One row, a weight per channel: its mean reciprocal rank by itself; all 1 where none has any."""
    out = None
    for c in channels:
        one = mrr(examples, c).select(F.coalesce("mrr", F.lit(0.0)).alias(c))
        out = one if out is None else out.crossJoin(one)  # one row each
    total = sum((F.col(c) for c in channels), F.lit(0.0))
    return out.select(*(F.when(total > 0, F.col(c)).otherwise(1.0).alias(c) for c in channels))


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """w, n, df: how often a word stands in all texts and under how many keys.

    A row's words are sorted, so that the first of each tells whether the row has it: what moves is a row per word, not
    one per word and key. Keys on more than one row, rare, are found first, and what they were counted too often is
    taken off."""
    words = docs.select(F.col(key).alias("key"), F.sort_array(tokens(F.col(text))).alias("t"))
    marked = F.transform("t", lambda w, i: F.struct(w.alias("w"), ((i == 0) | (F.get("t", i - 1) != w)).alias("first")))
    counts = words.select("key", F.explode(marked).alias("x")).groupBy("x.w").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.first") & F.col("key").isNotNull()).alias("df"))
    many = materialize(docs.select(F.col(key).alias("key")).where("key IS NOT NULL").groupBy("key").count().where("count > 1").select("key"))
    if many.isEmpty():
        return counts
    again = words.join(many, "key", "left_semi").select("key", F.explode(F.array_distinct("t")).alias("w")).groupBy("w", "key").agg((F.count(F.lit(1)) - 1).alias("more")).groupBy("w").agg(F.sum("more").alias("more"))
    return counts.join(again, "w", "left").select("w", "n", (F.col("df") - F.coalesce("more", F.lit(0))).alias("df"))

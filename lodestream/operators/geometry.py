"""Midpoints, centroids and the fit of a product space to distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors

#: The grid of a fit: hyperbolic curvatures, spherical ones, and weights of the three parts. Fixed values.
CURVATURES = (-0.5, -1.0, -2.0)
SPHERICAL = (0.5, 1.0, 2.0)
WEIGHTS = ((1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (1.0, 0.5, 0.0), (1.0, 0.0, 1.0))


def sphere_midpoint(u: Column, v: Column) -> Column:
    return vectors.to_sphere(F.zip_with(u, v, lambda a, b: (a.cast("double") + b) / 2))


def hyperbolic_centroid(points: DataFrame, by: str, point: str) -> DataFrame:
    """(by, centroid): means of the points of each group, weighted by their Lorentz factors and pulled into the ball.

    Coordinates are summed where they are, so a group of any size costs a row per coordinate and task."""
    p = F.col(point)
    gamma = 1 / F.sqrt(1 - F.least(vectors.dot(p, p), F.lit(1 - vectors.EDGE)))
    rows = points.select(by, gamma.alias("g"), F.posexplode(p).alias("i", "x"))
    sums = rows.groupBy(by, "i").agg((F.sum(F.col("g") * F.col("x").cast("double")) / F.sum("g")).alias("x"))
    whole = sums.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("l"))  # as many rows as a point has coordinates
    return whole.select(by, vectors.to_ball(F.transform("l", lambda z: z["x"])).alias("centroid"))


def _distance(c: Column, k2: Column, w: tuple[Column, Column, Column]) -> Column:
    """Product distance of the structs a and b, with curvatures and weights of columns."""
    a, b = F.col("a"), F.col("b")
    most = (1 - vectors.EDGE) * (1 - vectors.EDGE) / c
    nu, nv = F.least(vectors.dot(a["hyp"], a["hyp"]), most), F.least(vectors.dot(b["hyp"], b["hyp"]), most)
    h = F.acosh(F.greatest(1 + 2 * c * vectors.square_distance(a["hyp"], b["hyp"]) / ((1 - c * nu) * (1 - c * nv)), F.lit(1.0))) / F.sqrt(c)
    s = vectors.spherical(a["sph"], b["sph"]) / F.sqrt(k2)
    e = vectors.euclidean(a["euc"], b["euc"])
    return F.sqrt(w[0] * h * h + w[1] * s * s + w[2] * e * e)


def distortions(sample: DataFrame) -> DataFrame:
    """(n, k1, k2, w1, w2, w3, distortion) for each of the 36 signatures: the mean share by which product distances of
    a and b miss graph_dist. Pairs without a positive distance don't count; without any, every signature's is 0."""
    grid = [(i, k1, k2, *w) for i, (k1, k2, w) in enumerate((k1, k2, w) for k1 in CURVATURES for k2 in SPHERICAL for w in WEIGHTS)]
    g = sample.sparkSession.createDataFrame(grid, "n int, k1 double, k2 double, w1 double, w2 double, w3 double")
    pairs = sample.where("graph_dist > 0").withColumn("sig", F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(r, g.columns, strict=True))) for r in grid)))).select("graph_dist", "a", "b", "sig.*")
    d = _distance(-F.col("k1"), F.col("k2"), (F.col("w1"), F.col("w2"), F.col("w3")))
    found = pairs.groupBy("n").agg(F.avg(F.abs(d - F.col("graph_dist")) / F.col("graph_dist")).alias("distortion"))
    return g.join(found, "n", "left").withColumn("distortion", F.coalesce("distortion", F.lit(0.0)))


def fit_signature(sample: DataFrame) -> DataFrame:
    """The signature of least distortion, the first of equals."""
    return distortions(sample).orderBy("distortion", "n").limit(1)

"""Distances and maps of product spaces (hyperbolic, spherical, Euclidean) as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-5


def let(value: Column, body) -> Column:
    """body(value), value evaluated once however often body names it: an expression inside a lambda runs anew for each element."""
    return F.transform(F.array(value), body)[0]


def vector(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values)) if len(values) else F.array().cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    """Sum over the places that both have."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def square_distance(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def euclidean(u: Column, v: Column) -> Column:
    return F.sqrt(square_distance(u, v))


def norm(u: Column) -> Column:
    return F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def spherical(u: Column, v: Column, k2: float = 1.0) -> Column:
    """Angle over the root of the curvature; 0 if either is the zero vector."""
    nu, nv = norm(u), norm(v)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(u, v), nu * nv)))
    return F.when((nu == 0) | (nv == 0), F.lit(0.0)).otherwise(F.acos(cos) / F.sqrt(F.lit(float(k2))))


def to_ball(u: Column, c: float = 1.0) -> Column:
    """u, pulled inside the Poincaré ball if its norm exceeds (1 - 1e-5) / sqrt(c)."""
    most = (1 - EDGE) / c**0.5
    return let(norm(u), lambda n: F.transform(u, lambda x: F.when(n > most, x.cast("double") * most / n).otherwise(x.cast("double"))))


def to_sphere(u: Column) -> Column:
    return let(u, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))))


def hyperbolic(u: Column, v: Column, c: float = 1.0) -> Column:
    """Poincaré distance; norms are clamped to the ball, what isn't finite is infinite."""
    most = ((1 - EDGE) / c**0.5) ** 2
    nu, nv = F.least(dot(u, u), F.lit(most)), F.least(dot(v, v), F.lit(most))
    x = 1 + 2 * c * square_distance(u, v) / ((1 - c * nu) * (1 - c * nv))
    d = F.acosh(F.greatest(x, F.lit(1.0))) / F.sqrt(F.lit(float(c)))
    return F.when(F.isnan(d) | d.isNull(), F.lit(float("inf"))).otherwise(d)


def product(row: Column, query: Column, weights=(1.0, 1.0, 1.0), c: float = 1.0, k2: float = 1.0) -> Column:
    """Weighted root of squared parts; the query is cut by the row's own dimensions, null if it has others in all."""
    h, s, e = row["hyp"], row["sph"], row["euc"]
    nh, ns, ne = F.size(h), F.size(s), F.size(e)
    parts = (hyperbolic(h, F.slice(query, 1, nh), c), spherical(s, F.slice(query, nh + 1, ns), k2), euclidean(e, F.slice(query, nh + ns + 1, ne)))
    total = sum((w * d * d for w, d in zip(weights, parts, strict=True)), F.lit(0.0))
    return F.when(F.size(query) == nh + ns + ne, F.sqrt(total))


def mobius_add(x: Column, y: Column, c: float = 1.0) -> Column:
    def of(u: Column, v: Column) -> Column:
        xy, xx, yy = dot(u, v), dot(u, u), dot(v, v)
        factors = F.struct((1 + 2 * c * xy + c * yy).alias("a"), (1 - c * xx).alias("b"), (1 + 2 * c * xy + c * c * xx * yy).alias("d"))
        return let(factors, lambda f: F.zip_with(u, v, lambda p, q: (f["a"] * p + f["b"] * q) / f["d"]))

    return let(x, lambda u: let(y, lambda v: of(u, v)))


def _scaled(v: Column, factor) -> Column:
    """v times factor(norm of v); the zero vector stays."""
    return let(v, lambda u: let(norm(u), lambda n: let(F.when(n > 0, factor(n)).otherwise(1.0), lambda f: F.transform(u, lambda x: f * x.cast("double")))))


def exp_map0(v: Column, c: float = 1.0) -> Column:
    r = c**0.5
    return _scaled(v, lambda n: F.tanh(r * n) / (r * n))


def log_map0(y: Column, c: float = 1.0) -> Column:
    r = c**0.5
    return _scaled(y, lambda n: F.atanh(F.least(r * n, F.lit(1 - EDGE))) / (r * n))


def exp_map(x: Column, v: Column, c: float = 1.0) -> Column:
    """From a point x along v: x (+) tanh(sqrt(c) L |v| / 2) v / (sqrt(c) |v|), L the conformal factor."""
    r = c**0.5
    return let(x, lambda u: mobius_add(u, _scaled(v, lambda n: F.tanh(r * n / (1 - c * dot(u, u))) / (r * n)), c))


def log_map(x: Column, y: Column, c: float = 1.0) -> Column:
    r = c**0.5
    return let(x, lambda u: _scaled(mobius_add(F.transform(u, lambda a: -a), y, c), lambda n: (1 - c * dot(u, u)) / r * F.atanh(F.least(r * n, F.lit(1 - EDGE))) / n))


def quantize(x: Column, scale: float) -> Column:
    """Floor to a whole number, saturating; NaN is 0."""
    y = F.floor(x * scale)
    return F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x * scale >= 2.0**63, F.lit(2**63 - 1)).when(x * scale <= -(2.0**63), F.lit(-(2**63))).otherwise(y.cast("bigint"))

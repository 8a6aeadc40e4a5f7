"""8-bit scalar quantisation of vectors: codes, distances, bounds.

A vector's codes are floor((x - min) / scale + 0.5) with scale = (max - min) / 255;
a constant vector has scale 0 and codes 0. Everything is a Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.functions.metrics import Vector, vector

SLACK = 1e-5  # bounds hold for exact arithmetic; this covers rounding, relative to 1 + |distance|


def params(v: Vector) -> tuple[Column, Column]:
    """(scale, offset) of the codes."""
    d = vector(v).cast("array<double>")
    return (F.array_max(d) - F.array_min(d)) / 255, F.array_min(d)


def encode(v: Vector) -> Column:
    scale, offset = params(v)
    return F.when(scale > 0, F.transform(vector(v).cast("array<double>"), lambda x: F.floor((x - offset) / scale + 0.5).cast("int"))).otherwise(F.transform(vector(v), lambda x: F.lit(0)))


def decode(code: Column, scale: Column, offset: Column) -> Column:
    return F.transform(code, lambda c: offset + scale * c)


def lower_bound(metric: str, approx: Column, scale: Column, q: Vector) -> Column:
    """No exact distance is below this, given the distance to the codes."""
    slack = SLACK * (1 + F.abs(approx))
    dim = F.size(vector(q)).cast("double")
    half = scale / 2
    if metric == "ip":
        return approx - half * F.aggregate(vector(q).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + F.abs(x)) - slack
    if metric in ("l2", "sql2"):
        root = F.greatest(F.lit(0.0), (approx if metric == "l2" else F.sqrt(approx)) - half * F.sqrt(dim))
        return (root if metric == "l2" else root * root) - slack
    raise ValueError(f"8-bit codes give no bound for {metric}")


def with_codes(df: DataFrame, vec: str = "embedding") -> DataFrame:
    scale, offset = params(vec)
    return df.withColumns({"code": encode(vec), "scale": scale, "offset": offset})


def rerank_knn(df: DataFrame, q: Vector, k: int, metric: str = "l2", id: str = "id", vec: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact top-k by way of codes: approximate all, take the k-th exact distance
    among the approximate best as the bound, and score exactly only the rows
    whose lower bound is within it. df has the columns of `with_codes`."""
    d = df if where is None else df.where(where)
    m = metrics.resolve(metric)
    approx = m.distance(decode(F.col("code"), F.col("scale"), F.col("offset")), q)
    seen = d.withColumn("_approx", approx).withColumn("_lb", lower_bound(m.name, F.col("_approx"), F.col("scale"), q))
    best = seen.orderBy("_approx", id).limit(k).agg(F.max(m.distance(vec, q)).alias("_bound"))
    close = seen.crossJoin(F.broadcast(best)).where(F.col("_lb") <= F.coalesce("_bound", F.lit(float("inf"))))
    return close.select(id, m.distance(vec, q).alias("d")).orderBy("d", id).limit(k)

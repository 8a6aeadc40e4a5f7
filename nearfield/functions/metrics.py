"""Vector distances as Catalyst expressions.

Every metric is a pure Column expression over two arrays, summed in double, so it
runs inside the JVM next to the scan. `check=True` raises on unequal lengths
(NULL on either side gives NULL).
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Vector = Column | str | Sequence[float]


def vector(v: Vector) -> Column:
    """A column, a column's name, or a literal vector."""
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.array(*(F.lit(float(x)) for x in v)).cast("array<double>")


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Vector) -> Column:
    return F.sqrt(F.aggregate(vector(v).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))


def squared_l2(a: Vector, b: Vector) -> Column:
    return _sum(vector(a), vector(b), lambda x, y: (x - y) * (x - y))


def l2(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a: Vector, b: Vector) -> Column:
    return _sum(vector(a), vector(b), lambda x, y: x * y)


def negative_inner_product(a: Vector, b: Vector) -> Column:
    return -inner_product(a, b)


def cosine(a: Vector, b: Vector) -> Column:
    """True cosine distance, also for vectors that aren't of unit length; NULL
    if either is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1 - inner_product(a, b) / scale)


def l1(a: Vector, b: Vector) -> Column:
    return _sum(vector(a), vector(b), lambda x, y: F.abs(x - y))


@dataclass(frozen=True)
class Metric:
    name: str
    operator: str
    distance: Callable[[Vector, Vector], Column]
    rank: Callable[[Vector, Vector], Column]  # cheaper, same order
    bounded: bool  # whether 8-bit codes give a lower bound


METRICS = {
    m.name: m
    for m in (
        Metric("l2", "<->", l2, squared_l2, True),
        Metric("sql2", "", squared_l2, squared_l2, True),
        Metric("ip", "<#>", negative_inner_product, negative_inner_product, True),
        Metric("cosine", "<=>", cosine, cosine, False),
        Metric("l1", "<+>", l1, l1, False),
    )
}
OPERATORS = {m.operator: m for m in METRICS.values() if m.operator}


def resolve(name: str | Metric) -> Metric:
    """A metric by its name or operator sign."""
    if isinstance(name, Metric):
        return name
    try:
        return METRICS.get(name) or OPERATORS[name]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}, {', '.join(OPERATORS)}") from None


def checked(metric: str | Metric, a: Vector, b: Vector) -> Column:
    """The distance; unequal lengths are an error."""
    a, b = vector(a), vector(b)
    same = F.size(a) == F.size(b)
    problem = F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(same, resolve(metric).distance(a, b)).otherwise(F.raise_error(problem).cast("double"))


_SQL = {
    "l2_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (acc, x) -> acc + x))",
    "squared_l2_distance": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (acc, x) -> acc + x)",
    "negative_inner_product": "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (acc, x) -> acc + x)",
    "cosine_distance": "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (acc, x) -> acc + x) / (sqrt(aggregate(a, 0D, (acc, x) -> acc + x * x)) * sqrt(aggregate(b, 0D, (acc, x) -> acc + x * x)))",
    "l1_distance": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (acc, x) -> acc + x)",
}


def register_sql(spark: SparkSession) -> None:
    """The metrics and vector_norm as SQL functions; Catalyst inlines them."""
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (acc, x) -> acc + x * x))")

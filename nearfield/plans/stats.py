"""Filter statistics, selectivity, search budgets, costs and the choice of path."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOUNDS = 64
EXACT_VALUES = 1_000_000  # distinct values up to which bounds are picked exactly

#: Page costs per operation, budget limits.
RANDOM_PAGE, SEQ_PAGE, CPU_OPERATOR = 4.0, 1.0, 0.0025
PAGES_PER_NODE, PAGES_PER_TUPLE, TYPICAL_EF = 2.0, 16.0, 40.0
EF_LEAST, EF_MOST, EF_PER_SELECTIVITY = 100.0, 4000.0, 4000.0


def histogram(df: DataFrame, column: str, bounds: int = BOUNDS) -> DataFrame:
    """(i, bound): equi-depth bounds, value number floor(i * (n - 1) / (b - 1))
    of the sorted non-null values. Values are counted first, so one row per
    distinct value is ordered, not the table; with too many of them the bounds
    are approximate percentiles."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c"))
    if df.select(F.approx_count_distinct(column)).first()[0] > EXACT_VALUES:
        picks = [i / (bounds - 1) for i in range(bounds)]
        found = df.agg(F.percentile_approx(F.col(column).cast("long"), picks, 10_000).alias("b"))
        return found.select(F.posexplode("b").alias("i", "bound")).select(F.col("i").cast("long"), "bound")
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("c").over(order)).withColumn("_from", F.col("_upto") - F.col("c"))
    total = counts.agg(F.sum("c").alias("n")).where("n > 0").withColumn("b", F.least(F.col("n"), F.lit(bounds)))
    picks = total.select("n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("i")).select("i", F.when(F.col("b") > 1, F.expr("i * (n - 1) div (b - 1)")).otherwise(0).alias("at"))
    return F.broadcast(picks).join(ranked, (F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_upto"))).select("i", F.col("v").alias("bound"))


def partition_counts(df: DataFrame, column: str) -> DataFrame:
    """(part, n): rows for each value & 255; nulls count as none."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").bitwiseAND(255).alias("part")).agg(F.count("*").alias("n"))


@dataclass
class FilterStats:
    """What a table's filter column looks like."""

    rows: int
    distinct: int
    bounds: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame, column: str, bounds: int = BOUNDS) -> FilterStats:
        rows, distinct = df.agg(F.count(column), F.countDistinct(column)).first()
        return cls(rows, distinct, [r.bound for r in histogram(df, column, bounds).sort("i").collect()])

    def frac_lt(self, c: float) -> float:
        """Share of values below c: 0 at or below the least, 1 above the
        greatest, linear within the band whose lower bound is the last below c."""
        b = self.bounds
        if not b:
            return 1.0
        if len(b) == 1:
            return float(c > b[0])
        if c <= b[0]:
            return 0.0
        if c > b[-1]:
            return 1.0
        i = max(i for i in range(len(b)) if b[i] < c)
        return (i + (c - b[i]) / (b[i + 1] - b[i])) / (len(b) - 1)

    def selectivity(self, keys: list[tuple[str, int]]) -> float:
        """Of (operator, constant) keys together, from 1e-6 to 1."""
        out = 1.0
        for op, c in keys:
            out *= {"<": lambda: self.frac_lt(c), "<=": lambda: self.frac_lt(c + 1), ">=": lambda: 1 - self.frac_lt(c), ">": lambda: 1 - self.frac_lt(c + 1), "=": lambda: 1 / max(1, self.distinct)}[op]()  # noqa: B023
        return min(1.0, max(1e-6, out))


def frac_lt(c: Column, bounds: Column) -> Column:
    """`FilterStats.frac_lt` as an expression over an array of bounds."""
    n = F.size(bounds)
    i = F.size(F.filter(bounds, lambda b: b < c)) - 1
    lo, hi = F.get(bounds, i).cast("double"), F.get(bounds, i + 1).cast("double")
    inside = (i + (c.cast("double") - lo) / (hi - lo)) / (n - 1)
    return F.when(n == 0, 1.0).when(c <= F.get(bounds, F.lit(0)), 0.0).when(c > F.get(bounds, n - 1), 1.0).otherwise(inside)


def selectivity(op: Column, c: Column, bounds: Column, distinct: Column) -> Column:
    raw = (
        F.when(op == "<", frac_lt(c, bounds)).when(op == "<=", frac_lt(c + 1, bounds))
        .when(op == ">=", 1 - frac_lt(c, bounds)).when(op == ">", 1 - frac_lt(c + 1, bounds)).when(op == "=", 1.0 / F.greatest(distinct, F.lit(1)))
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-6), raw))


def auto_ef(sel: float, target: float) -> int:
    """The budget that a recall target asks for at a selectivity."""
    widen = min(4.0, max(0.5, math.sqrt(0.05 / (1 - target))))
    return math.floor(min(EF_MOST, max(EF_LEAST, max(EF_LEAST, EF_PER_SELECTIVITY * sel) * widen)) + 0.5)


def auto_ef_column(sel: Column, target: Column) -> Column:
    widen = F.least(F.lit(4.0), F.greatest(F.lit(0.5), F.sqrt(F.lit(0.05) / (1 - target))))
    return F.floor(F.least(F.lit(EF_MOST), F.greatest(F.lit(EF_LEAST), F.greatest(F.lit(EF_LEAST), sel * EF_PER_SELECTIVITY) * widen)) + F.lit(0.5).cast("double"))


def budget(ef: int, target: float, stats: FilterStats | None, keys: list[tuple[str, int]]) -> int:
    """auto_ef where a target, statistics and a filter are there, else ef."""
    return auto_ef(stats.selectivity(keys), target) if target > 0 and stats and stats.bounds and keys else ef


def index_cost(rows: float, sel: float | None) -> float:
    """Of an index scan: with a filter of selectivity sel, or without one."""
    n = max(1.0, rows)
    start = math.log(max(n, 2.0)) * RANDOM_PAGE
    if sel is None:
        return start + n * PAGES_PER_TUPLE * RANDOM_PAGE
    return start + min(TYPICAL_EF / (sel if sel > 0 else 0.001), n) * PAGES_PER_NODE * RANDOM_PAGE


def row_filter_cost(rows: float, sel: float, m: int = 16) -> float:
    """Of a plain graph scan that evaluates any predicate row by row."""
    n = max(1.0, rows)
    return CPU_OPERATOR * n * sel * math.log(n) / math.log(max(m, 2))


def exact_cost(rows: float, sel: float, rows_per_page: float = 20.0) -> float:
    """Of scanning, filtering and sorting what passes."""
    pages, passing = rows / rows_per_page, max(1.0, rows * sel)
    return pages * SEQ_PAGE + rows * CPU_OPERATOR + 2 * CPU_OPERATOR * passing * math.log2(max(2.0, passing))


def choose_path(rows: float, sel: float | None, has_index: bool = True, enabled: bool = True) -> str:
    """`index` or `exact`, whichever costs less."""
    if not (has_index and enabled):
        return "exact"
    return "index" if index_cost(rows, sel) < exact_cost(rows, 1.0 if sel is None else sel) else "exact"


def explain_knn(rows: float, sel: float | None, k: int, ef: int, has_index: bool = True, enabled: bool = True) -> dict:
    path = choose_path(rows, sel, has_index, enabled)
    return {"path": path, "mode": "unfiltered" if sel is None else "in-filter", "k": k, "ef_search": ef, "selectivity": sel, "index_cost": index_cost(rows, sel), "exact_cost": exact_cost(rows, 1.0 if sel is None else sel), "approximate": path == "index"}


def cost_table(spark: SparkSession, rows: float, sels: DataFrame) -> DataFrame:
    """sels (sel double) -> costs of every path, as expressions."""
    n = F.lit(float(max(1.0, rows)))
    start = F.log(F.greatest(n, F.lit(2.0))) * RANDOM_PAGE
    expand = F.least(F.lit(TYPICAL_EF) / F.when(F.col("sel") > 0, F.col("sel")).otherwise(0.001), n)
    passing = F.greatest(F.lit(1.0), n * F.col("sel"))
    return sels.select(
        "sel",
        (start + expand * PAGES_PER_NODE * RANDOM_PAGE).alias("index_cost"),
        (start + n * PAGES_PER_TUPLE * RANDOM_PAGE).alias("unfiltered_cost"),
        (n / 20.0 * SEQ_PAGE + n * CPU_OPERATOR + 2 * CPU_OPERATOR * passing * F.log2(F.greatest(F.lit(2.0), passing))).alias("exact_cost"),
    )

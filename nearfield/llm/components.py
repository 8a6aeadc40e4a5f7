"""Connected components in DataFrame operations only: alternating large-star
and small-star steps until the edges stand still. Every step sends a node's
neighbours to the least of them. The least is an aggregate, combined map-side and
written, so that the joins are plain equi-joins of written tables: AQE can split
the rows of a node with very many neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import drop_path, materialize


def _star(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """One large-star and one small-star step over edges (u, v) with u > v; and
    the paths of the tables that it reads."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, at_least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
    large, at_large = materialize(large, "large")
    low, at_low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
    small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), [at_least, at_large, at_low]


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any comparable type -> (node, root) for every node with a
    neighbour; root is the least node of its component. Null ends and loops are
    ignored. Each round is written to the shared folder."""
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table, path = materialize(first, "edges")
    state = None
    while True:
        now = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        step, read = _star(table)
        table, new = materialize(step, "edges")
        drop_path(table.sparkSession, path, *read)
        path = new
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

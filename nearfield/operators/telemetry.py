"""Counters of graph searches, added up over the session by accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.operators.graph import COUNTERS

_counters: dict[str, dict] = {}


def counters(spark: SparkSession) -> dict:
    """The session's accumulators, to be added to in tasks."""
    sc = spark.sparkContext
    return _counters.setdefault(sc.applicationId, {c: sc.accumulator(0) for c in COUNTERS})


def scan_stats(spark: SparkSession) -> DataFrame:
    """One row: scans, expansions, cc_hits, loads, reranks, emits of all searches
    that have run, retried tasks included."""
    row = tuple(c.value for c in counters(spark).values())
    return spark.createDataFrame([row], ", ".join(f"{c} long" for c in COUNTERS))


def reset(spark: SparkSession) -> None:
    for c in counters(spark).values():
        c.value = 0

"""Scalar filters: the comparison operators, with typed constants.

NULL never passes. Constants of another integer width still push down to Parquet.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"<": operator.lt, "<=": operator.le, "=": operator.eq, ">=": operator.ge, ">": operator.gt}
TYPES = {"int2": "smallint", "int4": "int", "int8": "bigint", "text": "string"}


def compare(column: Column | str, op: str, value, kind: str | None = None) -> Column:
    """column op value; kind (int2, int4, int8, text) is the constant's type."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}; known: {' '.join(OPERATORS)}")
    constant = F.lit(value) if kind is None else F.lit(value).cast(TYPES[kind])
    return OPERATORS[op](F.col(column) if isinstance(column, str) else column, constant)


def conjunction(keys: Iterable[tuple[str, str, object]]) -> Column:
    """All (column, operator, value) keys; none at all passes everything."""
    out = F.lit(True)
    for column, op, value in keys:
        out = out & compare(column, op, value)
    return out

"""Readers and writers of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, kind: str = "parquet", id: str = "id", vec: str = "embedding", dim: int | None = None, **columns: Column) -> DataFrame:
    """id, embedding and any further columns of a file source; vectors of
    another length than dim are an error when they are read."""
    df = spark.read.format(kind).load(path)
    v = F.col(vec)
    if dim is not None:
        v = F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(F.concat(F.lit(f"vector isn't of dimension {dim} but "), F.size(v).cast("string"))).cast(df.schema[vec].dataType))
    return df.select(F.col(id).cast("long").alias("id"), v.alias("embedding"), *(c.alias(n) for n, c in columns.items()))


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """id, embedding of .fvecs files: rows of a 32-bit length and so many floats.
    Row numbers continue from file to file in the order of their names."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                if not data:
                    continue
                dim = int(np.frombuffer(data, "<i4", 1)[0])
                rows = np.frombuffer(data, "<f4").reshape(-1, dim + 1)[:, 1:]
                for at in range(0, len(rows), 4096):
                    part = np.ascontiguousarray(rows[at : at + 4096])
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, dim, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(at, at + len(part))), vectors], names=["name", "row", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(parse, "name string, row long, embedding array<float>")
    sizes = {r.name: r.n for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()}  # one number per file
    bases, total = [], 0
    for name in sorted(sizes):
        bases += [F.lit(name), F.lit(total)]
        total += sizes[name]
    base = F.create_map(*bases)[F.col("name")] if bases else F.lit(0)
    return rows.select((base + F.col("row")).cast("long").alias("id"), "embedding")


def tile(df: DataFrame, times: int, id: str = "id", vec: str = "embedding", shift: float = 1e-3) -> DataFrame:
    """A scaled-up table: each row `times` times over, with new ids and vectors
    moved a little, the same way in each run."""
    step = df.agg(F.max(id)).first()[0] + 1
    out = df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    moved = F.transform(F.col(vec), lambda x, i: (x + F.lit(shift) * F.sin((F.col("_t") * (i + 1)).cast("double"))).cast("float"))
    return out.withColumn(vec, moved).withColumn(id, F.col(id) + F.col("_t") * step).drop("_t")

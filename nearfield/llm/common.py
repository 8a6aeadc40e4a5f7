"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on
    one machine may it be unset (tests); a temporary folder is made then and set
    as the session's checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/nearfield-{uuid.uuid4().hex}"
    if (made := _scratch.get()) is not None:
        made.append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders of intermediate tables that are made within are deleted at the
    end, but for those taken out of the list."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield made
    finally:
        _scratch.reset(token)
        drop_path(spark, *made)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends
    at a table that outlives any executor. Returns the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Plain lower() is the same, and quicker, on ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def wrapped(docs: DataFrame) -> DataFrame:
    """docs as one struct column `_doc`, so that no name of theirs clashes with
    a working column; select("_doc.*") undoes it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def row_hash(docs: DataFrame, of: str = "_doc") -> Column:
    """A hash of all columns of docs (wrapped as `of`), maps and variants too."""
    plain = lambda f: not any(k in f.dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(F.lit("row"), *(F.col(f"{of}.`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"{of}.`{f.name}`"))) for f in docs.schema))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` up to and with each row, per `keys`, in the
    order (bucket, *order).

    Two levels, so that no key is gathered in one task: sums per (keys, bucket)
    are combined map-side and summed up among themselves (one small row per
    bucket), and the rows of a bucket are summed up on their own. `keys` and
    `bucket` must hold no null.
    """
    group = [*keys, bucket]
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*group).agg(F.sum(value).alias("_sum")).select(*group, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(base, group).withColumn(out, F.sum(value).over(local) + F.col("_base")).drop("_base")


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on between
    tasks, beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

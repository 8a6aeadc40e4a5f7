"""Exact filtered nearest neighbours.

One query is a filter, a distance and TakeOrderedAndProject: the filter and the
columns reach the scan, each task keeps its own k best. Many queries against a
table are a broadcast nested loop with a group limit while the pairs are few, and
blocks of matrix products beyond that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.functions.metrics import Vector

BROADCAST_QUERIES = 1_000  # queries sent to every task; with more, they are dealt out in blocks
LOOP_PAIRS = 1_000_000  # pairs up to which each is an expression of its own
QUERY_BLOCK, ITEM_BLOCK = 1_024, 16_384  # rows that meet in a task
PAIRS = 1 << 20  # pairs of a block that are measured at a time
AGAIN = 8_192  # pairs that are measured again at a time


def knn(df: DataFrame, q: Vector, k: int | None = 10, where: Column | None = None, metric: str = "l2", id: str = "id", vec: str = "embedding", offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """WHERE where ORDER BY distance, id LIMIT k OFFSET offset -> id, keep, d.
    k None: all rows. NULL vectors, and a NULL q, give no rows."""
    if q is None:
        return df.where(F.lit(False)).select(id, *keep, F.lit(None).cast("double").alias("d"))
    d = df if where is None else df.where(where)
    out = d.where(F.col(vec).isNotNull()).select(id, *keep, metrics.resolve(metric).distance(vec, q).alias("d")).where("d IS NOT NULL").orderBy("d", id)
    out = out.offset(offset) if offset else out
    return out if k is None else out.limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, metric: str = "l2", id: str = "id", vec: str = "embedding", qid: str = "qid", qvec: str = "q", strategy: str = "auto") -> DataFrame:
    """The k nearest rows of df for each row (qid, q): qid, id, d, rank."""
    d = (df if where is None else df.where(where)).where(F.col(vec).isNotNull()).select(id, vec)
    asked = queries.where(F.col(qvec).isNotNull()).select(qid, qvec)
    if strategy == "auto":
        few = asked.limit(BROADCAST_QUERIES + 1).count()
        strategy = "loop" if few <= BROADCAST_QUERIES and few * d.count() <= LOOP_PAIRS else "blocks"
    if strategy == "loop":
        found = d.join(F.broadcast(asked), how="cross").select(qid, id, metrics.resolve(metric).distance(vec, F.col(qvec)).alias("d")).where("d IS NOT NULL")
    else:
        found = _blocks(d, asked, k, metrics.resolve(metric).name, id, vec, qid, qvec)
    best = Window.partitionBy(qid).orderBy("d", id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _l1(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dimension by dimension, over tiles that stay in a core's cache."""
    out = np.zeros((len(q), len(x)), x.dtype)
    for at in range(0, len(x), 4096):
        columns = np.ascontiguousarray(x[at : at + 4096].T)
        for i in range(0, len(q), 8):
            rows, total = q[i : i + 8], np.zeros((len(q[i : i + 8]), columns.shape[1]), x.dtype)
            part = np.empty_like(total)
            for j, column in enumerate(columns):
                np.subtract(column[None, :], rows[:, j, None], out=part)
                np.abs(part, out=part)
                total += part
            out[i : i + 8, at : at + 4096] = total
    return out


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances between rows of q and rows of x, in double."""
    if metric == "l1":
        return _l1(q, x)
    dot = q @ x.T
    if metric == "ip":
        return -dot
    if metric == "cosine":
        scale = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        return np.where(scale > 0, 1 - dot / np.where(scale > 0, scale, 1), np.nan)
    dot *= -2
    dot += (q * q).sum(axis=1)[:, None]
    dot += (x * x).sum(axis=1)[None, :]
    square = np.maximum(0, dot, out=dot)
    return np.sqrt(square, out=square) if metric == "l2" else square


def _slack(q: np.ndarray, x: np.ndarray, metric: str, kind: type = np.float64) -> np.ndarray | float:
    """How far rounding may put `distances` off, for every pair."""
    unit = 8 * max(1, x.shape[1]) * np.finfo(kind).eps
    least = kind(8 * x.shape[1] * np.finfo(kind).tiny)  # numbers that are too small to have all digits
    if metric == "sql2":
        return (unit * (q * q).sum(axis=1)).astype(kind)[:, None] + least + (unit * (x * x).sum(axis=1)).astype(kind)[None, :]
    if metric == "ip":
        return np.outer((unit * np.linalg.norm(q, axis=1)).astype(kind), np.linalg.norm(x, axis=1).astype(kind)) + least
    if metric == "l1":
        return (unit * np.abs(q).sum(axis=1)).astype(kind)[:, None] + least + (unit * np.abs(x).sum(axis=1)).astype(kind)[None, :]
    return unit


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str, among: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) of each row of q, as `nearest_flat` finds them."""
    row, places, far = nearest_flat(q, x, ids, k, metric, among)
    ends = np.searchsorted(row, np.arange(1, len(q)))
    return list(zip(np.split(places, ends), np.split(far, ends), strict=True)) if len(q) else []


def nearest_flat(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, place, distance) of the k nearest rows of x for each row of q, by
    row, distance and id; rows without a distance are none. The product form rounds:
    all rows that may be among the k are measured again, term by term. among:
    for each row of q, which rows of x count."""
    kind = {"l2": "sql2"}.get(metric, metric)
    # First in single precision, where that holds the numbers (and squares of them); where it can't tell the rows apart, in double.
    largest = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    single = largest < (1e30 if kind == "l1" else 1e15) and kind != "cosine"
    kinds = (np.float32, np.float64) if single else (np.float64,)
    rough = {t: x.astype(t, copy=False) for t in kinds}
    out, step = [], max(1, PAIRS // max(1, len(x)))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        for t in kinds:
            near, slack = distances(some.astype(t), rough[t], kind), _slack(some, x, kind, t)
            if among is not None:
                near[~among[at : at + step]] = np.nan
            low, bound = near - slack, np.full(len(some), np.inf)
            if len(x) > k:
                near += slack
                bound = np.partition(near, k - 1, axis=1)[:, k - 1]  # NaN comes last
                bound[np.isnan(bound)] = np.inf
            row, few = np.nonzero(low <= bound[:, None])
            if len(row) <= len(some) * (4 * k + 100):
                break
            kinds = kinds[-1:]
        again = np.concatenate([np.empty(0), *(distances_exact(some[row[i : i + AGAIN]], x[few[i : i + AGAIN]], metric) for i in range(0, len(row), AGAIN))])
        order = np.lexsort((ids[few], again, row))
        row, few, again = row[order], few[order], again[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[kept] + at, few[kept], again[kept]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(part) for part in zip((none, none, np.empty(0)), *out, strict=True))


def matrix(vectors: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows in double) of the vectors of a length; null components are NaN."""
    at = np.flatnonzero(pc.equal(pc.list_value_length(vectors), dim).to_numpy())
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in vectors.take(pa.array(at)).chunks]
    return at, np.concatenate([np.empty(0), *flat]).reshape(len(at), dim)


def _blocks(d: DataFrame, asked: DataFrame, k: int, metric: str, id: str, vec: str, qid: str, qvec: str) -> DataFrame:
    """Blocks of queries meet blocks of rows; each pair is one task's matrix
    product and leaves k rows a query. The blocks' sizes don't grow with the tables."""
    n, blocks = asked.count(), max(1, -(-d.count() // ITEM_BLOCK))
    tasks = -(-d.sparkSession.sparkContext.defaultParallelism // blocks)  # smaller blocks of queries, if there were fewer pairs than cores
    q_blocks = max(1, -(-n // QUERY_BLOCK), min(tasks, n // 64))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = d.withColumn("_ib", dealt(id, blocks)).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("_qb", dealt(qid, q_blocks)).withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in (*d.schema, *asked.schema)}

    def meet(items: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        for dim in pc.unique(pc.list_value_length(queries.column(qvec))).to_pylist():
            (rows, x), (some, q) = matrix(items.column(vec), dim), matrix(queries.column(qvec), dim)
            ids, qids = items.column(id).take(pa.array(rows)), queries.column(qid).take(pa.array(some))
            row, places, far = nearest_flat(q, x, ids.to_numpy(), k, metric)
            found.append(pa.table([qids.take(pa.array(row)), ids.take(pa.array(places)), pa.array(far)], names=[qid, id, "d"]))
        return pa.concat_tables([pa.table([queries.column(qid)[:0], items.column(id)[:0], pa.array([], pa.float64())], names=[qid, id, "d"]), *found])

    # Spread out, a pair of blocks a task: few partitions, as they are merged by size, get uneven numbers of pairs.
    spread = max(blocks * q_blocks, min(4 * blocks * q_blocks, 1_000))
    left, right = left.repartition(spread, "_qb", "_ib"), right.repartition(spread, "_qb", "_ib")
    return left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib")).applyInArrow(meet, f"{qid} {kinds[qid]}, {id} {kinds[id]}, d double")


def _sum(terms: np.ndarray) -> np.ndarray:
    """One after the other, as the expressions and SQL add them up."""
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def distances_exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of the rows of x from q, or from as many rows of q."""
    if metric == "ip":
        return -_sum(x * q)
    if metric == "cosine":
        return 1 - _sum(x * q) / (np.sqrt(_sum(x * x)) * np.sqrt(_sum(np.atleast_2d(q * q))))
    if metric == "l1":
        return _sum(np.abs(x - q))
    square = _sum((x - q) ** 2)
    return np.sqrt(square) if metric == "l2" else square


def post_filter_knn(df: DataFrame, q: Vector, k: int, where: Column, oversample: int = 1, metric: str = "l2", id: str = "id", vec: str = "embedding") -> DataFrame:
    """The k * oversample nearest of all rows, then the filter, then k of those."""
    near = df.where(F.col(vec).isNotNull()).withColumn("d", metrics.resolve(metric).distance(vec, q)).orderBy("d", id).limit(k * oversample)
    return near.where(where).orderBy("d", id).select(id, "d").limit(k)


def iterative_knn(df: DataFrame, q: Vector, k: int, where: Column, metric: str = "l2", id: str = "id", vec: str = "embedding", start: int = 1, most: int | None = None) -> DataFrame:
    """Post-filtering with twice the oversampling until k rows pass, or the
    whole table (or `most` rows) was taken."""
    rows = df.count()
    limit = rows if most is None else min(most, rows)
    m = start
    while True:
        found = post_filter_knn(df, q, k, where, m, metric, id, vec)
        if k * m >= limit or found.count() >= k:
            return found
        m *= 2


def register_knn(spark: SparkSession, name: str, table: str, k: int = 10, metric: str = "l2", id: str = "id", vec: str = "embedding", bucket: str = "bucket") -> None:
    """A SQL table function name(q, below): the k nearest rows of `table` to q
    with bucket < below, usable in FROM and LATERAL."""
    distance = {"l2": "l2_distance", "sql2": "squared_l2_distance", "ip": "negative_inner_product", "cosine": "cosine_distance", "l1": "l1_distance"}[metrics.resolve(metric).name]
    metrics.register_sql(spark)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(q ARRAY<DOUBLE>, below INT) RETURNS TABLE (id BIGINT, d DOUBLE)
        RETURN SELECT {id} AS id, {distance}(CAST({vec} AS ARRAY<DOUBLE>), q) AS d FROM {table} WHERE {bucket} < below ORDER BY d, id LIMIT {int(k)}""")


def register_knn_batch(spark: SparkSession, name: str, table: str, queries: str, k: int = 10, where: Column | None = None, metric: str = "l2", id: str = "id", vec: str = "embedding", qid: str = "qid", qvec: str = "q", strategy: str = "auto") -> None:
    """A SQL table function name(qid): the k nearest rows of `table` that pass
    `where`, for a row of `queries`. A LATERAL call over all of them is one batch
    search and a join by qid; over `register_knn` it sorts every pair by the vector."""
    found = knn_batch(spark.table(table), spark.table(queries), k, where, metric, id, vec, qid, qvec, strategy)
    found.createOrReplaceTempView(f"{name}_found")
    kinds = dict(found.dtypes)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked {kinds[qid]}) RETURNS TABLE (id {kinds[id]}, d DOUBLE)
        RETURN SELECT {id} AS id, d FROM {name}_found WHERE {qid} = asked""")

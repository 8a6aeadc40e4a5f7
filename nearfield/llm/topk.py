"""Exact top-k by inner product: columnar branch and bound.

Vectors are quantised to floor(scale * x) and packed into blocks in vertical
layout, one contiguous array per dimension. A task gets one block of queries and
one block of candidates. For each query it adds up scores dimension block by
dimension block; by Cauchy-Schwarz the rest can add at most the product of the
remaining norms, so candidates whose score plus that is below the k-th best
score already certain are dropped and the survivors are compacted. The k best of
each pair of blocks meet in a window per query.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinity
takes no part, nor does a null id; only vectors of one length are compared; rows
that repeat an id and vector count once, and a query never meets its own id (a
query id with several vectors is asked with each, and its best rows are ranked
together); a score that 64 bits can't hold counts as the nearest one they can;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, DIMS = 8192, 2048, 16


def quantise(vectors: list, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):  # a product beyond the range is the largest number in it
        return np.nan_to_num(np.floor(scale * np.asarray(vectors, dtype=np.float64)))


def _limit(dim: int) -> float:
    """Components below it give scores that float64 holds exactly."""
    return 2.0**26 / np.sqrt(max(dim, 1))


def search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and columns of x (dimensions by candidates), both whole numbers
    -> (row of q, id, score) of the k best for each row, ids ascending in ties.
    Pairs with a vector of very large components are summed up as whole numbers
    of any size."""
    limit = _limit(q.shape[1])
    plain_q, plain_x = np.abs(q).max(axis=1, initial=0) < limit, np.abs(x).max(axis=0, initial=0) < limit
    if plain_q.all() and plain_x.all():
        return _bound(q, x, ids, own, k)
    parts, columns = [], (np.flatnonzero(plain_x), np.flatnonzero(~plain_x))
    some = np.flatnonzero(plain_q)
    rows, found, scores = _bound(q[some], np.ascontiguousarray(x[:, columns[0]]), ids[columns[0]], own[some], k)
    parts.append((some[rows], found, scores))
    for i in range(len(q)):
        for at in columns[1] if plain_q[i] else range(len(ids)):
            if ids[at] != own[i]:
                score = sum(int(a) * int(b) for a, b in zip(q[i], x[:, at], strict=True))
                parts.append((np.array([i]), ids[at : at + 1], np.array([min(max(score, -(2**63)), 2**63 - 1)])))
    rows, found, scores = (np.concatenate([p[j].astype(np.int64) for p in parts]) for j in range(3))
    order = np.lexsort((found, ~scores, rows))  # ~ turns the order and, unlike -, can't overflow
    rows, found, scores = rows[order], found[order], scores[order]
    first = np.searchsorted(rows, rows)
    best = np.arange(len(rows)) - first < k
    return rows[best], found[best], scores[best]


def _bound(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`search` by branch and bound, for scores below 2 ** 53."""
    steps = range(0, q.shape[1], DIMS)
    square = lambda a, axis: np.sqrt(np.cumsum(np.flip(np.add.reduceat(a * a, list(steps), axis=axis), axis), axis=axis))
    q_rest = np.flip(square(q, 1), 1)  # norm from each dimension block on
    x_rest = np.flip(square(x, 0), 0)
    rows, out_ids, scores = [], [], []
    for i in range(len(q)):
        live, score = None, np.zeros(len(ids))
        for b, at in enumerate(steps):
            block = x[at : at + DIMS]
            score = score + q[i, at : at + DIMS] @ (block if live is None else block[:, live])
            if at + DIMS >= q.shape[1]:
                break
            rest = q_rest[i, b + 1] * (x_rest[b + 1] if live is None else x_rest[b + 1][live]) * (1 + 1e-9) + 1e-6
            # The query itself may be among the k best here: one more is kept.
            if len(score) > k + 1:
                sure = np.partition(score - rest, -(k + 1))[-(k + 1)]
                keep = np.flatnonzero(score + rest >= sure)
                live = keep if live is None else live[keep]
                score = score[keep]
        live = np.arange(len(ids)) if live is None else live
        other = ids[live] != own[i]
        live, score = live[other], score[other]
        best = np.lexsort((ids[live], -score))[:k]
        rows.append(np.full(len(best), i))
        out_ids.append(ids[live[best]])
        scores.append(score[best])
    whole = lambda a: np.concatenate([np.empty(0, np.int64), *a]).astype(np.int64)
    return whole(rows), np.concatenate([np.empty(0, np.int64), *out_ids]), np.concatenate([np.empty(0), *scores]).astype(np.int64)


def _pack(scale: float, group: str):
    """Rows of one block -> one row: ids and the vectors in vertical layout."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        values = quantise(pdf["embedding"].tolist(), scale)
        ids = pdf["vec_id"].to_numpy(np.int64)  # ids never pass through floating point
        keep = ~pd.DataFrame(values).assign(vec_id=ids).duplicated().to_numpy()
        return pd.DataFrame({group: [pdf[group].iloc[0]], "dim": [values.shape[1]], "ids": [ids[keep].tobytes()], "cols": [np.ascontiguousarray(values[keep].T).tobytes()]})

    return pack


def top_k(items: DataFrame, is_query, k: int = 5, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best other rows of items for each row where `is_query` (a Column):
    query_id, rank, vec_id, score."""
    sound = F.expr("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    v = items.where(sound).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    n, nq = v.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-nq // query_block))
    cell = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    pair = ["qb", "ib", "dim"]
    packed = v.withColumn("ib", cell(blocks)).groupBy("ib", "dim").applyInPandas(_pack(scale, "ib"), "ib int, dim int, ids binary, cols binary")
    asked = v.where(is_query).withColumn("qb", cell(q_blocks)).groupBy("qb", "dim").applyInPandas(_pack(scale, "qb"), "qb int, dim int, ids binary, cols binary")
    # Every block of the stated query set meets every block of rows, each pair in a task's own memory.
    left = packed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        unpack = lambda f: (np.frombuffer(f["ids"].iloc[0], np.int64), np.frombuffer(f["cols"].iloc[0]).reshape(f["dim"].iloc[0], -1))
        (ids, x), (own, q) = unpack(a), unpack(b)
        rows, found, scores = search(np.ascontiguousarray(q.T), x, ids, own, k)
        return pd.DataFrame({"query_id": own[rows], "vec_id": found, "score": scores})

    met = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

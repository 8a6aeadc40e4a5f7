"""Sharding by a Feistel permutation of global row numbers.

Every document gets a global row number, its rank by (hash of doc_id, size and
checksum); equal ones are numbered in a row, EQUAL_ROWS at a time. A balanced Feistel network over the smallest even number of bits that
holds n, walked along its cycle until the value is below n, permutes 0..n-1.
Position p of the permutation belongs to shard p mod S and slot p div S, so
shard sizes differ by one row at most, slots have no gaps, and either direction
can be computed from the row number alone (`permute`, `unpermute`).

Defined cases: null text counts as empty (size 1, checksum 0); null doc_id and
repeated rows are rows of their own (fully equal rows are interchangeable);
an empty table gives an empty result; extra columns are carried by
`shard_documents`, its own columns replace those of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, row_hash, running_sum, wrapped

ROUNDS = 6
ORDER = ["doc_id", "text_crc32", "size"]
EQUAL_ROWS = 10_000  # equal rows that are numbered in one place
ROWS_PER_BUCKET, LEAST_BUCKETS = 50_000, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _feistel(v: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = v >> h, v & mask
    for r in range(ROUNDS)[:: -1 if back else 1]:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
        if back:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return left << h | right


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half = _half(n)
    with np.errstate(over="ignore"):
        out = _feistel(np.asarray(x, dtype=np.uint64), half, seed, back)
        while (far := np.flatnonzero(out >= np.uint64(n))).size:
            out[far] = _feistel(out[far], half, seed, back)
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of the row numbers x (0..n-1) in the shuffled order."""
    return _walk(x, n, seed, back=False)


def unpermute(p: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at the positions p; the inverse of `permute`."""
    return _walk(p, n, seed, back=True)


def places(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df (columns `order`) -> (order, _part, _n, _first): _n equal rows of df are
    numbered from _first on; and the number of all rows. Numbers go up in the
    order of a hash of `order`, then `order`: they depend on the rows alone, not on
    how they are partitioned. Equal rows are counted map-side; more than
    EQUAL_ROWS of them are dealt out over several places."""
    counted, _ = materialize(df.groupBy(*order).agg(F.count("*").alias("_n")), "rows")
    n, parts = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("_n") / EQUAL_ROWS)), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-parts // ROWS_PER_BUCKET))
    dealt = counted.select("*", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / EQUAL_ROWS).cast("int"))).alias("_part")).withColumn("_n", F.least(F.col("_n") - F.col("_part") * EQUAL_ROWS, F.lit(EQUAL_ROWS)))
    hashed = dealt.withColumn("_h", F.xxhash64(*order, "_part")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    summed = running_sum(hashed, [], "_b", ["_h", *order, "_part"], "_n", "_upto")
    return summed.select(*order, "_part", "_n", (F.col("_upto") - F.col("_n")).alias("_first")), n


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """docs with size, text_crc32, row_no, shard and slot, under law `rows`. Rows
    are numbered by a hash of all columns; equal rows are shuffled as one."""
    own, key = ["size", "text_crc32", "row_no", "shard", "slot"], ["_null", "_id", "_size", "_crc", "_row"]
    keyed = lambda df: df.withColumns({"_null": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_size": F.col("size"), "_crc": F.col("text_crc32")})
    whole = wrapped(docs).withColumn("_row", row_hash(docs))
    kept = whole.select(F.struct(*(F.col(f"_doc.`{c}`") for c in docs.columns if c not in own)).alias("_doc"), "_doc.doc_id", "_doc.text", "_row").select("_doc", "doc_id", "_row", *_measures())
    placed, n = places(kept.select("_row", *ORDER), [*ORDER, "_row"])
    ranges = keyed(placed).groupBy(*key).agg(F.collect_list(F.struct("_first", "_n")).alias("_ranges"))
    one = keyed(kept).groupBy(*key).agg(F.first("_doc").alias("_doc"))
    each = one.join(ranges, key).select("_doc", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.explode("_ranges").alias("_p"))
    numbered = each.select("_doc", "size", "text_crc32", F.explode(F.sequence("_p._first", F.col("_p._first") + F.col("_p._n") - 1)).alias("row_no"))
    return _shards(numbered, n, shards, seed).select("_doc.*", *own)


def _measures() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _shards(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    @F.pandas_udf("long")
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    placed = numbered.withColumn("_at", position("row_no"))
    return placed.withColumns({"shard": F.pmod("_at", F.lit(shards)).cast("int"), "slot": F.expr(f"_at div {shards}")}).drop("_at")


def shard_table(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """The placement without texts: only narrow rows are shuffled."""
    placed, n = places(docs.select("doc_id", *_measures()), ORDER)
    each = placed.select(*ORDER, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias("row_no"))
    return _shards(each, n, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")

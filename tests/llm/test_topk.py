import math
import random

from pyspark.sql import functions as F

from nearfield.llm.topk import top_k


def brute(rows, every, k=5):
    good, seen = [], set()
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x if abs(x) < 1e300 else math.copysign(1.7976931348623157e308, x)) for x in v)
        if (i, q) not in seen:
            seen.add((i, q))
            good.append((i, q))
    out = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(q, c, strict=True))), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def clamp(score):
    return min(max(score, -(2**63)), 2**63 - 1)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.5, rng.gauss(0, 1)]) for _ in range(40)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(50)]  # ties
    rows += [(1000, None), (None, rows[0][1]), (1010, []), (1020, [None] * 40), (1030, [math.nan] + [0.0] * 39), (1040, [math.inf] + [0.0] * 39), (20, rows[20][1]), (1050, [1.0, 2.0]), (1060, [0.5, 0.25]), (1070, [3e9] * 40), (1080, [-1e30] * 40), (1081, [2e200] * 40), (1083, [1.7e308] * 40), (1082, [7e12] + [0.25] * 39), (1090, [3e5] * 40)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    for block in (8192, 100):
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, block=block, query_block=16).collect())
        assert got == brute(rows, 20)


def test_ids_beyond_2_to_53(spark):
    """Equal vectors whose ids differ in the last bit only are different rows."""
    rows = [(2**60 + i, [0.5, 0.25]) for i in range(4)] + [(2**60 + 64, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 2 == 0).collect())
    assert got == brute(rows, 2) and len([r for r in got if r[0] == 2**60]) == 4


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).collect() == []

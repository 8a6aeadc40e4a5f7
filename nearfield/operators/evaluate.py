"""Recall, order, selectivity and latency: the evaluation side, all relational."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int, qid: str = "qid", id: str = "id", of_truth: bool = False) -> DataFrame:
    """(qid, hits, recall) for each query of truth; both are (qid, id). Recall is
    of k rows, or of_truth of those that are there. truth is read once."""
    pairs = truth.select(qid, id).distinct().join(found.select(qid, id, F.lit(True).alias("_hit")).distinct(), [qid, id], "left")
    out = pairs.groupBy(qid).agg(F.count(id).alias("_n"), F.count("_hit").alias("hits"))
    return out.select(qid, "hits", (F.col("hits") / (F.col("_n") if of_truth else F.lit(float(k)))).alias("recall"))


def recall_summary(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.count("*").alias("n_queries"))


def returned(found: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """(qid, cnt, full): whether each query got k rows."""
    return found.groupBy(qid).agg(F.count("*").alias("cnt")).withColumn("full", F.col("cnt") == k)


def order_check(found: DataFrame, qid: str = "qid", position: str = "rank", d: str = "d") -> DataFrame:
    """(qid, monotone): distances never fall from one row to the next."""
    following = F.lead(d).over(Window.partitionBy(qid).orderBy(position))
    return found.select(qid, (F.col(d) <= F.coalesce(following, F.col(d))).alias("_ok")).groupBy(qid).agg(F.every("_ok").alias("monotone"))


def filter_check(found: DataFrame, where: Column) -> DataFrame:
    """One row: whether every row passes (NULL doesn't), and how many there are."""
    return found.agg(F.coalesce(F.every(F.coalesce(where, F.lit(False))), F.lit(True)).alias("all_pass"), F.count("*").alias("n"))


def same_result(a: DataFrame, b: DataFrame, qid: str = "qid", id: str = "id", position: str = "rank") -> DataFrame:
    """(qid, same): both list the same ids in the same order."""
    listed = lambda df, name: df.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, id))), lambda x: x[id]).alias(name))
    return listed(a, "_a").join(listed(b, "_b"), qid, "full").select(qid, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def selectivities(df: DataFrame, column: str, thresholds: Iterable[int]) -> DataFrame:
    """(threshold, cnt, selectivity) of column < threshold, in one pass."""
    limits = list(thresholds)
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(column) < t).alias(f"_{i}") for i, t in enumerate(limits)))
    each = F.array(*(F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"_{i}").alias("cnt")) for i, t in enumerate(limits)))
    return counts.select("_n", F.inline(each)).select("threshold", "cnt", (F.col("cnt") / F.col("_n")).alias("selectivity"))


def correlated_bucket(df: DataFrame, blocks: int = 10, vec: str = "embedding") -> Column:
    """Which of `blocks` equal blocks of dimensions has the greatest norm (the
    first in a tie); dimensions left over are ignored."""
    size = F.floor(F.size(vec) / blocks)
    norms = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.aggregate(F.slice(vec, (b * size + 1).cast("int"), size.cast("int")), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.array_position(norms, F.array_max(norms)) - 1


def pareto(points: DataFrame, recall: str = "recall", qps: str = "qps") -> DataFrame:
    """The points that no other is at least as good as in both, and better in
    one. By a running maximum over points from the best recall down, one pass
    over a sorted list of distinct recalls instead of all pairs."""
    best = points.groupBy(recall).agg(F.max(qps).alias("_best"))
    above = F.max("_best").over(Window.orderBy(F.desc(recall)).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_above", above).where(F.col("_above").isNull() | (F.col("_best") > F.col("_above"))).select(F.col(recall).alias("_r"), "_best")
    return points.join(front, (F.col(recall) == F.col("_r")) & (F.col(qps) == F.col("_best")), "left_semi")


def latency(samples: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """Least, median, p90, p95, p99 and the rate of the median, per group."""
    p = lambda x: F.percentile(ms, F.lit(x))
    return samples.groupBy(*by).agg(F.min(ms).alias("min_ms"), p(0.5).alias("median_ms"), p(0.9).alias("p90_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"), (F.lit(1000.0) / p(0.5)).alias("qps_median"))


def matched_recall(points: DataFrame, target: float, by: list[str], ef: str = "ef", recall: str = "recall") -> DataFrame:
    """The least ef with recall >= target, per group, and its recall."""
    return points.where(F.col(recall) >= target).groupBy(*by).agg(F.min(ef).alias("ef"), F.min_by(recall, ef).alias("recall"))


def rerank_recall(fetched: DataFrame, truth: DataFrame, k: int, d: str = "d", qid: str = "qid", id: str = "id") -> DataFrame:
    """Recall of the k best by exact distance among fetched (qid, id, d)."""
    best = Window.partitionBy(qid).orderBy(d, id)
    return recall(fetched.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k), truth, k, qid, id)


def plan_nodes(df: DataFrame) -> list[str]:
    """Operators of the executed plan, from the root."""
    import re

    return re.findall(r"[-+* |:]*\b([A-Z]\w+)\b.*", df._jdf.queryExecution().executedPlan().toString())


def post_filtered(near: DataFrame, k: int, multipliers: Iterable[int], where: Column, d: str = "d", qid: str = "qid", id: str = "id") -> DataFrame:
    """(run, qid, id, d): what post-filtering leaves of each query's k * run
    nearest rows, the k nearest that pass, for each multiplier. near: the nearest
    rows for the largest one, with their rank among all rows and the columns of
    `where`; the nearest rows for a smaller one are the first of them, so one
    search serves all."""
    passing = near.where(where).select(F.explode(F.array(*map(F.lit, multipliers))).alias("run"), qid, id, d, "rank").where(F.col("rank") <= F.col("run") * k)
    best = Window.partitionBy("run", qid).orderBy(d, id)
    return passing.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("run", qid, id, d)


def recall_by_run(found: DataFrame, truth: DataFrame, k: int, runs: Iterable) -> DataFrame:
    """(run, qid, hits, recall) for each of these runs and each query of truth;
    found is (run, qid, id)."""
    asked = lambda df: df.select(F.struct("run", "qid").alias("qid"), "id")
    every = truth.select(F.explode(F.array(*map(F.lit, runs))).alias("run"), "qid", "id")
    return recall(asked(found), asked(every), k).select("qid.run", "qid.qid", "hits", "recall")


def compare_runs(runs: dict[str, DataFrame], truth: DataFrame, k: int) -> DataFrame:
    """(qid, <name>, ...): the recall of each named run, side by side."""
    found = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("run"), "qid", "id")
        found = part if found is None else found.unionAll(part)
    return side_by_side(recall_by_run(found, truth, k, runs), {name: name for name in runs})


def side_by_side(per_run: DataFrame, names: dict) -> DataFrame:
    """(qid, <name>, ...) of (run, qid, recall); names: run -> column."""
    return per_run.groupBy("qid").agg(*(F.max(F.when(F.col("run") == run, F.col("recall"))).alias(name) for run, name in names.items()))


def rows_read(df: DataFrame) -> dict[str, int]:
    """Rows, files and bytes that the scans of df read, by running it."""
    plan = df._jdf.queryExecution().executedPlan()
    out = {"rows": 0, "files": 0, "bytes": 0}
    df.collect()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            nodes.append(node.plan())
            continue
        if name.startswith("Scan "):
            for key, metric in (("rows", "numOutputRows"), ("files", "numFiles"), ("bytes", "filesSize")):
                if (found := node.metrics().get(metric)).isDefined():
                    out[key] += found.get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def sweep(run, efs: Iterable[int], truth: DataFrame, k: int) -> list[tuple[int, float]]:
    """(ef, mean recall) of run(ef), a (qid, id) table, for each ef."""
    return [(ef, recall_summary(recall(run(ef), truth, k)).first()[0]) for ef in efs]


def throughput(run, clients: Iterable[int], seconds: float) -> list[tuple[int, float]]:
    """(clients, queries a second) of run(), called from so many threads of one
    session."""
    import threading
    import time

    out = []
    for n in clients:
        done, until = [0] * n, time.monotonic() + seconds

        def work(i: int, until: float = until, done: list[int] = done) -> None:
            while time.monotonic() < until:
                run()
                done[i] += 1

        began = time.monotonic()
        threads = [threading.Thread(target=work, args=(i,)) for i in range(n)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        out.append((n, sum(done) / (time.monotonic() - began)))
    return out

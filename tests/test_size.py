"""Queries over every pair of a query set and the table, in forms that hold at size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import queries as q
from nearfield.operators import evaluate, exact, graph
from nearfield.operators.graph import PackedGraph, ShardGraph, _order, pack
from nearfield.operators.index import Best, GraphIndex, _best
from nearfield.plans.options import IndexOptions

BLOCKED = ["recall_at_k", "recall_postfilter_by_multiplier", "returned_counts", "three_way_comparison", "rerank_top50_recall", "knn_lateral"]


@pytest.mark.parametrize("name", BLOCKED)
def test_pairs_meet_in_blocks(spark, sf, name):
    """No pair is a row of a nested loop: that took over 25 s for 5 million pairs."""
    nodes = evaluate.plan_nodes(q.QUERIES[name](spark, sf))
    assert "FlatMapCoGroupsInArrow" in nodes and not {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(nodes)


def packed(metric="l2", n=400, **options):
    x = np.random.default_rng(3).normal(size=(n, 16)).astype(np.float32)
    g = ShardGraph(IndexOptions(gamma=2, ef_construction=32, metric=metric, **options), 16, 1)
    g.add(range(n), [i % 100 for i in range(n)], list(x))
    row = pack(g)
    return PackedGraph(g.o, row | {"row_id": np.array(row["row_id"]), "deleted": np.arange(n) % 9 == 0}), x.astype(float)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_many_searches_find_what_single_ones_do(metric):
    """At every budget: same rows, same counters; nodes that nothing links are found by neither."""
    g, x = packed(metric)
    for ef in (1, 30, 100, 400):
        for codes in (False, True):
            many, count = g.search_many(x[::10], np.arange(400) % 100 < 20, ef, 10, codes=codes)
            single = [g.search(v, np.arange(400) % 100 < 20, ef, 10, codes=codes) for v in x[::10]]
            assert [g.ids[at].tolist() for at, _ in many] == [[i for _, i in found] for found, _ in single]
            np.testing.assert_allclose([d for _, far in many for d in far], [d for found, _ in single for d, _ in found], atol=1e-9)
            assert count == {c: sum(s[1][c] for s in single) for c in count}
    g._links, g._extra = np.full_like(g._links, g.entry), np.full_like(g._extra, g.entry)
    assert [len(at) for at, _ in g.search_many(x[:5], np.ones(400, bool), 400, None)[0]] == [len(g.search(v, np.ones(400, bool), 400, None)[0]) for v in x[:5]]


def test_exhaustive_batch_walks_once(monkeypatch):
    """A budget that covers the shard: the links are walked once, not for each query."""
    g, x = packed()
    want = [g.search(v, np.ones(400, bool), 10_000_000, 10)[0] for v in x[:50]]
    monkeypatch.setattr(PackedGraph, "search", None)
    monkeypatch.setattr(PackedGraph, "_in_step", None)
    assert [g.ids[at].tolist() for at, _ in g.search_many(x[:50], np.ones(400, bool), 10_000_000, 10)[0]] == [[i for _, i in found] for found in want]


def test_table_of_distances_builds_the_same_graph(monkeypatch):
    a = packed(diversify=True)[0]
    monkeypatch.setattr("nearfield.operators.graph.TABLE_NODES", 0)
    b = packed(diversify=True)[0]
    assert (a._links == b._links).all() and (a._extra == b._extra).all()


TARGETS = ["graph_target_recall_90", "graph_target_recall_99", "graph_target_recall_after_inserts"]


@pytest.mark.parametrize("name", TARGETS)
def test_truth_of_recall_targets_meets_in_blocks(spark, sf, name):
    nodes = evaluate.plan_nodes(q.QUERIES[name](spark, sf))
    assert "FlatMapCoGroupsInArrow" in nodes and not {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(nodes)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_rows_are_linked_together(monkeypatch, metric):
    """No row looks for its neighbours on a walk of its own: that took 6.6 s for 1,500 rows. A node
    keeps the nearest of those it chose and those that chose it, in whatever parts the rows came."""
    monkeypatch.setattr(ShardGraph, "_insert", None)
    monkeypatch.setattr(ShardGraph, "repair", lambda self: 0)
    o = IndexOptions(m=4, ef_construction=7, metric=metric)
    x = np.random.default_rng(5).normal(size=(300, 8))
    whole, parts = ShardGraph(o, 8, 1), ShardGraph(o, 8, 1)
    whole.add(range(300), [None, *range(299)], list(x))
    for at, to in ((0, 1), (1, 90), (90, 300)):
        parts.add(range(at, to), [None, *range(299)][at:to], list(x[at:to]))
    assert (whole.links, whole.extra, whole.entry, whole.members) == (parts.links, parts.extra, parts.entry, parts.members)
    links, extra = [[] for _ in x], [[] for _ in x]
    for n in range(300):
        near = whole.near(whole.vec[n], slice(n))
        found = sorted(zip(near.tolist(), range(n), strict=True))[:7]
        for lists, some in ((links, found[:4]), (extra, found[4:])):
            for d, i in some:
                lists[n].append((d, i))
                lists[i].append((d, n))
    assert [node[0] for node in whole.links] == [[i for _, i in sorted(row)[:4]] for row in links]
    assert whole.extra == [[i for _, i in sorted(row)[:4]] for row in extra]


@pytest.mark.parametrize("metric", ["l2", "sql2", "ip", "cosine", "l1"])
@pytest.mark.parametrize("shift, scale", [(0, 1), (1e6, 1), (0, 1e-22), (0, 1e18), (3, 1e-9)])
def test_nearest_measures_many_rows_again_at_once(monkeypatch, metric, shift, scale):
    """Not query by query, which was half of the time of a small shard; same rows where single precision can't tell them apart."""
    calls, plain = [], exact.distances_exact
    monkeypatch.setattr(exact, "distances_exact", lambda *a: calls.append(1) or plain(*a))
    x = shift + scale * np.random.default_rng(7).normal(size=(400, 16))
    x[50:60], x[60] = x[:10], np.nan
    ids, q = np.arange(400)[::-1].copy(), x[:300:3]
    among = np.arange(400)[None, :] % 7 > np.arange(len(q))[:, None] % 2
    for some in (None, among):
        calls.clear()
        got = exact.nearest(q, x, ids, 10, metric, some)
        assert len(calls) < 10
        for i, (places, far) in enumerate(got):
            d = plain(q[i], x, metric)
            d[np.isnan(d) | (False if some is None else ~some[i])] = np.inf
            best = np.lexsort((ids, d))[: min(10, np.isfinite(d).sum())]
            assert places.tolist() == best.tolist() and far.tolist() == d[best].tolist()


def test_pairs_of_blocks_are_spread_out(spark, sf):
    """A partition for about each pair: merged by size, few tasks had most pairs."""
    df = q.items(spark, sf)
    plan = exact.knn_batch(df, q.batch(df), 10, strategy="blocks")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_order_of_ties():
    """Places of equal distances come in their order, however the rows are sorted."""
    d = np.random.default_rng(2).integers(0, 40, (200, 300)).astype(float)
    d[::2] = np.random.default_rng(3).random((100, 300))
    d[5, 7] = np.nan
    assert (_order(d) == np.argsort(d, axis=1, kind="stable")).all()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_queries_expand_many_nodes_in_a_step(monkeypatch, metric):
    """A step for each expansion took most of graph_target_recall_99's and _after_inserts' time. The steps
    find what one expansion after the other does where vectors repeat, where a budget ends while the walk is
    still on its way to the query, and where queries are measured in several parts."""
    steps, plain = [], getattr(graph, "_packed", None)
    monkeypatch.setattr(graph, "_packed", lambda flags: steps.append(len(flags)) or plain(flags), raising=False)
    monkeypatch.setattr(graph, "STEP_PAIRS", 12 * 400)
    rng = np.random.default_rng(11)
    islands = np.repeat(rng.integers(-40, 40, (8, 16)), 50, axis=0) + rng.integers(0, 3, (400, 16))  # whole numbers: ties are ties however they are measured
    for x, options in ((rng.normal(size=(400, 16)), {"m": 16}), (islands[rng.permutation(400)], {"m": 3}), (np.repeat(rng.integers(-9, 9, (80, 16)), 5, axis=0), {"m": 4})):
        g = ShardGraph(IndexOptions(ef_construction=32, metric=metric, **options), 16, 1)
        g.add(range(400), [i % 100 for i in range(400)], list(x.astype(float)))
        row = pack(g)
        g = PackedGraph(g.o, row | {"row_id": np.array(row["row_id"]), "deleted": np.arange(400) % 9 == 0})
        q, passes = np.concatenate([x[::13], rng.integers(-30, 30, (9, 16))]).astype(float), np.arange(400) % 100 < 20
        for ef in (1, 2, 17, 60, 200, 399):
            steps.clear()
            many, count = g.search_many(q, passes, ef, 10)
            single = [g.search(v, passes, ef, 10) for v in q]
            assert [g.ids[at].tolist() for at, _ in many] == [[i for _, i in found] for found, _ in single]
            assert count == {c: sum(s[1][c] for s in single) for c in count}
    assert steps  # sets of nodes as bits, not one node after the other


def test_recall_reads_its_truth_once(spark):
    """It was searched twice: once to be counted, once to be joined."""
    truth = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 5), (3, None)], "qid long, id long")
    found = spark.createDataFrame([(1, 6), (1, 6), (1, 7), (4, 5)], "qid long, id long")
    seen = truth.mapInArrow(lambda batches: batches, "qid long, id long")
    out = evaluate.recall(found, seen.where("id IS NOT NULL"), 10, of_truth=True)
    assert evaluate.plan_nodes(out).count("MapInArrow") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0.5), (2, 0, 0.0)]
    assert sorted(map(tuple, evaluate.recall(found, seen, 10).collect())) == [(1, 1, 0.1), (2, 0, 0.0), (3, 0, 0.0)]


def test_task_keeps_the_k_best_of_its_shards(spark, sf, folder):
    """As the shards go by, not at the end: that sorted k rows of each query for each shard. A query id may
    come twice, a batch may be empty."""
    df = q.items(spark, sf)
    built = GraphIndex.build(df, folder, IndexOptions(build_seed=1, gamma=2, shard_rows=20))
    asked = q.batch(df)
    asked = asked.unionAll(asked.where("qid = 0"))
    rows = built.search_batch(asked, 5, F.col("filter_val") < 3, ef_search=10_000_000).select("qid", "row_id", F.round("d", 9)).distinct()
    want = exact.knn_batch(df, q.batch(df), 5, F.col("bucket") < 3, strategy="loop").select("qid", "id", F.round("d", 9))
    twice = lambda r: r[0] != 0
    assert sorted(map(tuple, filter(twice, rows.collect()))) == sorted(map(tuple, filter(twice, want.collect())))
    assert built.search_batch(asked.where("qid < 0"), 5).count() == 0


def test_bound_leaves_what_sorting_all_would():
    """Searching shards one after the other, with the bound of those before, gives the rows of one sort over all."""
    rng = np.random.default_rng(4)
    parts = [(np.sort(rng.integers(0, 30, 200)), rng.permutation(200) + 200 * i, rng.integers(0, 40, 200).astype(float)) for i in range(12)]
    top, sorted_rows = Best(30, 7), []
    for own, ids, d in parts:
        sorted_rows.append(top.add(own, ids, d))
    assert max(sorted_rows) <= 3 * 30 * 7
    for got, want in zip(top.rows(), _best(*map(np.concatenate, zip(*parts, strict=True)), 7), strict=True):
        assert (got == want).all()

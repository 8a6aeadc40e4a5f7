import zlib

import numpy as np
import pytest

from nearfield.llm.sharding import permute, shard_documents, shard_table, unpermute


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4096, 5000])
def test_permutation(n):
    x = np.arange(n)
    p = permute(x, n, 9)
    assert sorted(p) == list(range(n)) and (unpermute(p, n, 9) == x).all()
    if n > 1000:
        assert (permute(x, n, 10) != p).mean() > 0.9 and abs(np.corrcoef(x, p)[0, 1]) < 0.1


def test_table(spark):
    rows = [(i, "é" * (i % 5)) for i in range(1003)] + [(5, "é" * 0), (None, None), (None, "x"), (7000, "y" * 200000), (7001, None), (7001, None)]
    df = spark.createDataFrame([(*r, "a", 3) for r in rows], "doc_id long, text string, shard string, _p int")
    got = shard_table(df).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    p = permute(np.array([r.row_no for r in got]), len(got), 1)  # the place is computable
    assert [(int(x) % 8, int(x) // 8) for x in p] == [(r.shard, r.slot) for r in got]
    where = {(r.doc_id, r.size): (r.shard, r.slot) for r in got if r.doc_id not in (5, 7001, None)}
    again = {(r.doc_id, r.size): (r.shard, r.slot) for r in shard_table(df.repartition(7)).collect() if r.doc_id not in (5, 7001, None)}
    assert where == again
    full = shard_documents(df)
    assert set(full.columns) == {"doc_id", "text", "_p", "size", "text_crc32", "row_no", "shard", "slot"} and full.count() == len(rows)


def test_equal_rows_and_odd_columns(spark, monkeypatch):
    """Equal rows get places of their own, split over several buckets; columns may hold dots and maps."""
    monkeypatch.setattr("nearfield.llm.sharding.EQUAL_ROWS", 7)
    rows = [(1, "same", {"k": i}) for i in range(100)] + [(i, f"t{i}", {}) for i in range(50)] + [(None, None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>").repartition(5)
    full = shard_documents(df)
    assert full.columns == ["doc_id", "text", "a.b", "size", "text_crc32", "row_no", "shard", "slot"]
    got = full.collect()
    assert sorted(r.row_no for r in got) == list(range(len(rows)))
    assert sorted(repr(tuple(r)[:3]) for r in got) == sorted(map(repr, rows))
    assert len({(r.shard, r.slot) for r in got}) == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_table(df).collect() == [] and shard_documents(df).collect() == []

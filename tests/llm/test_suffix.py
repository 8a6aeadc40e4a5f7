import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from nearfield.llm.suffix import remove_repeats


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    w = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    base = [w(300) for _ in range(5)] + ["a" * 400, "ab" * 150]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.randrange(6)):
            b = rng.choice(base)
            at = rng.randrange(len(b))
            text += rng.choice([b[at : at + rng.randrange(300)], w(rng.randrange(40))])
        rows.append((i, text))
    return rows + [(7, None), (None, base[0]), (None, base[0]), (5, ""), (3, rows[3][1]), (9, "a" * 3000)]


@pytest.mark.parametrize("length", [20, 90, 200])
def test_against_brute_force(spark, length, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, th int, spans string")
    for block in (1 << 19, 700):
        monkeypatch.setattr("nearfield.llm.suffix.BLOCK", block)
        monkeypatch.setattr("nearfield.llm.suffix.BUCKET_ROWS", 2_000_000 if block > 700 else 300)
        found = remove_repeats(df, length).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute(rows, length)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)


def test_buckets_and_boundaries(monkeypatch):
    """Sorting in buckets gives what one sort gives, wherever the splitters fall."""
    import json

    import pyarrow as pa

    from pyspark import TaskContext

    from nearfield.llm.suffix import _bucket, across, multikey

    rng = np.random.default_rng(5)
    for n, top, buckets in ((300, 4, 7), (300, 40, 5), (200, 1, 9), (40, 3, 30), (1, 1, 3)):
        h, ctx, r = rng.integers(-top, top, n), rng.integers(0, 1 + top // 2, n), rng.permutation(n)
        order, common = multikey([h, ctx])
        rows = list(zip(h.tolist(), ctx.tolist(), strict=True))
        ranked = [rows[i] for i in order]
        assert ranked == sorted(rows) and [0, *(0 if x[0] != y[0] else 1 + (x == y) for x, y in zip(ranked, ranked[1:], strict=False))] == common.tolist()
        every = sorted(zip(h.tolist(), ctx.tolist(), r.tolist(), strict=True))
        splitters = sorted(every[i] for i in rng.integers(0, n, buckets))
        part = np.array([sum(s <= x for s in splitters) for x in zip(h.tolist(), ctx.tolist(), r.tolist(), strict=True)])
        made, notes = [], []
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            columns = [h[at], ctx[at], r[at], at, at, at]
            monkeypatch.setattr(TaskContext, "get", lambda p=p: SimpleNamespace(partitionId=lambda: int(p)))
            for batch in _bucket([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "ctx", "r", "a", "b", "c"])]):
                for x in batch.to_pylist():
                    notes.append(json.loads(x["note"])) if x["note"] else made.append(x)
        sides = {x[0]: x[1:] for x in across(sorted(notes, key=lambda x: x["part"]))}
        count, kinds = Counter(rows), {}
        for key in set(rows):
            kinds.setdefault(key[0], []).append(count[key])
        got = {}
        for x in made:
            same0, open0, same1, open1, goes_on = sides[x["part"]]
            same = same0 if x["edge"] & 4 else same1 if x["edge"] & 8 else x["same"]
            opened = open0 if x["edge"] & 1 else open1 if x["edge"] & 2 else x["open"]
            if same or opened:
                got[x["a"]] = (same, opened, x["first"] and not (x["edge"] & 4 and goes_on))
        expected = {i: (count[k] > 1, len(kinds[k[0]]) > 1 and min(kinds[k[0]]) == 1) for i, k in enumerate(rows)}
        assert {i: g[:2] for i, g in got.items()} == {i: e for i, e in expected.items() if any(e)}
        assert Counter(rows[i] for i, g in got.items() if g[2]) == Counter({rows[i] for i in got})


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []
    one = spark.createDataFrame([(1, "x" * 199), (2, None), (3, "short")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in remove_repeats(one).collect()} == {(1, 0, 0), (2, 0, 0), (3, 0, 0)}
    with pytest.raises(ValueError):
        remove_repeats(one, 5000)

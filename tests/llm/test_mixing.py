import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nearfield.llm.mixing import mix_documents, mix_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes):
    """Shares are dealt out until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


DOCS = [(i, "w " * (i % 17 + 1), f"s{i % 7}" if i % 3 else "s0") for i in range(600)] + [(700, None, "s1"), (701, "", None), (702, "a b c", None), (702, "a b c", None), (None, "x y", "Ä"), (703, "l " * 40, "zz"), (704, "", "empty")]


def queue(spark, docs):
    """(doc_id, source, size, taken) by serving each source word by word, in its hashed order."""
    sized = spark.createDataFrame([(i, s, len(WORD.findall(t or ""))) for i, t, s in docs], "doc_id long, source string, size long")
    hashed = [tuple(r) for r in sized.select("doc_id", "source", "size", F.xxhash64(F.lit("mixing"), "doc_id", "size", F.lit(0))).collect()]
    by, out = defaultdict(list), []
    for i, s, size, h in hashed:
        by[s].append((h, i if i is not None else -math.inf, size, i))
    sizes = {s: sum(x[2] for x in rows) for s, rows in by.items()}
    target = goals(sizes)
    words, finish = {s: math.floor(t + 1e-9) for s, t in target.items()}, []
    for no, s in enumerate(sorted(by, key=lambda s: (s is None, (s or "").encode()))):
        by[s].sort(key=lambda x: x[:2])
        end = 0
        for _, _, size, _ in by[s] * 3:
            end += size
            if end > words[s]:
                finish.append((end / target[s], no, s))
                break
    for _, _, s in sorted(finish)[: round(sum(target.values()) - sum(words.values()))]:
        words[s] += 1
    for s, rows in by.items():
        left, taken = words[s], [0] * len(rows)
        for k in [*range(len(rows))] * 3:
            part = min(left, rows[k][2])
            taken[k] += part
            left -= part
        out += [(x[3], s, x[2], t) for x, t in zip(rows, taken, strict=True)]
    return out, words, target


def made(df):
    return sorted(((r.doc_id, r.source, r.size, r.taken) for r in mix_table(df).collect()), key=repr)


MORE = [
    DOCS, [(1, "l " * 300_000, "a"), (2, "x", "b"), (3, "y", "b")], [(1, "w " * 1000, "a"), (2, "w " * 900, "b"), (3, "w " * 5, "c")],
    [(i, "w " * (1 + i * i % 31), f"s{i % 4}") for i in range(90)] + [(5, "same text", "s1")] * 40,
]


@pytest.mark.parametrize("docs", MORE)
def test_against_a_plain_queue(spark, docs):
    df = spark.createDataFrame([(*d, 1.0, "z") for d in docs], "doc_id long, text string, source string, target double, words string")
    got = mix_table(df).collect()
    expected, words, target = queue(spark, docs)
    assert made(df) == sorted(expected, key=repr) == made(df.repartition(5))
    taken, sizes = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3 and r.taken <= 3 * r.size
        assert (r.copies - 1) * r.size <= r.taken <= r.copies * r.size or not r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
    assert all(r.source_size == sizes[r.source] for r in got)
    assert +taken == Counter({s: w for s, w in words.items() if w}) and sum(taken.values()) == sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_equal_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr("nearfield.llm.mixing.EQUAL_ROWS", 7)
    docs = [(1, "a b c", "s")] * 100 + [(2, "d e", "s"), (3, "f " * 500, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix_table(df).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    target = goals({"s": 302, "t": 500})
    assert len(got) == 102 and all(abs(taken[s] - target[s]) <= 1 for s in target)
    words = Counter()
    for r in mix_documents(df).collect():
        words[r.source] += len(r.text.split())
    assert words == taken


@pytest.mark.parametrize("docs", MORE[:3])
def test_documents(spark, docs):
    df = spark.createDataFrame([(*d, 1, "z", {"k": "v"}) for d in docs], "doc_id long, text string, source string, _row int, copies string, `a.b` map<string,string>")
    out = mix_documents(df)
    assert out.columns == df.columns
    rows, texts = out.collect(), {}
    for i, t, s in docs:
        texts.setdefault((i, s), []).append(t)
    expected, found = Counter(), Counter()
    for r in mix_table(df).collect():
        expected[r.doc_id, r.source] += r.taken
    for r in rows:
        found[r.doc_id, r.source] += len(WORD.findall(r.text or ""))
        assert r["a.b"] == {"k": "v"} and any((t or "").startswith(r.text or "") for t in texts[r.doc_id, r.source])
    assert +found == +expected
    # The mix is in the order of finish times: every source is served at its rate all along.
    half, total = Counter(), Counter()
    for k, r in enumerate(rows):
        total[r.source] += len(WORD.findall(r.text or ""))
        if 2 * k < len(rows):
            half[r.source] += len(WORD.findall(r.text or ""))
    if docs is DOCS:
        assert all(abs(half[s] / sum(half.values()) - total[s] / sum(total.values())) < 0.1 for s in total)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_table(df).collect() == [] and mix_documents(df).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mix_table(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mix_documents(blank).collect() == []

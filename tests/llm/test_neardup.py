import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import neardup
from nearfield.llm.neardup import M, near_duplicates, one_of_each, super_minhash


def sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, percent=85):
    s = sets(rows)
    ids, root = sorted(s), {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    post = defaultdict(list)
    for i in ids:
        for x in s[i]:
            post[x].append(i)
    both = Counter((a, b) for p in post.values() for k, a in enumerate(p) for b in p[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * len(s[a] | s[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(4))
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([3, 40])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), rows[0].replace(" ", "\n\t "), "one two", "ONE  two", "one two three four five", "", " ", None, "x " * 30000, "x " * 20000]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, keys string")
    for chunk in (800, 7):
        monkeypatch.setattr("nearfield.llm.neardup.CHUNK", chunk)
        found = near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute(rows).items() if i == c)


def balls(rng, n):
    """Near copies of two templates, some so far from them that only a chain links them, and others between."""
    rows = []
    for size in (60, 90):
        base = [f"{size}t{j}" for j in range(size)]
        for _ in range(n):
            w, at = list(base), rng.randrange(size)
            for k in range(rng.choice([0, 1, 1, 2, 3, 4, 9])):
                w[(at + k) % size] = f"x{rng.randrange(30)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_rounds_of_leaders(spark, monkeypatch):
    """Large clusters are taken apart in rounds; no link is lost, and copies aren't paired."""
    rows = balls(random.Random(2), 200)
    monkeypatch.setattr(neardup, "CHUNK", 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == expected


def test_many_different_copies_cost_a_row_each(spark, monkeypatch):
    """A group of near copies of one template: rounds leave little of it for pairs."""
    base = [f"t{j}" for j in range(200)]
    rows = [(i, " ".join(base[: i % 200] + [f"x{i}"] + base[i % 200 + 1 :])) for i in range(3000)]
    met, real = [], neardup._pairs
    monkeypatch.setattr(neardup, "CHUNK", 100)
    monkeypatch.setattr(neardup, "_pairs", lambda state, *rest: met.append(state.count()) or real(state, *rest))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(met) < len(rows)


def test_one_doc_id_with_two_texts(spark):
    """They are one document for the links, two rows for the choice of one of each."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, "other words of a text by itself"), (5, "quite other words of a text"), (None, a + " more"), (None, a + " more"), (None, "no one else has this text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (df.orderBy(F.desc("text")),):
        got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(d).collect())
        assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (5, 5, True), (None, 1, False), (None, 1, False), (None, None, True)])
        kept = sorted(map(tuple, one_of_each(d).collect()), key=repr)
        assert kept == sorted([rows[0], rows[1], rows[4], rows[5], rows[8]], key=repr)


def test_defined_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None), (3, ""), (4, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 1, False)])
    assert sorted((str(r.doc_id) for r in one_of_each(df).collect())) == ["1", "2", "3", "None"]
    assert near_duplicates(df.limit(0)).collect() == [] and one_of_each(df.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.3, 0.85])
def test_signature_estimates_similarity(share):
    rng = np.random.default_rng(3)
    found = []
    for n in (5, 60, 900):
        pairs = []
        for _ in range(60):
            both = round(2 * n * share / (1 + share))
            x = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            pairs += [x[:n], x[n - both :]]
        sig = super_minhash(pairs)
        assert sig.shape == (120, M) and (sig < 2**62).all()
        exact = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        found.append(abs(np.mean((sig[::2] == sig[1::2]).mean(axis=1) - exact)))
    assert max(found) < 0.03

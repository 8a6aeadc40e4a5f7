import hashlib
import random
import re

import pytest

from nearfield.llm.decontaminate import clean_documents, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(docs, items):
    out, windows = [], {}
    for item, t in items:
        b = words(t)
        n = min(len(b), 13)
        for i in range(len(b) - n + 1) if b else ():
            windows.setdefault(n, {}).setdefault(tuple(b[i : i + n]), set()).add(item)
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n, known in windows.items():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit |= set(range(j, j + n))
                    found |= {str(x) for x in known[tuple(w[j : j + n])] if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [
    (1, f"x y {LONG} z"), (2, LONG.upper()), (3, None), (4, ""), (5, "?!"), (6, "w1 w2 w3"), (7, "Ä Ö straße, w5, w6 w7; w8"), (7, "Ä Ö straße, w5, w6 w7; w8"), (None, LONG), (None, None),
    (8, " ".join(f"w{i}" for i in range(12))), (9, ("q " * 3000) + LONG + " q" * 3000), (10, "a a a a a a a a a a a a a a a a"), (11, "one two three four five six seven"), (12, "ÄÖ ÄÖ"), (13, "äö äö"),
]
ITEMS = [(1, LONG), (2, " ".join(f"w{i}" for i in range(5, 25))), (10, "w5 w6 w7"), (20, "a a a a a a a a a a a a a"), (21, ""), (22, None), (None, "one two three four"), (23, "four five six seven"), (23, "four five six seven"), (24, "ÄÖ"), (25, "w1 w2 w3 w4 w5 w6 w7 w8")]


def run(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*d, "c", 1) for d in DOCS], "doc_id long, text string, hs string, n_words int")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    assert run(decontaminate(docs, items)) == brute(DOCS, ITEMS)
    kept = [r.doc_id for r in clean_documents(docs, items).collect()]
    bad = {d[0] for d in brute(DOCS, ITEMS) if d[-1]}
    assert sorted(map(str, kept)) == sorted(str(d[0]) for d, row in zip(DOCS, DOCS, strict=True) if not (d[0] in bad and d[0] is not None) and d != (None, LONG))


@pytest.mark.parametrize("hot", [64, 1])
def test_random_texts(spark, monkeypatch, hot):
    """Texts of few different words: many fingerprints are equal, in items of all lengths."""
    monkeypatch.setattr("nearfield.llm.decontaminate.HOT", hot)
    rng = random.Random(4)
    text = lambda n, top: " ".join(f"w{rng.randrange(top)}" for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 7, 8, 10, 12, 13, 14, 20, 40]) if i % 3 else 30, 3 if i % 2 else 40)) for i in range(60)]
    docs = [(i, text(rng.randrange(60), 3 if i % 2 else 40)) for i in range(80)]
    for i in range(60):
        w = items[rng.randrange(60)][1].split()
        at = rng.randrange(len(w))
        docs.append((100 + i, " ".join([text(rng.randrange(9), 40), *w[at : at + rng.randrange(5, 30)], text(rng.randrange(9), 40)])))
    for some in (items, [x for x in items if len(x[1].split()) >= 13], [x for x in items if 7 <= len(x[1].split()) < 13]):
        got = run(decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string")))
        assert got == brute(docs, some)


def test_fingerprints_are_thinned(spark):
    """Of long texts about two in eight grams leave, not one for each window."""
    from nearfield.llm.decontaminate import _places, _words

    rng = random.Random(4)
    df = spark.createDataFrame([(1, " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000)))], "doc_id long, text string")
    found = _places(_words(df, ["doc_id"]), ["doc_id"], {7: 7}, 13).select("at").collect()
    assert 900 < len(found) < 1100 and max(b.at - a.at for a, b in zip(found, found[1:], strict=False)) <= 7


@pytest.mark.parametrize("d, i", [([], ITEMS), (DOCS, []), (DOCS, [(1, None)]), ([], [])])
def test_empty(spark, d, i):
    docs, items = spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(i, "item_id long, text string")
    assert run(decontaminate(docs, items)) == brute(d, i)


def test_main_path_is_native(spark, sf):
    from nearfield.llm.queries import op1_decontaminate

    plan = op1_decontaminate(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm.langid import ORDER, SPACE, Model, known_language, predict, train

TEXTS = {"aa": ["the cat sat on the mat", "that hat, the CAT"], "bb": ["el gato está aquí", "está el gato"]}


def slow_bits(texts, symbols, size, context_ok):
    """Code lengths by the definition, symbol by symbol."""
    counts = {}
    for t in texts:
        for i in range(ORDER, len(t)):
            for d in range(ORDER + 1):
                c = tuple(t[i - d : i].tolist())
                counts.setdefault(c, {}).setdefault(int(t[i]), 0)
                counts[c][int(t[i])] += 1

    def p(c, s):
        lower = p(c[1:], s) if c else 1 / size
        if not context_ok(c) or c not in counts:
            return lower
        n, t = sum(counts[c].values()), len(counts[c])
        return counts[c][s] / (n + t) if s in counts[c] else t / (n + t) * lower

    return sum(-math.log2(p(tuple(symbols[i - ORDER : i].tolist()), int(symbols[i]))) for i in range(ORDER, len(symbols)))


def test_code_lengths():
    m = Model(TEXTS)
    trained = {lang: [np.concatenate([m.symbols(t.encode(), True) for t in TEXTS[lang]])] for lang in m.langs}

    def seen(c):
        return max(sum(tuple(t[i - len(c) : i].tolist()) == c for i in range(ORDER, len(t))) for ts in trained.values() for t in ts)

    def ok(c):
        return len(c) == 0 or all(seen(c[k:]) >= 2 for k in range(len(c)))

    for text in ("the gato ZZ", "está", "q"):
        s = m.symbols(text.encode(), True)
        got = m.lengths([s])[0]
        assert got == pytest.approx([slow_bits(trained[lang], s, m.size, ok) for lang in m.langs], rel=1e-4)
    assert (m.symbols(b"A  1, b") == [1, SPACE, 2]).all()
    assert [x[0] for x in m.score(["the cat", "el gato", None, "", "12 !", "日本"])] == ["aa", "bb", "und", "und", "und", m.score(["日本"])[0][0]]
    long = "the cat " * 200_000
    assert m.score([long])[0][:2] == ("aa", 1.0)
    assert [x[:2] for x in m.score(["½ ②", "² ③ Ⅷ", "ªb", "ʰ"])[:2]] == [("und", 0.0)] * 2 and m.score(["ʰ"])[0][0] != "und"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet")
    got = predict(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n, low, high = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right > 0.99 and n > 3000 and 0 <= low <= high <= 1
    assert {r.doc_id for r in got.where("held_out").select("doc_id").limit(50).collect()} <= {i for i in range(10**5) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_training_leaves_out_held_out_rows(spark):
    rows = [(i, "zzz zzz" if zlib.crc32(str(i).encode()) % 3 == 1 else "aaa bbb", "xx") for i in range(60)] + [(None, "ccc", "yy"), (61, None, "zz"), (62, "q", None)]
    m = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(m.langs) <= {"xx"} and m.lengths([m.symbols(b"aaa bbb", True)])[0][0] < m.lengths([m.symbols(b"zzz zzz", True)])[0][0]


def test_defined_cases(spark):
    rows = [(i, f"the cat {i}", "en") for i in range(9)] + [(20, None, "en"), (21, "", "en"), (22, "123", None), (None, "the cat", None), (23, "the cat", None), (23, "the cat", None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = sorted(((r.doc_id is None, r.doc_id, r.lang_pred) for r in predict(df).collect()), key=repr)
    assert got == sorted(((i is None, i, "en" if t and "cat" in t else "und") for i, t, _ in rows), key=repr)
    kept = known_language(df)
    assert kept.columns == df.columns and kept.count() == 12
    assert predict(df.limit(0)).collect() == [] and known_language(df.limit(0)).collect() == []
    assert {r.lang_pred for r in predict(df.where("lang IS NULL")).collect()} == {"und"}


def test_repeated_ids_and_many_languages(spark):
    """A doc_id repeated often takes one place of the sample, and every language is learned."""
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(free[0], "one text again and again", "aa")] * 50_000
    rows += [(free[k], f"{chr(0x4E00 + k) * 5} word", f"l{k:03}") for k in range(1, 161)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, rows=2)
    assert model.langs == ["aa", *(f"l{k:03}" for k in range(1, 161))]
    assert np.array_equal(model.cost, train(df.repartition(7), rows=2).cost)
    rows = [(free[0], "the same", "aa")] * 5 + [(free[k], "wwwwww", "aa") for k in range(1, 4)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=4)
    only = Model({"aa": ["the same"] + ["wwwwww"] * 3})
    assert np.array_equal(model.cost, only.cost)


def test_nothing_learned_keeps_texts(spark):
    rows = [(1, "some text", None), (2, "123", None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [tuple(r) for r in known_language(df).collect()] == [rows[0]]


def test_sample_is_bounded(spark):
    """A very long text gives a stretch of it; of many documents the sample has its rows, whatever their partitions."""
    from nearfield.llm import langid

    free = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    seen = []
    real, langid.Model = langid.Model, lambda samples: seen.append(samples)
    try:
        df = spark.createDataFrame([(i, f"a{i} " * (100 if k else 300_000), "xx") for k, i in enumerate(free)], "doc_id long, text string, lang string")
        for parts in (1, 16):
            train(df.repartition(parts), rows=20, chars=500)
        train(df.limit(1), rows=20, chars=500)
    finally:
        langid.Model = real
    assert seen[0].keys() == {"xx"} and sorted(seen[0]["xx"]) == sorted(seen[1]["xx"]) and len(seen[0]["xx"]) == 20
    assert all(len(t) <= 500 for t in seen[0]["xx"]) and [len(t) for t in seen[2]["xx"]] == [500]


def test_texts_in_no_learned_language_go(spark):
    """What no model codes shorter than no model is rejected."""
    rng = np.random.default_rng(1)
    rows = [(i, "the cat sat on the mat and that was that", "en") for i in range(30)]
    rows += [(100 + i, "".join(rng.choice(list("qxzjkvwüÿ01"), 60)), "en" if i else None) for i in range(3) if zlib.crc32(str(100 + i).encode()) % 3 == 1 or not i]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in known_language(df).collect()} == set(range(30))

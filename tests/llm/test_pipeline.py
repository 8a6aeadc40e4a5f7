import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from nearfield.llm import queries
from nearfield.llm.langid import train
from test_decontaminate import brute as contamination
from test_mixing import goals
from test_neardup import brute as groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(900_001, "12 34", "en", "src0", 5), (900_002, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "tokens"]
    took = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        out = stage(spark, docs, sf)
        took[name] = (before, [tuple(r) for r in out.collect()])
        if name != "tokens":
            assert out.columns == COLUMNS
            docs = spark.createDataFrame(took[name][1], docs.schema)
    before, after = took["language_id"]
    m = train(spark.createDataFrame(before, docs.schema))
    scored = [(r, *m.score([r[1]])[0]) for r in before]
    assert sorted(after, key=repr) == sorted((r for r, lang, score, gain in scored if lang != "und" and score >= 0.5 and gain > 0), key=repr) and len(after) <= len(before) - 2
    before, after = took["near_duplicates"]
    root = groups([r[:2] for r in before], 80)
    assert sorted(after) == sorted(r for r in before if root[r[0]][1] == r[0]) and len(after) < len(before)
    before, after = took["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in contamination([r[:2] for r in before], items) if r[-1]}
    assert sorted(after) == sorted(r for r in before if r[0] not in bad) and bad
    before, after = took["mixing"]
    sizes = {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    whole = {(r[0], r[2], r[3]): r[1] for r in before}
    assert all(whole[r[0], r[2], r[3]].startswith(r[1]) for r in after)
    target = goals(sizes)
    for s in sizes:
        assert abs(sum(len(r[1].split()) for r in after if r[3] == s) - target[s]) <= 1
    before, after = took["tokens"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r[0], r[2]) for r in after) == sorted((r[0], len(plain.encode(r[1], add_special_tokens=False).ids) + 1) for r in before)
    assert sorted(r[1] for r in after) == [0, *np.cumsum([r[2] for r in sorted(after, key=lambda r: r[1])])[:-1].tolist()]


def test_run(spark, sf):
    from nearfield.llm.common import shared_dir

    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    tables = lambda: {str(f.getPath().getName()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    before = tables()
    out = corpus_pipeline.run(spark, sf)
    assert len(tables() - before) <= 4  # what the last stage reads
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_registered():
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found, key=repr)


def test_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids, null texts, extra columns and empty tables pass through all stages."""
    rows = [(None, "the cat sat on the mat and so on and on", "en", "a", 1), (None, "the cat sat on the mat and so on and on", "en", "a", 1), (7, "one text of words that no one else has", "en", None, 1), (7, "another text which shares that doc_id only", "en", "b", 1), (8, None, None, None, None), (9, "", "en", "a", 0), (10, "12 34", "en", "a", 5)]
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` map<string,int>")
    spark.createDataFrame([(1, "quite other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            if name != "tokens":
                assert out.columns == docs.columns
                d = spark.createDataFrame(out.collect(), docs.schema)
            if name == "near_duplicates":
                assert sorted((r.text for r in out.collect())) == (sorted(r[1] for r in rows[1:4]) if start is docs else [])
        assert out.count() == d.count()

"""Beyond the sizes that are broadcast, operators join by shuffles; results stay."""

import test_decontaminate as t1
import test_neardup as t5
import test_suffix as t9

from nearfield.llm import decontaminate, html_main, neardup, suffix


def test_decontaminate(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(decontaminate, "SIEVE_WORDS", 1)
    docs, items = spark.createDataFrame(t1.DOCS, "doc_id long, text string"), spark.createDataFrame(t1.ITEMS, "item_id long, text string")
    assert t1.run(decontaminate.decontaminate(docs, items)) == t1.brute(t1.DOCS, t1.ITEMS)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 2000)
    rows = t5.corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == t5.brute(rows)


def test_html(spark, monkeypatch):
    monkeypatch.setattr(html_main, "BROADCAST_ROWS", -1)
    rows = [(i, f"http://h.net/{i}", f"<div class=k>Welcome</div><div class=m>story {i}</div>") for i in range(20)]
    assert {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {i: f"story {i}" for i in range(20)}


def test_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", -1)
    rows = t9.corpus()
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 90, texts=False).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == t9.brute(rows, 90)

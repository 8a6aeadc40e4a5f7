"""The operators as queries over the test tables, and SQL for those it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.decontaminate import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.urls import judge_urls

    return judge_urls(read(spark, sf_dir, "pages")).drop("by_alias")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.mixing import mix_table

    return mix_table(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.html_main import extract

    return extract(read(spark, sf_dir, "pages"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from nearfield.llm.tokens import token_output

    return token_output(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.sharding import shard_table

    return shard_table(read(spark, sf_dir, "documents")).drop("row_no")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.suffix import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), texts=False).drop("kept", "spans")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.langid import predict

    return predict(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_topk, op3_urls, op4_mix, op5_near_duplicates, op6_html, op7_tokens, op8_shard, op9_repeats, op10_langid)}

WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
        b AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS span
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
        spans AS (SELECT DISTINCT span FROM iw),
        dw AS (SELECT doc_id, i, span, array_to_string(w[i : i + span - 1], ' ') AS win
               FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)),
        hit AS (SELECT doc_id, i, dw.span, item_id FROM dw JOIN iw USING (win, span)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM (SELECT DISTINCT doc_id, i, span FROM hit)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op3_urls": r"""
        WITH RECURSIVE p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS rest FROM pages),
        n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS node FROM p),
        tags AS (SELECT node AS a, host, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM n WHERE node IS NOT NULL),
        named AS (SELECT a, host, CASE WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                  WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS too FROM tags),
        target AS (SELECT a, CASE WHEN contains(too, '://') THEN too WHEN starts_with(too, '//') THEN 'http:' || too WHEN starts_with(too, '/') THEN 'http://' || host || too
                   ELSE 'http://' || regexp_replace(a, '[^/]*$', '') || too END AS url FROM named WHERE too <> ''),
        e0 AS (SELECT a, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS r FROM target),
        e AS (SELECT a, h || CASE WHEN r = '' THEN '/' ELSE r END AS b FROM e0 WHERE h <> ''),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
        rules(rule, host, path, says) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        urls AS (SELECT DISTINCT host, path FROM n UNION SELECT split_part(b, '/', 1), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM reach),
        fit AS (SELECT urls.host, urls.path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM urls JOIN rules ON (urls.host = rules.host OR ends_with(urls.host, '.' || rules.host)) AND starts_with(urls.path, rules.path) GROUP BY ALL),
        bad AS (SELECT DISTINCT reach.a FROM reach JOIN fit ON split_part(b, '/', 1) = fit.host AND regexp_extract(b, '^[^/?]*([^?]*)', 1) = fit.path WHERE says = 'block')
        SELECT page_id, n.host, n.path, rule, coalesce(says, CASE WHEN node IN (FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
        FROM n LEFT JOIN fit ON n.host = fit.host AND n.path = fit.path""",
}

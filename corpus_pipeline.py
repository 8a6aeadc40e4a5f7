"""A training-corpus pipeline: each stage applies one operator to all that the
stage before it kept; between stages the documents are a written table.

Stages: rows in no learned language go, as do those whose language is less likely
than all others together; one document of each near-duplicate group (five-word
shingles, similarity of 0.8 or more) stays; contaminated documents go; documents
are repeated, left out or, at their source's cut, truncated so that the sources
meet their target weights; the rest is tokenised into wavelet matrix shards. The
last stage returns what is read back from the shards, all others documents.

Defined cases: rows are taken for themselves, so different texts that share a
doc_id, or have none, are different documents, and rows that repeat each other
are near-duplicates; null, empty and letterless texts go in the first stage; a
null source is a source, the last one; empty tables pass through all stages;
extra columns, of any name and type, are carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, langid, mixing, neardup, tokens
from nearfield.llm.common import materialize, read, scratch

PERCENT = 80
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_output(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: No stage but decontamination can be put in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:  # a stage's own tables go when it is written, and its input with them
            docs, path = materialize(stage(spark, docs, sf_dir), name)
            made.remove(path.rsplit("/", 1)[0])
            made.extend([last] if last else [])
        last = path.rsplit("/", 1)[0]
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages over ``documents``.

``toxicity`` drops documents that score as toxic, ``ngram_join`` leaves one
document of each near-duplicate class, ``decontaminate`` takes benchmark passages
out and drops documents that are mostly benchmark, ``secrets`` masks secrets in
the texts, ``mixing`` takes documents up to each source's target, as often as the
mix holds them (the added column ``mix_copy`` numbers the copies).

Every stage keeps the columns of its input, works on all rows of it, and leaves
clean documents as they are.

Defined results: null and empty texts are kept by all stages but ``ngram_join``,
which leaves one of them, and ``mixing``, which takes texts without words 0 times;
documents with a null id pass ``ngram_join`` as they are; rows equal in id and
text become one there, unlike texts under one id stay apart; very long texts are
read whole; ties in ``mixing`` go by the row's content; empty tables give empty
outputs; extra columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, mixing, ngram_join, secrets_crf, toxicity
from corpusloom.llm.common import removed, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.accepted(docs, toxicity.learn(docs, labels))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_crf.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_class),
    ("decontaminate", remove_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The stages' models and automata have no SQL; tests/llm hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, folder = written(stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)  # nothing reads the stage before any more
        before = folder
    return docs

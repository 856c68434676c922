"""Builds the search index of a document table, by language, and answers a table of standing questions from it.

    python -m jobs.search_index DOCUMENTS QUESTIONS OUT [--config FILE]

writes

    OUT/index/lang=xx/part=NN    a row a term and block: documents, weights, largest weight
    OUT/answers/shard=NN         the k best documents of each question over all languages

The index is written with dynamic partition overwrite: a run over documents of one
language replaces that language's folders and leaves the others', and a run over
the same rows gives the same rows.  A part that a smaller table no longer fills
would keep its old rows, so each part of a language gets one row without a term,
which readers leave out.  Answers are written anew by each run.

Questions are those whose id ``every`` divides, against all documents; only blocks
that can hold one of the k best are scored.  Documents without an id are left out,
null and empty texts have no terms; documents of no language (null or blank) are one more language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import postings, retrieval

from .common import LOG, main

NAME = "search_index"
#: Folders of answers.
SHARDS = 4


def read_index(spark: SparkSession, out: str, schema=None) -> DataFrame:
    """The index as it stands, of all languages; a block is named by its language and number."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{out}/index").where(F.col("term").isNotNull())


def build(spark: SparkSession, documents: str, out: str, conf: dict) -> DataFrame:
    table = spark.read.parquet(documents)
    docs = table.select(F.col(conf["id"]).alias("id"), F.col(conf["text"]).alias("text"), F.nullif(F.col(conf["lang"]).cast("string"), F.lit("")).alias("lang")).where(F.col("id").isNotNull())
    rows = postings.parted(postings.build(docs, "id", "text", conf["docs_in_block"], by="lang"), conf["parts"])
    parts = docs.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(conf["parts"] - 1))).alias("part"))
    whole = rows.unionByName(parts, allowMissingColumns=True)
    # few and even files: large parts are split, small ones put together
    whole.hint("rebalance", "lang", "part").write.partitionBy("lang", "part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{out}/index")
    index = read_index(spark, out, whole.schema)
    LOG.info("index: read %d documents of %s, %s/index now has %d rows of terms and blocks", table.count(), documents, out, index.count())
    return index


def answer(spark: SparkSession, index: DataFrame, questions: str, out: str, conf: dict) -> DataFrame:
    asked = spark.read.parquet(questions).where(F.col(conf["question_id"]) % conf["every"] == 0)
    terms = retrieval.term_weights(asked, conf["question_id"], conf["question_text"], "query_id")
    named = index.withColumn("block", F.concat_ws(":", F.coalesce("lang", F.lit("")), F.col("block").cast("string")))
    best = postings.search(terms, named, conf["k"], conf["parts"])
    best.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(SHARDS)).cast("int")).write.partitionBy("shard").mode("overwrite").parquet(f"{out}/answers")
    answers = spark.read.schema(best.schema).parquet(f"{out}/answers").select(*best.columns)
    LOG.info("answers: read %d questions of %s, wrote %d rows to %s/answers", asked.count(), questions, answers.count(), out)
    return answers


def run(spark: SparkSession, documents: str, questions: str, out: str, conf: dict) -> DataFrame:
    """Index and answers as they stand after the run, told apart by ``kind``."""
    index = build(spark, documents, out, conf)
    answers = answer(spark, index, questions, out, conf)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    shown = index.select(F.lit("index").alias("kind"), "lang", "term", "block", "n", "max_weight", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), joined("weights").alias("weights"))
    return shown.unionByName(answers.withColumn("kind", F.lit("answer")), allowMissingColumns=True)


if __name__ == "__main__":
    main(NAME, ["documents", "questions", "out"], run)

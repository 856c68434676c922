"""Indexes a folder of documents as it grows: chunks with their contexts, for new and changed documents only.

    python -m jobs.index_documents DOCUMENTS OUT CHECKPOINT [--config FILE]

DOCUMENTS is a folder of Parquet files (or one file).  Each run takes the files
that came since the last one (a file stream that ends when all are taken; its
checkpoint is the mark), leaves out documents whose text is indexed already,
chunks the others and writes

    OUT/chunks/batch=N/lang=xx    the chunks of what was new or changed in batch N
    OUT/indexed/batch=N           their ids and the hashes of their texts

A batch's folders carry its number, and what is known is read from lower numbers
only, so a batch that is run again after a failure finds what it found before and
replaces what it wrote.  ``indexed`` is written last: chunks that it doesn't name
aren't shown.  ``current`` gives the chunks of each document's last version.

Texts are read twice and never shuffled: which rows are new is found from ids and
hashes, and only the places (file and row) of rows to leave out meet the texts.

A document that comes again with another text counts by its last batch; of several
texts under one id in a batch the one with the largest hash counts.  Documents
without an id are left out and counted in the log; an empty or null text has no
chunks, so that those of an earlier version go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.sources import scratch
from corpusloom.streaming.watch import arrivals

from .common import LOG, main

NAME = "index_documents"
INDEXED = "doc string, hash string, batch long"
CHUNKS = f"{chunking.CHUNKS}, title string, context string, batch long, lang string"


def indexed(spark: SparkSession, out: str) -> DataFrame:
    """The state: one row for each time that a document was new or changed."""
    path = f"{out}/indexed"
    return spark.read.schema(INDEXED).parquet(path) if scratch.exists(spark, path) else spark.createDataFrame([], INDEXED)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the last version of each document: those of all batches that have ended, without the versions that later ones replace."""
    path = f"{out}/chunks"
    chunks = spark.read.schema(CHUNKS).parquet(path) if scratch.exists(spark, path) else spark.createDataFrame([], CHUNKS)
    state = indexed(spark, out).select(F.col("doc").alias("source_file_id"), "batch")
    last = state.groupBy("source_file_id").agg(F.max("batch").alias("last"))
    replaced = state.join(last, "source_file_id").where("batch < last").select("source_file_id", "batch")
    # a number a run, sent to all: dealt by batch, the chunks of a large one would be one task's
    return chunks.join(F.broadcast(state.select("batch").distinct()), "batch", "left_semi").join(replaced, ["source_file_id", "batch"], "left_anti")


def documents(batch: DataFrame, conf: dict) -> DataFrame:
    """``doc, text, lang, title, hash`` of a batch's rows, and the place of each (``file``, ``row``)."""
    text = F.coalesce(F.col(conf["text"]), F.lit(""))
    return batch.select(F.col(conf["id"]).cast("string").alias("doc"), text.alias("text"), F.col(conf["lang"]).alias("lang"), F.col(conf["title"]).alias("title"), F.sha2(text, 256).alias("hash"), "file", "row")


def chunked(rows: DataFrame, page_break: str) -> DataFrame:
    """The chunks that are indexed, with the line that says where each stands."""
    pages = F.transform(F.split("text", page_break), lambda x, i: F.struct((i + 1).alias("page"), x.alias("text")))
    none = F.lit(None).cast("string")
    context = T.context_line(F.col("title"), none, none, F.col("page_number"), F.lit(None).cast("int"), F.concat("source_file_id", F.lit(".txt")))
    chunks = chunking.chunk(rows.select(F.col("doc").alias("source_file_id"), pages.alias("pages"), "lang", "title"), indexed=True, carried=("title",))
    return chunks.withColumns({"context": context, "lang": F.col("language_detected")})


def work(batch: DataFrame, number: int, out: str, conf: dict) -> None:
    """One batch: what is new in it, to its folders."""
    spark = batch.sparkSession
    known = indexed(spark, out).where(F.col("batch") < number).groupBy("doc").agg(F.max_by("hash", "batch").alias("hash"))
    own = scratch.folder(spark, f"{NAME}-batch")
    rows = documents(batch, conf)
    places = scratch.stored(rows.select("doc", "hash", "file", "row"), "places", within=own)
    best = places.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.max(F.struct("hash", "file", "row")).alias("b")).select("doc", "b.*")
    fresh = scratch.stored(best.join(known, ["doc", "hash"], "left_anti"), "fresh", within=own)
    others = scratch.stored(places.join(fresh, ["file", "row"], "left_anti").select("file", "row"), "others", within=own)
    chunks = chunked(rows.join(others, ["file", "row"], "left_anti"), conf["page_break"])
    chunks.write.partitionBy("lang").mode("overwrite").parquet(f"{out}/chunks/batch={number}")
    fresh.select("doc", "hash").write.mode("overwrite").parquet(f"{out}/indexed/batch={number}")
    read = places.agg(F.count("*").alias("n"), F.count_if(F.col("doc").isNull()).alias("nameless")).first()
    written = spark.read.schema(CHUNKS).parquet(f"{out}/chunks/batch={number}").count()
    LOG.info("batch %d: read %d rows (%d without an id), indexed %d new or changed documents, wrote %d chunks to %s", number, read.n, read.nameless, fresh.count(), written, out)
    scratch.drop(spark, own)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, conf: dict) -> DataFrame:
    """Takes what is new in ``source``, waits for it, and returns ``current``."""
    new = arrivals(spark, scratch.streamable(spark, source), conf["schema"], conf["files_per_batch"]).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    stream = new.writeStream.foreachBatch(lambda batch, number: work(batch, number, out, conf)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("%s: %d batches in all", out, indexed(spark, out).agg(F.count_distinct("batch")).first()[0])
    return current(spark, out)


if __name__ == "__main__":
    main(NAME, ["source", "out", "checkpoint"], run)

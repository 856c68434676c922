"""Extraction runs: what is sent, what comes back, what is written down for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import eras

from .entities import cleaned
from .rewrites import last_wins

SUGGESTED = ("suggested_schools", "suggested_cognitive_tags", "suggested_math_tags", "suggested_domain_tags", "suggested_pipeline_flags")


def entries(files: DataFrame) -> DataFrame:
    """The state entry of each file: ``path``, ``found`` (the file is there), ``text``, ``raw`` (the answer) → status, counts, persons, eras."""
    c = cleaned(F.col("raw"))
    out = files.withColumn("c", c)
    error = F.when(~F.col("found"), "file not found").when(F.coalesce(F.col("text"), F.lit("")) == "", "no text extracted").when(F.col("c").isNull(), "api call failed")
    persons = F.coalesce("c.persons", F.array().cast(out.schema["c"].dataType["persons"].dataType))
    relations = F.coalesce("c.relationships", F.array().cast(out.schema["c"].dataType["relationships"].dataType))
    labels = F.array_sort(F.filter(F.transform(persons, lambda p: eras.label(p["calculus_number"])), lambda x: x.isNotNull()))
    counts = F.map_from_entries(F.transform(F.array_distinct(labels), lambda e: F.struct(e, F.size(F.filter(labels, lambda x: x == e)))))
    ok = error.isNull()
    return out.select(
        "path", F.when(ok, "complete").otherwise("error").alias("status"), F.when(ok, F.size(persons)).otherwise(0).alias("objects_extracted"), F.when(ok, F.size(relations)).otherwise(0).alias("relationships_extracted"),
        F.when(ok, persons).alias("persons"), F.when(ok, relations).alias("relationships"), F.when(ok, counts).alias("era_distribution"), error.alias("error"),
    )


def retried(state: DataFrame, done: DataFrame) -> DataFrame:
    """New entries with their number of failures: one more than before for an error, none for a success."""
    before = state.select("path", F.coalesce("retry_count", F.lit(0)).alias("__n"))
    return done.join(before, "path", "left").withColumn("retry_count", F.when(F.col("status") == "error", F.coalesce("__n", F.lit(0)) + 1).otherwise(0)).drop("__n")


def result_edges(results: DataFrame) -> DataFrame:
    """One edge a relation of each result (``name``, ``relations``), with defaults; the layer is always ``ai_hypothesis``."""
    r = results.select("name", F.inline("relations"))
    return r.select(F.col("name").alias("source"), "target", "relation_type", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("confidence", F.lit("medium")).alias("confidence"), "evidence_type", "provenance", F.lit("ai_hypothesis").alias("assertion_layer"))


def tag_records(results: DataFrame, fields: tuple[str, ...] = SUGGESTED) -> DataFrame:
    """The suggested tags of each result that has any."""
    here = [f for f in fields if f in results.columns]
    some = F.lit(False)
    for f in here:
        some = some | (F.coalesce(F.size(f), F.lit(0)) > 0)
    return results.where(some).select("name", *(F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f) for f in here))


def aligned(batch: DataFrame, results: DataFrame) -> DataFrame:
    """Results by the names of the batch: the last of a name, an empty one for a name without."""
    r = last_wins(results, ["name"], "ord").drop("ord")
    empty = F.array().cast(results.schema["relations"].dataType)
    return batch.select("name").join(r, "name", "left").withColumn("relations", F.coalesce("relations", empty))


def prompts(files: DataFrame, template: str, text: Column, limit: int = 6000) -> DataFrame:
    return files.select("path", F.format_string(template, F.substring(text, 1, limit)).alias("prompt"))

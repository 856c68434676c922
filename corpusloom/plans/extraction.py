"""Extraction queries: events stand in for files, their answers are made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import extraction as X

from .people import _answers
from .registry import oracle, query


@query("extraction_entries", """SELECT event_id, status, CASE WHEN status = 'complete' THEN 2 ELSE 0 END AS objects_extracted, CASE WHEN status = 'complete' THEN 1 ELSE 0 END AS relationships_extracted, CASE WHEN status = 'complete' THEN 'Calc' || CAST(era AS STRING) || '=2' END AS eras, error
  FROM (SELECT *, CASE WHEN error IS NULL THEN 'complete' ELSE 'error' END AS status, CASE WHEN b >= 1930 AND c < 6 THEN 6 WHEN b >= 1850 AND c < 5 THEN 5 WHEN b >= 1780 AND c < 4 THEN 4 ELSE c END AS era
    FROM (SELECT event_id, 1700 + event_id % 300 AS b, event_id % 7 AS c, CASE WHEN event_id % 11 = 0 THEN 'file not found' WHEN event_id % 13 = 0 THEN 'no text extracted' WHEN event_id % 5 IN (1, 2) THEN 'api call failed' END AS error FROM events))""")
def extraction_entries(t):
    f = _answers(t).select(F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 11 != 0).alias("found"), F.when(F.col("event_id") % 13 != 0, "x").alias("text"), "raw")
    eras = F.array_join(F.transform(F.map_entries("era_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return X.entries(f).select(F.col("path").cast("long").alias("event_id"), "status", "objects_extracted", "relationships_extracted", eras.alias("eras"), "error")


@query("retry_counts", oracle(["v_graph"], "SELECT path, CASE WHEN status = 'error' THEN retry_count + 1 ELSE 0 END AS retry_count FROM v_graph"))
def retry_counts(t):
    g = t("v_graph")
    return X.retried(g, g.select("path", "status")).select("path", "retry_count")


def _results(t):
    """Edges of each person as results of a model, some without weight or confidence."""
    e = t("v_edges").groupBy(F.col("source").cast("string").alias("name")).agg(F.collect_list(F.struct(F.col("target").cast("string").alias("target"), "relation_type", F.when(F.col("target") % 2 == 0, F.col("weight")).alias("weight"), F.when(F.col("target") % 3 == 0, "high").alias("confidence"), F.lit(None).cast("string").alias("evidence_type"), F.lit(None).cast("string").alias("provenance"))).alias("relations"))
    return e.withColumn("ord", F.col("name").cast("long"))


@query("result_edges", oracle(["v_edges"], "SELECT CAST(source AS STRING) AS source, CAST(target AS STRING) AS target, relation_type, CASE WHEN target % 2 = 0 THEN weight ELSE 0.5 END AS weight, CASE WHEN target % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM v_edges"))
def result_edges(t):
    return X.result_edges(_results(t)).select("source", "target", "relation_type", "weight", "confidence")


@query("results_aligned", oracle(["v_people", "v_edges"], "SELECT CAST(pid AS STRING) AS name, coalesce(n, 0) AS n FROM v_people LEFT JOIN (SELECT source, count(*) AS n FROM v_edges WHERE source % 3 > 0 GROUP BY 1) ON pid = source"))
def results_aligned(t):
    batch = t("v_people").select(F.col("pid").cast("string").alias("name"))
    return X.aligned(batch, _results(t).where("ord % 3 > 0")).select("name", F.size("relations").cast("long").alias("n"))


@query("tag_records", oracle(["v_people"], "SELECT name, CASE WHEN pid % 2 = 0 THEN field ELSE '' END AS math, cluster_id AS schools FROM v_people WHERE pid % 2 = 0 OR cluster_id <> ''"))
def tag_records(t):
    r = t("v_people").select("name", F.when(F.col("pid") % 2 == 0, F.array("field")).alias("suggested_math_tags"), F.when(F.col("cluster_id") != "", F.array("cluster_id")).alias("suggested_schools"))
    return X.tag_records(r).select("name", F.array_join("suggested_math_tags", ",").alias("math"), F.array_join("suggested_schools", ",").alias("schools"))


@query("display_names", oracle(["v_people"], """SELECT pid, CASE WHEN pid % 3 = 0 THEN '?' ELSE CAST(birth_year AS STRING) END || '–' || CAST(death_year AS STRING) AS lifespan, coalesce(CAST(calculus_number AS STRING), 'unassigned') AS era, '["' || name || '"]' || CASE WHEN pid % 2 = 0 THEN chr(10) || '// ... and 1 more' ELSE '' END AS compact FROM v_people"""))
def display_names(t):
    names = F.when(F.col("pid") % 2 == 0, F.array("name", "country")).otherwise(F.array("name"))
    return t("v_people").select("pid", T.lifespan(F.when(F.col("pid") % 3 != 0, F.col("birth_year")), F.col("death_year")).alias("lifespan"), T.era_key(F.col("calculus_number")).alias("era"), T.compact_names(names, 1).alias("compact"))


@query("feed_line_counts", "SELECT event_type, count(*) FILTER (WHERE event_id % 3 > 0) AS n_lines FROM events GROUP BY 1")
def feed_line_counts(t):
    """Non-blank lines of each feed."""
    line = F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise("  ")
    return t("events").groupBy("event_type").agg(F.count_if(T.strip(line) != "").alias("n_lines"))

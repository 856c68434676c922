"""Graph and catalogue queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import views as V
from corpusloom.operators.rewrites import band_pairs

from .registry import oracle, query

_SELECTED = "0"
_ERAS = [1, 2, 3, None]


def _people(t):
    return t("v_people").select(F.col("pid").cast("string").alias("id"), "pid", "name", "ord", "calculus_number", "centrality_score", "cluster_id", "field", F.array("country").alias("schools"), F.when(F.col("pid") % 2 == 0, F.array("field")).alias("suggested_schools"))


def _edges(t, hypotheses=True, touching=None):
    p = t("v_people").select("pid", "name")
    e = t("v_edges").join(p.select(F.col("pid").alias("source"), F.col("name").alias("sn")), "source").join(p.select(F.col("pid").alias("target"), F.col("name").alias("tn")), "target", "left")
    r = e.select(F.col("source").cast("string").alias("owner"), F.col("sn").alias("owner_name"), (F.col("target") % 3).alias("position"), F.when(F.col("target") % 2 == 0, F.col("sn")).otherwise("Nobody").alias("source"), F.coalesce("tn", F.lit("unknown")).alias("target"), "relation_type", "weight", "assertion_layer")
    return G.build_edges(_people(t), r, hypotheses, touching)


_BUILT = """ids AS (SELECT name, CAST(arg_max(pid, ord) AS STRING) AS id FROM v_people GROUP BY 1),
looked AS (SELECT i.id AS source, g.id AS target, relation_type, e.target % 3 AS position, weight, assertion_layer, CAST(e.source AS STRING) AS owner
  FROM v_edges e JOIN v_people s ON e.source = s.pid JOIN v_people h ON e.target = h.pid JOIN ids i ON s.name = i.name JOIN ids g ON h.name = g.name WHERE i.id <> g.id),
edges_all AS (SELECT source, target, relation_type, position, arg_min(weight, owner) AS weight, arg_min(assertion_layer, owner) AS assertion_layer FROM looked GROUP BY 1, 2, 3, 4),
edges_canon AS (SELECT source, target, relation_type, position, arg_min(weight, owner) AS weight FROM looked WHERE assertion_layer <> 'ai_hypothesis' GROUP BY 1, 2, 3, 4),
vis AS (SELECT CAST(pid AS STRING) AS id, * FROM v_people WHERE calculus_number IN (1, 2, 3) OR calculus_number IS NULL),
vis_edges AS (SELECT * FROM edges_all WHERE weight >= 0.3 AND source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)),
near AS (SELECT DISTINCT CASE WHEN source = '0' THEN target ELSE source END AS id FROM vis_edges WHERE source = '0' OR target = '0')"""


@query("graph_edges", oracle(["v_people", "v_edges"], "SELECT source, target, relation_type, position, weight FROM edges_canon", _BUILT))
def graph_edges(t):
    """Canonical edges only: hypotheses are gated off."""
    return _edges(t, False).select("source", "target", "relation_type", "position", "weight")


@query("graph_degree", oracle(["v_people", "v_edges"], "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges_all UNION ALL SELECT target FROM edges_all) GROUP BY 1", _BUILT))
def graph_degree(t):
    return G.degrees(_edges(t))


@query("graph_nodes", oracle(["v_people", "v_edges"], """SELECT CAST(pid AS STRING) AS id, coalesce(n, 0) AS degree, round(centrality_score * 12 + 4, 6) AS size,
  CASE calculus_number WHEN 0 THEN '#c9a96e' WHEN 1 THEN '#7ec8c8' WHEN 2 THEN '#a8d8a8' WHEN 3 THEN '#b8a0d8' WHEN 4 THEN '#f0a060' WHEN 5 THEN '#80b8f0' WHEN 6 THEN '#d4a0c8' ELSE '#888888' END AS color
  FROM v_people LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges_all UNION ALL SELECT target FROM edges_all) GROUP BY 1) ON id = CAST(pid AS STRING)""", _BUILT))
def graph_nodes(t):
    return G.build_nodes(_people(t), _edges(t)).select("id", "degree", F.round("size", 6).alias("size"), "color")


@query("visible_nodes", oracle(["v_people"], "SELECT CAST(pid AS STRING) AS id FROM v_people WHERE (calculus_number IN (1, 2, 3) OR calculus_number IS NULL) AND (country IN ('NATION_1', 'NATION_2') OR (pid % 2 = 0 AND field IN ('BUILDING')))"))
def visible_nodes(t):
    return G.visible_nodes(_people(t), _ERAS, ["NATION_1", "NATION_2", "BUILDING"]).select("id")


def _visible(t, touching=None):
    nodes = G.visible_nodes(_people(t), _ERAS)
    return nodes, G.visible_edges(_edges(t, touching=touching), nodes)


@query("visible_edges", oracle(["v_people", "v_edges"], "SELECT source, target, relation_type, position FROM vis_edges", _BUILT))
def visible_edges(t):
    return _visible(t)[1].select("source", "target", "relation_type", "position")


@query("neighbourhood", oracle(["v_people", "v_edges"], "SELECT id FROM near", _BUILT))
def neighbourhood(t):
    return G.neighbours(_visible(t, _SELECTED)[1], _SELECTED)


@query("dimmed_nodes", oracle(["v_people", "v_edges"], "SELECT id FROM vis WHERE id <> '0' AND id NOT IN (SELECT id FROM near)", _BUILT))
def dimmed_nodes(t):
    nodes, edges = _visible(t, _SELECTED)
    return G.dimmed_nodes(nodes, edges, _SELECTED)


@query("cluster_layout", oracle(["v_people"], f"""SELECT CAST(pid AS STRING) AS id, cluster, round(cos(ci::DOUBLE / clusters * {2 * math.pi!r}) * centre + cos(ni::DOUBLE / k * {2 * math.pi!r}) * (0.18::DOUBLE + sqrt(k) * 0.05::DOUBLE), 6) AS x, round(sin(ci::DOUBLE / clusters * {2 * math.pi!r}) * centre + sin(ni::DOUBLE / k * {2 * math.pi!r}) * (0.18::DOUBLE + sqrt(k) * 0.05::DOUBLE), 6) AS y
  FROM (SELECT pid, ord, cluster, row_number() OVER (PARTITION BY cluster ORDER BY ord) - 1 AS ni FROM c) JOIN (SELECT cluster, k, row_number() OVER (ORDER BY k DESC, f) - 1 AS ci, count(*) OVER () AS clusters, CASE WHEN sum(k) OVER () > 80 THEN 3.4::DOUBLE ELSE 1.5::DOUBLE END AS centre FROM (SELECT cluster, count(*) AS k, min(ord) AS f FROM c GROUP BY 1)) USING (cluster)""",
  "c AS (SELECT pid, ord, coalesce(nullif(cluster_id, ''), nullif(field, ''), CAST(calculus_number AS STRING), 'unknown') AS cluster FROM v_people)"))
def cluster_layout(t):
    return G.circular_layout(_people(t)).select("id", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("filter_options", oracle(["v_people", "v_edges"], """SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY n NULLS LAST, value) - 1 AS place FROM (
  SELECT DISTINCT 'era' AS kind, CAST(calculus_number AS STRING) AS value, calculus_number AS n FROM v_people UNION ALL SELECT DISTINCT 'relation', relation_type, 0 FROM edges_all
  UNION ALL SELECT DISTINCT 'school', s, 0 FROM (SELECT country AS s FROM v_people UNION ALL SELECT field FROM v_people WHERE pid % 2 = 0))""", _BUILT))
def filter_options(t):
    return G.filter_options(_people(t), _edges(t))


@query("gallery_search", oracle(["v_people"], "SELECT pid, pid % 3 = 0 AS has_media FROM v_people WHERE coalesce(CAST(calculus_number AS STRING), 'unassigned') = '2' AND contains(lower(concat_ws(' ', name, field, country, nullif(cluster_id, ''))), 'build') ORDER BY (pid % 3 = 0) DESC, centrality_score DESC, name, pid LIMIT 180"))
def gallery_search(t):
    return V.gallery(t("v_people"), F.col("pid") % 3 == 0, " Build", "2").select("pid", "has_media")


@query("era_tabs", oracle(["v_people"], "SELECT coalesce(CAST(calculus_number AS STRING), 'unassigned') AS era, count(*) AS n FROM v_people GROUP BY 1"))
def era_tabs(t):
    return V.era_tabs(t("v_people"))


@query("catalogue_names", oracle(["v_people"], "SELECT pid, name FROM v_people WHERE contains(lower(name), 'nation_1') AND calculus_number = 3"))
def catalogue_names(t):
    return V.by_name(t("v_people"), "Nation_1", "3").select("pid", "name")


@query("roster_enriched", oracle(["v_people"], "SELECT count(*) FILTER (WHERE pid % 2 = 0) > 0 AS enriched FROM v_people"))
def roster_enriched(t):
    return V.is_enriched(_people(t), ("suggested_schools",))


@query("roster_counters", oracle(["v_people", "v_edges"], """SELECT count(*) AS people, CAST(sum(n) AS BIGINT) AS edges, count(*) FILTER (WHERE cluster_id <> '') AS tagged, count(*) FILTER (WHERE cluster_id <> '' AND n > 0) AS graph_ready FROM (SELECT cluster_id, coalesce(n, 0) AS n FROM v_people LEFT JOIN (SELECT source, count(*) AS n FROM v_edges GROUP BY 1) ON pid = source)"""))
def roster_counters(t):
    from corpusloom.operators import people as P

    n = t("v_edges").groupBy(F.col("source").alias("pid")).agg(F.count("*").alias("n_edges"))
    p = t("v_people").join(n, "pid", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return P.counters(p.withColumn("pipeline_flags", P.pipeline_flags(F.col("calculus_number"), F.col("cluster_id") != "", F.col("n_edges"))))


@query("review_backlog", oracle(["v_people", "v_edges"], "SELECT (SELECT count(*) FROM labels) AS tags, (SELECT count(*) FROM v_people) AS people, (SELECT count(*) FROM v_edges WHERE assertion_layer = 'ai_hypothesis') AS edges, (SELECT count(*) FROM labels) + (SELECT count(*) FROM v_people) + (SELECT count(*) FROM v_edges WHERE assertion_layer = 'ai_hypothesis') AS backlog"))
def review_backlog(t):
    return V.review_backlog(t("labels"), t("v_people"), t("v_edges").where("assertion_layer = 'ai_hypothesis'"))


@query("target_navigation", oracle(["v_people"], "SELECT doc_id, target_pid FROM (SELECT doc_id, upper('BUILDING NATION_1 ' || CAST(doc_id % 700 AS STRING)) AS target FROM labels) LEFT JOIN (SELECT lower(name) AS k, arg_max(pid, ord) AS target_pid FROM v_people GROUP BY 1) ON lower(target) = k"))
def target_navigation(t):
    return V.navigation(t("labels").select("doc_id", F.upper(F.concat(F.lit("BUILDING NATION_1 "), (F.col("doc_id") % 700).cast("string"))).alias("target")), t("v_people")).select("doc_id", "target_pid")


@query("band_pair_counts", oracle([], "SELECT s.s_suppkey AS supplier, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM supplier s JOIN part p ON abs(s.s_suppkey % 60 - p.p_size) <= 5 GROUP BY 1"))
def band_pair_counts(t):
    """A band join as an equal join on bands: suppliers against parts of near size."""
    s, p = t("supplier").select("s_suppkey", (F.col("s_suppkey") % 60).alias("at")), t("part").select(F.col("p_size").cast("long").alias("size"))
    # sums of each size before the join: a place has as many pairs as there are sizes, however many parts
    s, p = s.groupBy("s_suppkey", "at").agg(F.count("*").alias("times")), p.groupBy("size").agg(F.count("*").alias("parts"))
    places = band_pairs(s.select("at").distinct(), p, "at", "size", 5).groupBy("at").agg(F.sum("parts").alias("n"), F.sum(F.col("parts") * F.col("size")).alias("sizes"))
    return s.join(places, "at").groupBy(F.col("s_suppkey").alias("supplier")).agg(F.sum(F.col("times") * F.col("n")).alias("n"), F.sum(F.col("times") * F.col("sizes")).alias("sizes"))


@query("stars_clamped", "SELECT l_orderkey, l_linenumber, greatest(0, least(10, CAST(floor(l_quantity) AS INT))) AS stars FROM lineitem")
def stars_clamped(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", V.passages_stars(F.floor("l_quantity").cast("int")).alias("stars"))

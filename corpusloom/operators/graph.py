"""The relation graph of a roster: nodes, edges, what is visible, neighbourhoods, a circular layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rewrites import last_wins

# Colours by era and by relation.
ERA_COLORS = {0: "#c9a96e", 1: "#7ec8c8", 2: "#a8d8a8", 3: "#b8a0d8", 4: "#f0a060", 5: "#80b8f0", 6: "#d4a0c8"}
RELATION_COLORS = {"influenced": "#7ec8c8", "collaborated_with": "#a8d8a8", "corresponded_with": "#80b8f0", "taught": "#c9a96e", "cited": "#b8a0d8", "debated": "#f0a060", "opposed": "#d97878", "associated_with": "#9a8f79"}
HYPOTHESIS_COLOR = "#ffffff18"


def _looked_up(c: Column, table: dict, default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def era_color(era: Column) -> Column:
    return _looked_up(era, ERA_COLORS, "#888888")


def edge_color(relation: Column, layer: Column) -> Column:
    return F.when(layer == "ai_hypothesis", HYPOTHESIS_COLOR).otherwise(_looked_up(relation, RELATION_COLORS, "#ffffff44"))


def dimmed(color: Column) -> Column:
    return F.when(F.startswith(color, F.lit("#")) & (F.length(color) == 7), F.concat(color, F.lit("33"))).otherwise(color)


def build_edges(people: DataFrame, relations: DataFrame, hypotheses: bool = False, touching: str | None = None) -> DataFrame:
    """Edges between people of the roster.

    ``people``: ``id, name, ord``; ``relations``: ``owner`` (the id of the person that has
    it), ``owner_name, position, source, target, relation_type, weight, assertion_layer``.
    A source is looked up by name, then the owner's name, then the owner's id; the
    last person of a name wins; self-loops and unknown targets go.  The position
    is part of an edge's identity, so only repeats across rows of one person collapse:
    the smallest owner's stays, of several that owner has the lightest, whatever the order of rows.

    ``touching`` asks for the edges of one id only.  At most one name leads to it, so
    relations without that name and that owner go before any name is joined.
    """
    ids = last_wins(people.select("name", "id", "ord"), ["name"], "ord").drop("ord")
    layer = F.coalesce("assertion_layer", F.lit("canonical"))
    r = relations.withColumn("assertion_layer", layer)
    if not hypotheses:
        r = r.where(F.col("assertion_layer") != "ai_hypothesis")
    if touching is not None:
        # some edges of others stay: a source that is known hides its owner
        mine = ids.where(F.col("id") == touching).agg(F.max("name").alias("__mine"))
        near = F.lit(False)
        for c in ("target", "source", "owner_name"):
            near = near | F.coalesce(F.col(c) == F.col("__mine"), F.lit(False))
        r = r.crossJoin(F.broadcast(mine)).where(near | (F.col("owner") == touching)).drop("__mine")
    named = lambda c, a: ids.select(F.col("name").alias(c), F.col("id").alias(a))
    r = r.join(named("target", "t"), "target").join(named("source", "s"), "source", "left").join(named("owner_name", "o"), "owner_name", "left")
    r = r.withColumn("s", F.coalesce("s", "o", "owner")).where(F.col("s") != F.col("t"))
    r = r.withColumn("weight", F.coalesce("weight", F.lit(0.5)))
    first = F.min_by(F.struct("weight", "assertion_layer"), F.struct("owner", "weight", "assertion_layer"))
    out = r.groupBy("s", "t", "relation_type", "position").agg(first.alias("x"))
    return out.select(F.col("s").alias("source"), F.col("t").alias("target"), "relation_type", "position", "x.weight", "x.assertion_layer", edge_color(F.col("relation_type"), F.col("x.assertion_layer")).alias("color"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def build_nodes(people: DataFrame, edges: DataFrame) -> DataFrame:
    out = people.join(degrees(edges), "id", "left")
    size = F.coalesce(F.col("centrality_score"), F.lit(0.3)) * 12 + 4
    return out.withColumns({"degree": F.coalesce("degree", F.lit(0)), "size": size, "color": era_color(F.col("calculus_number"))})


def visible_nodes(nodes: DataFrame, eras: list[int | None], schools: list[str] | None = None) -> DataFrame:
    """Nodes of the chosen eras (none chosen: none) and, if any are chosen, schools."""
    known = [e for e in eras if e is not None]
    keep = F.col("calculus_number").isin(known) if known else F.lit(False)
    if None in eras:
        keep = keep | F.col("calculus_number").isNull()
    out = nodes.where(F.coalesce(keep, F.lit(False)))
    if schools:
        mine = F.array_union(F.coalesce("schools", F.array().cast("array<string>")), F.coalesce("suggested_schools", F.array().cast("array<string>")))
        out = out.where(F.arrays_overlap(mine, F.array(*map(F.lit, schools))))
    return out


def visible_edges(edges: DataFrame, nodes: DataFrame, min_weight: float = 0.3, relations: list[str] | None = None) -> DataFrame:
    """Edges with both ends visible, weight enough and, if any are chosen, a chosen type (none chosen: all)."""
    out = edges.where(F.col("weight") >= min_weight)
    if relations:
        out = out.where(F.col("relation_type").isin(relations))
    ids = nodes.select("id")
    return out.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def neighbours(edges: DataFrame, selected) -> DataFrame:
    near = edges.where((F.col("source") == selected) | (F.col("target") == selected))
    return near.select(F.when(F.col("source") == selected, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()


def dimmed_nodes(nodes: DataFrame, edges: DataFrame, selected) -> DataFrame:
    return nodes.where(F.col("id") != selected).join(neighbours(edges, selected), "id", "left_anti").select("id")


def circular_layout(nodes: DataFrame) -> DataFrame:
    """``id, x, y``: clusters on a circle by size, their nodes on small circles.

    Positions within a cluster need its rows in order; clusters are only as many
    as there are fields, so their order comes from a table of one row each.
    """
    era = F.coalesce(F.col("calculus_number").cast("string"), F.lit("unknown"))
    n = nodes.withColumn("cluster", F.coalesce(F.nullif("cluster_id", F.lit("")), F.nullif("field", F.lit("")), era))
    sizes = n.groupBy("cluster").agg(F.count("*").alias("k"), F.min("ord").alias("first"))
    w = Window.orderBy(F.desc("k"), "first")
    all_ = Window.partitionBy()
    sizes = sizes.select("cluster", "k", (F.row_number().over(w) - 1).alias("ci"), F.count("*").over(all_).alias("clusters"), F.sum("k").over(all_).alias("total"))
    at = n.withColumn("ni", F.row_number().over(Window.partitionBy("cluster").orderBy("ord")) - 1).join(sizes, "cluster")
    big, small = F.col("ci") / F.col("clusters") * (2 * math.pi), F.col("ni") / F.col("k") * (2 * math.pi)
    centre, radius = F.when(F.col("total") > 80, 3.4).otherwise(1.5), F.lit(0.18) + F.sqrt("k") * 0.05
    return at.select("id", "cluster", (F.cos(big) * centre + F.cos(small) * radius).alias("x"), (F.sin(big) * centre + F.sin(small) * radius).alias("y"))


def filter_options(people: DataFrame, edges: DataFrame) -> DataFrame:
    """What can be chosen: ``kind`` (era, relation, school), ``value``, ``place`` (eras without a number last)."""
    eras = people.select(F.col("calculus_number").alias("n")).distinct().select(F.lit("era").alias("kind"), F.col("n").cast("string").alias("value"), F.coalesce(F.col("n"), F.lit(2**31 - 1)).cast("string").alias("key"))
    rel = edges.select("relation_type").distinct().select(F.lit("relation").alias("kind"), F.col("relation_type").alias("value"), F.col("relation_type").alias("key"))
    both = F.concat(F.coalesce("schools", F.array().cast("array<string>")), F.coalesce("suggested_schools", F.array().cast("array<string>")))
    sch = people.select(F.explode(both).alias("s")).distinct().select(F.lit("school").alias("kind"), F.col("s").alias("value"), F.col("s").alias("key"))
    w = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "era", F.col("key").cast("int")), "key")
    return eras.union(rel).union(sch).withColumn("place", F.row_number().over(w) - 1).drop("key")

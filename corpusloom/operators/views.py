"""Catalogue views of a roster: gallery, eras, review queue, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import era_key

from .rewrites import last_wins

GALLERY_LIMIT, REVIEW_LIMIT = 180, 200
SEARCHED = ("name", "field", "country", "cluster_id")
SEARCHED_TAGS = ("schools", "math_tags", "cognitive_tags", "domain_tags")


def has_media(bibliography: Column) -> Column:
    return F.coalesce(F.exists(bibliography, lambda b: F.coalesce(b["found_in_drive"], F.lit(False)) | (F.coalesce(b["drive_path"], F.lit("")) != "")), F.lit(False))


def gallery(people: DataFrame, media: Column, search: str = "", era: str = "all", media_only: bool = False, limit: int = GALLERY_LIMIT) -> DataFrame:
    """The matching people: those with media first, then by centrality, then by name."""
    out = people.withColumn("has_media", media)
    if era != "all":
        out = out.where(era_key(F.col("calculus_number")) == era)
    if media_only:
        out = out.where("has_media")
    if needle := search.strip().lower():
        parts = [F.nullif(F.col(c), F.lit("")) for c in SEARCHED if c in people.columns] + [F.array_join(F.col(c), " ") for c in SEARCHED_TAGS if c in people.columns]
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(needle)))
    return out.orderBy(F.desc("has_media"), F.desc(F.coalesce("centrality_score", F.lit(0.0))), "name", "pid").limit(limit)


def era_tabs(people: DataFrame) -> DataFrame:
    """People an era, the unassigned last."""
    key = era_key(F.col("calculus_number"))
    place = F.coalesce(F.col("calculus_number"), F.lit(2**31 - 1))
    return people.groupBy(key.alias("era"), place.alias("place")).agg(F.count("*").alias("n")).orderBy("place").drop("place")


def review_backlog(tags: DataFrame, people: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(tags, "tags").join(one(people, "people")).join(one(edges, "edges")).withColumn("backlog", F.col("tags") + F.col("people") + F.col("edges"))


def navigation(relations: DataFrame, people: DataFrame) -> DataFrame:
    """Relations with the person that their target's name leads to (the last of a name, case aside)."""
    p = last_wins(people.select(F.lower("name").alias("k"), F.col("pid").alias("target_pid"), "ord"), ["k"], "ord").drop("ord")
    return relations.withColumn("k", F.lower("target")).join(p, "k", "left").drop("k")


def by_name(people: DataFrame, needle: str = "", era: str = "all") -> DataFrame:
    """The catalogue's list: names that contain the needle, of one era or all, in the order of a reader's alphabet."""
    out = people if era == "all" else people.where(era_key(F.col("calculus_number")) == era)
    if needle.strip():
        out = out.where(F.contains(F.lower("name"), F.lit(needle.strip().lower())))
    return out.orderBy(F.collate("name", "UNICODE_CI"), "pid")


def is_enriched(people: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Whether any person has anything in any of the array fields."""
    some = F.lit(False)
    for f in fields:
        some = some | (F.coalesce(F.size(f), F.lit(0)) > 0)
    return people.agg(F.coalesce(F.bool_or(some), F.lit(False)).alias("enriched"))


def is_roster(people: Column) -> Column:
    """Whether an array is a roster: not empty, each element with a name."""
    return (F.size(people) > 0) & F.forall(people, lambda p: p["name"].isNotNull())


def review_lists(tags: DataFrame, people: DataFrame, edges: DataFrame, order: tuple[str, str, str], limit: int = REVIEW_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.orderBy(o).limit(limit) for df, o in zip((tags, people, edges), order))


def passages_stars(n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(n, F.lit(0))))

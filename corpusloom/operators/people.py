"""Rosters of people: deduplication, enrichment, relations, texts, registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, dates_note, nonempty, norm, person_key

from .rewrites import first_wins, last_wins, top_k

#: Relations that a person's text names.
SHOWN_RELATIONS = 8

# What a person's edge holds.
EDGE_FIELDS = ("source", "target", "relation_type", "weight", "assertion_layer")
# The fields that hold tags, those that make a person tagged, those whose suggestions are registered.
TAG_FIELDS = ("schools", "suggested_schools", "cognitive_tags", "suggested_cognitive_tags", "math_tags", "suggested_math_tags", "domain_tags", "suggested_domain_tags", "suggested_pipeline_flags")
TAGGED = ("schools", "cognitive_tags", "math_tags", "domain_tags")
REGISTRY_FIELDS = ("suggested_math_tags", "suggested_cognitive_tags", "suggested_schools", "suggested_domain_tags")


def dedup(people: DataFrame) -> DataFrame:
    """One row a (name key, birth year, era); nulls are equal.

    The fold over a group's records has a closed form: every field comes from the
    first record but ``lifespan_raw`` (the first usable one, if the first record's
    is not), ``portrait_url`` (``Picture`` if the first has none and any has it),
    ``date_note`` (the first that is present; ``has_date_note`` marks presence)
    and, if the records are not all alike, ``name`` (the one with a capital, then
    the longest, then the first).  ``n_records`` and ``conflict`` (more than one
    death year) are added.  One partial aggregate, no sort.
    """
    cols = people.columns
    rec = F.struct(*(F.col(c) for c in cols))
    usable = nonempty(F.col("lifespan_raw")) & (F.col("lifespan_raw") != "nan")
    present = F.col("has_date_note") if "has_date_note" in cols else F.col("date_note").isNotNull()
    alike = F.struct(*(F.col(c) for c in cols if c != "ord"))
    g = people.groupBy(norm(F.col("name")).alias("__key"), F.col("birth_year").alias("__birth"), F.col("calculus_number").alias("__era")).agg(
        F.min_by(rec, "ord").alias("first"),
        F.min_by("lifespan_raw", F.when(usable, F.col("ord"))).alias("lifespan"),
        F.bool_or(F.col("portrait_url") == "Picture").alias("picture"),
        F.min_by("date_note", F.when(present, F.col("ord"))).alias("note"),
        F.max_by("name", F.struct(F.col("name") != F.lower("name"), F.length("name"), -F.col("ord"))).alias("best"),
        F.count("*").alias("n_records"),
        F.count_distinct("death_year").alias("deaths"),
        (F.min(F.xxhash64(alike)) != F.max(F.xxhash64(alike))).alias("unlike"),
    )
    first_usable = nonempty(F.col("first.lifespan_raw")) & (F.col("first.lifespan_raw") != "nan")
    put = {
        "lifespan_raw": F.when(first_usable, F.col("first.lifespan_raw")).otherwise(F.coalesce("lifespan", "first.lifespan_raw")),
        "portrait_url": F.coalesce("first.portrait_url", F.when(F.col("picture"), F.lit("Picture"))),
        "date_note": F.col("note"),
        "name": F.when(F.col("unlike"), F.col("best")).otherwise(F.col("first.name")),
    }
    return g.select(*(put.get(c, F.col(f"first.{c}")).alias(c) for c in cols), "n_records", (F.col("unlike") & (F.col("deaths") > 1)).alias("conflict"))


def conflicts(people: DataFrame) -> DataFrame:
    """All records of the groups in which death years disagree."""
    w = people.groupBy(norm(F.col("name")).alias("k"), F.col("birth_year").alias("b"), F.col("calculus_number").alias("e")).agg(F.count_distinct("death_year").alias("n_deaths")).where("n_deaths > 1")
    on = (norm(people["name"]).eqNullSafe(F.col("k"))) & people["birth_year"].eqNullSafe(F.col("b")) & people["calculus_number"].eqNullSafe(F.col("e"))
    return people.join(w, on).select(*people.columns, "n_deaths")


def overlaid(people: DataFrame, overlay: DataFrame, fields: dict[str, str], fill_only: bool = False) -> DataFrame:
    """People with the fields of the last overlay record of their name.

    ``fields`` maps a field to the boolean column of ``overlay`` that says whether
    it is present; a present null wins.  ``fill_only`` keeps what a person has.
    """
    o = last_wins(overlay.withColumn("__k", norm(F.col("name"))), ["__k"], "ord").select("__k", *(F.col(f).alias(f"__{f}") for f in fields), *(F.col(h).alias(f"__{h}") for h in fields.values()))
    out = people.withColumn("__k", norm(F.col("name"))).join(o, "__k", "left")
    for f, has in fields.items():
        here = F.coalesce(F.col(f"__{has}"), F.lit(False))
        take = here & F.col(f).isNull() if fill_only else here
        out = out.withColumn(f, F.when(take, F.col(f"__{f}")).otherwise(F.col(f)))
    return out.select(people.columns)


def nested_edges(people: DataFrame, edges: DataFrame, first: int | None = None, fields: tuple[str, ...] = EDGE_FIELDS, told: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``semantic_relationships``: the edges of a person's name (the ``first`` of them, if not all), in the order of ``ord``; the layer is always ``ai_hypothesis``.

    Only ``fields`` of an edge are gathered.  With ``told``, what its functions make
    of the list stands in the list's place, under their names: it is made once a
    name, and no lists are joined with the people.
    """
    e = edges.withColumn("__k", norm(F.col("source").cast("string"))).withColumn("assertion_layer", F.lit("ai_hypothesis"))
    if first is not None:
        e = top_k(e, ["__k"], [F.col("ord")], first)
    g = e.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("semantic_relationships"))
    none = F.array().cast(g.schema["semantic_relationships"].dataType)
    told = told or {"semantic_relationships": lambda r: r}
    g = g.select("__k", *(make(F.col("semantic_relationships")).alias(n) for n, make in told.items()))
    out = people.withColumn("__k", norm(F.col("name"))).join(g, "__k", "left").drop("__k")
    return out.withColumns({n: F.coalesce(n, make(none)) for n, make in told.items()})


def with_target_era(edges: DataFrame, people: DataFrame) -> DataFrame:
    """``calculus_target`` where it is missing: the era of the last person of the target's name."""
    p = last_wins(people.select(norm(F.col("name")).alias("__k"), F.col("calculus_number").alias("__era"), "ord"), ["__k"], "ord").drop("ord")
    return edges.withColumn("__k", norm(F.col("target"))).join(p, "__k", "left").withColumn("calculus_target", F.coalesce("calculus_target", "__era")).drop("__k", "__era")


def with_bibliography(people: DataFrame, books: DataFrame) -> DataFrame:
    """``associated_texts`` (also as ``bibliography``): the books whose ``source_person`` is the person, in order."""
    b = books.withColumn("__k", norm(F.col("source_person"))).where("__k <> ''")
    g = b.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("ord", *(c for c in books.columns if c not in ("ord", "source_person"))))).alias("associated_texts"))
    out = people.withColumn("__k", norm(F.col("name"))).join(g, "__k", "left").drop("__k")
    out = out.withColumn("associated_texts", F.coalesce("associated_texts", F.array().cast(g.schema["associated_texts"].dataType)))
    return out.withColumn("bibliography", F.col("associated_texts"))


def resolved_tags(tags: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People tags (``name``, ``relation``) of known people (the first of a name) and those of unknown ones."""
    first = first_wins(roster.select(norm(F.col("name")).alias("__k"), "person_id", F.col("name").alias("person_name"), "ord"), ["__k"], "ord").drop("ord")
    keyed = tags.withColumn("__k", norm(F.col("name")))
    found = keyed.join(first, "__k").withColumn("relation", F.coalesce("relation", F.lit("mentioned"))).drop("__k")
    return found, keyed.join(first, "__k", "left_anti").drop("__k")


def suggested_tags(people: DataFrame, fields: tuple[str, ...] = REGISTRY_FIELDS) -> DataFrame:
    """Distinct tags by field: ``tag_class``, ``tag``."""
    pairs = F.array(*(F.struct(F.lit(f).alias("tag_class"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("tags")) for f in fields))
    rows = people.select(F.explode(pairs).alias("p")).select("p.tag_class", F.explode("p.tags").alias("tag"))
    return rows.where("tag <> ''").distinct()


def suggested_people(entries: DataFrame) -> DataFrame:
    """The first entry of each name."""
    return first_wins(entries.withColumn("__k", norm(F.col("name"))).where("__k <> ''"), ["__k"], "ord").drop("__k")


def pipeline_flags(era: Column, tagged: Column, n_edges: Column) -> Column:
    linked = F.coalesce(n_edges, F.lit(0)) > 0
    return F.array_compact(
        F.array(
            F.when(era.isNotNull(), "Era-Assigned"), F.when(tagged, "Auto-Tagged"), F.when(linked, "Edges-Linked"),
            F.when(linked & tagged, "Graph-Ready").when(linked, "Graph-Partial").otherwise("Relationship-Incomplete"),
        )
    )


def all_flags(flags: Column, suggested: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(flags, none), F.coalesce(suggested, none))


def counters(people: DataFrame) -> DataFrame:
    """Totals of a roster with ``pipeline_flags`` and ``n_edges``."""
    has = lambda f: F.count_if(F.array_contains("pipeline_flags", f))
    return people.agg(F.count("*").alias("people"), F.coalesce(F.sum("n_edges"), F.lit(0)).cast("long").alias("edges"), has("Auto-Tagged").alias("tagged"), has("Graph-Ready").alias("graph_ready"))


# The tones of flags in the three views, which differ.
CARD_TONES = {
    "green": ("Era-Assigned", "Auto-Tagged", "Tagging-Complete", "Ontology-Aligned", "Edges-Linked", "Graph-Ready", "Source-Verified", "Text-Extracted", "Quality-Verified", "Graph-Integrated"),
    "red": ("OCR-Failed", "Quality-Low"),
}
SIDEBAR_TONES = {
    "red": ("OCR-Failed", "Text-Not-Extractable", "Quality-Low", "Pipeline-Blocked"),
    "amber": ("Graph-Partial", "Relationship-Incomplete", "Needs-Validation", "Tagging-In-Progress", "Low-Confidence-Tags", "Source-Identified"),
    "green": ("Era-Assigned", "Auto-Tagged", "Tagging-Complete", "Edges-Linked", "Graph-Ready", "Source-Verified", "Quality-Verified", "Text-Extracted", "Core-Text", "Graph-Integrated"),
}
CHIP_TONES = SIDEBAR_TONES | {"amber": ("Graph-Partial", "Relationship-Incomplete", "Needs-Validation", "Tagging-In-Progress", "Low-Confidence-Tags")}


def flag_tone(flag: Column, tones: dict[str, tuple[str, ...]] = CARD_TONES, default: str = "amber") -> Column:
    out = F.lit(default)
    for tone, flags in tones.items():
        out = F.when(flag.isin(*flags), tone).otherwise(out)
    return out


def person_text(p: dict[str, Column]) -> Column:
    """The text that stands for a person in the index; ``p`` has the columns by name, missing ones are left out."""
    get = lambda n: p.get(n, F.lit(None).cast("string"))
    lines = [F.trim(F.concat(F.coalesce(get("name"), F.lit("Unknown")), F.lit(" "), dates_note(p["birth_year"], p["death_year"]))), F.when(p["calculus_number"].isNotNull(), F.concat(F.lit("Era: Calculus "), p["calculus_number"].cast("string")))]
    lines += [F.when(nonempty(get(f)), F.concat(F.lit(f"{f.title()}: "), get(f))) for f in ("nationality", "occupation", "field", "institution")]
    lines.append(F.substring(F.coalesce(*(blank_to_null(get(f)) for f in ("biography", "description", "summary"))), 1, 600))
    for f in ("suggested_math_tags", "suggested_cognitive_tags", "suggested_domain_tags", "suggested_schools"):
        if f in p:
            title = f.replace("suggested_", "").replace("_", " ").title()
            lines.append(F.when(F.size(p[f]) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(p[f], 1, 10), ", "))))
    if "semantic_relationships" in p:
        named = F.filter(F.slice(p["semantic_relationships"], 1, SHOWN_RELATIONS), lambda r: nonempty(r["target"]))
        shown = F.transform(named, lambda r: F.concat(F.coalesce(r["relation_type"], F.lit("related to")), F.lit(" "), r["target"]))
        lines.append(F.when(F.size(shown) > 0, F.concat(F.lit("Relationships: "), F.array_join(shown, "; "))))
    if "pipeline_flags" in p:
        lines.append(F.when(F.size(p["pipeline_flags"]) > 0, F.concat(F.lit("Flags: "), F.array_join(F.slice(p["pipeline_flags"], 1, 6), ", "))))
    return F.concat_ws("\n", *(F.when(F.trim(x) != "", x) for x in lines))


def payload(people: DataFrame, text: Column, source_type: str = "people_timeline") -> DataFrame:
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) if n in people.columns else F.lit("")
    return people.select(F.lit(source_type).alias("source_type"), F.coalesce(blank_to_null(blank("person_id")), F.lit("")).alias("person_id"), blank("name").alias("name"), "birth_year", "death_year", "calculus_number", blank("nationality").alias("nationality"), blank("field").alias("field"), text.alias("text"))


def contemporaries(people: DataFrame, width: int = 150, limit: int = 500) -> DataFrame:
    """``pid``, how many people were born within ``width`` years (oneself included), and the first ``limit`` names by ``ord``.

    No pairs of people are made: years are few, so people are counted and cut to
    ``limit`` by year first, and the band is joined between years.
    """
    born = people.where("birth_year is not null")
    per_year = born.groupBy("birth_year").agg(F.count("*").alias("n"))
    w = Window.partitionBy("birth_year").orderBy("ord")
    first = born.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).groupBy("birth_year").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("firsts"))
    years = per_year.join(first, "birth_year")
    near = per_year.select(F.col("birth_year").alias("year"), F.explode(F.sequence(F.col("birth_year") - width, F.col("birth_year") + width)).alias("birth_year")).join(years, "birth_year")
    by_year = near.groupBy("year").agg(F.sum("n").alias("n_near"), F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, limit).alias("firsts"))
    return born.join(by_year, born["birth_year"] == by_year["year"]).select("pid", "n_near", F.col("firsts.name").alias("near_names"))


def snapshot(people: DataFrame, source_kind: str = "people_timeline_enriched") -> DataFrame:
    """One nested row a person: source record, candidate and canonical entity with its fields' provenance."""
    sid = F.concat(F.lit("src-"), person_key(F.col("name"), F.col("birth_year"), "-"))
    eid = person_key(F.col("name"), F.col("birth_year"), "-")

    def field(value: Column, confidence: float) -> Column:
        v = value.cast("string")
        return F.struct(v.alias("mergedValue"), v.alias("effectiveValue"), F.lit("merged").alias("precedence"), F.array(F.struct(v.alias("value"), sid.alias("sourceRecordId"), F.lit(confidence).alias("confidence"))).alias("values"))

    public = public_portrait(F.col("portrait_url")) if "portrait_url" in people.columns else F.lit(False)
    return people.select(
        F.struct(sid.alias("id"), F.lit(source_kind).alias("kind"), F.col("name").alias("label")).alias("sourceRecord"),
        F.struct(F.concat(F.lit("cand-"), eid).alias("id"), eid.alias("entityId"), F.lit(0.9).alias("confidence")).alias("candidate"),
        F.struct(eid.alias("id"), field(F.col("name"), 0.9).alias("displayName"), field(F.col("birth_year"), 0.8).alias("birthYear"), field(F.col("death_year"), 0.8).alias("deathYear"), field(F.col("field"), 0.4).alias("field"), F.when(public, "public").otherwise("draft").alias("status")).alias("canonicalEntity"),
    )


def public_portrait(url: Column) -> Column:
    return ~F.coalesce(url, F.lit("")).isin("", "Picture")

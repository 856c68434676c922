"""The roster as a published snapshot: source records, candidates, canonical entities and what goes with them.

Each part is a table with a nested row a person, so it is written by tasks side by
side; a document's totals are counts of the same rows.  Values of unlike kinds
(names, years, lists) stand in one list as VARIANT.  Columns that a roster lacks
count as null, lists as empty.  Names of fields, prefixes of ids and constant texts
are fixed values: those that readers of a snapshot look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import domains, nonempty, norm, person_key

from .people import public_portrait

# How sure a source is of a field, a record, a portrait.
NAME, DOMAIN, RECORD, PORTRAIT = 0.9, 0.4, 0.8, 0.8
KIND = "people_enriched"
LISTS = ("schools", "cognitive_tags", "math_tags", "domain_tags", "pipeline_flags")


def _of(people: DataFrame, name: str, kind: str = "string") -> Column:
    if name in people.columns:
        return F.coalesce(F.col(name), F.array().cast(kind)) if kind.startswith("array") else F.col(name)
    return F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)


def _variant(c: Column) -> Column:
    return c.cast("variant")


def prepared(people: DataFrame) -> DataFrame:
    """The roster with its snapshot ids and hints: ``slug, src, entity, hints, portrait``; ``ord`` is a person's place."""
    slug = person_key(F.col("name"), F.col("birth_year"), "-")
    wanted = {"person_id": "string", "calculus_name": "string", "wikipedia_url": "string", "wikipedia_wikidata_id": "string", "wikipedia_article_text_path": "string", "wikipedia_citations_path": "string", "wikipedia_description": "string", "portrait_url": "string", "country": "string", "field": "string", "cluster_id": "string", "calculus_number": "int", "centrality_score": "double"} | dict.fromkeys(LISTS, "array<string>")
    out = people.select("name", "birth_year", "death_year", "ord", *(_of(people, n, k).alias(n) for n, k in wanted.items())).withColumn("slug", slug)
    named = {"src": F.concat(F.lit("source_record_curated_"), "slug"), "entity": F.concat(F.lit("person_"), "slug"), "hints": domains(F.col("field")), "pid": F.coalesce("person_id", person_key(F.col("name"), F.col("birth_year")))}
    out = out.withColumns(named)
    picture = F.struct(
        F.concat(F.lit("source_media_curated_"), "slug").alias("id"), F.col("src").alias("sourceRecordId"), F.concat("name", F.lit(" portrait")).alias("label"), F.lit("portrait").alias("kind"),
        F.col("portrait_url").alias("publicAssetPath"), F.lit(True).alias("isPreferred"),
    )
    shown = nonempty(F.col("wikipedia_url")) & public_portrait(F.col("portrait_url"))
    return out.withColumn("portraits", F.filter(F.array(F.when(shown, picture)), lambda p: p.isNotNull()))


def _value(field: str, value: Column, confidence: float, kind: str) -> Column:
    return F.struct(F.lit(field).alias("field"), _variant(value).alias("value"), F.lit(kind).alias("sourceKind"), F.col("src").alias("sourceRecordId"), F.lit(confidence).alias("confidence"))


def source_records(people: DataFrame, kind: str = KIND, file_name: str = "people_enriched.json") -> DataFrame:
    """What the roster says of each person, field by field, with where it stands and how sure it is."""
    p = prepared(people)
    given = [("displayName", F.col("name"), NAME, "name"), ("birthYear", F.col("birth_year"), NAME, "birth_year"), ("deathYear", F.col("death_year"), NAME, "death_year"), ("domainIds", F.col("hints"), DOMAIN, "field")]
    values = [_value(f, v, c, kind).withField("rawPath", F.lit(raw)) for f, v, c, raw in given]
    picture = _value("preferredPortrait", F.get("portraits", F.lit(0))["id"], PORTRAIT, kind).withField("rawPath", F.lit("portrait_url"))
    raw = F.struct(F.col("ord").alias("index"), "name", "birth_year", "death_year", "field", "country", "calculus_name", "calculus_number", F.col("pid").alias("person_id"))
    wiki = F.when(nonempty(F.col("wikipedia_url")), F.struct(F.col("wikipedia_url").alias("url"), F.col("wikipedia_wikidata_id").alias("wikidataId"), F.col("wikipedia_article_text_path").alias("articlePath"), F.col("wikipedia_citations_path").alias("citationsPath")))
    none = F.array().cast("array<string>")
    return p.select(
        F.col("src").alias("id"), F.lit(kind).alias("kind"), F.lit("curated_person").alias("recordType"), F.col("ord").cast("string").alias("externalId"), F.col("name").alias("title"), F.col("name").alias("displayName"), "slug",
        norm(F.col("name")).alias("normalizedDisplayName"), F.concat(F.lit(f"{file_name}#row["), F.col("ord").cast("string"), F.lit("]")).alias("sourcePath"), F.col("birth_year").alias("birthYear"), F.col("death_year").alias("deathYear"),
        none.alias("aliases"), F.col("hints").alias("domainHints"), F.slice("schools", 1, 3).alias("traditionHints"), F.when(nonempty(F.col("country")), F.array("country")).otherwise(none).alias("placeHints"), raw.alias("rawFields"),
        F.concat(F.array(*values), F.when(F.size("portraits") > 0, F.array(picture)).otherwise(F.slice(F.array(picture), 1, 0))).alias("fieldValues"), F.col("portraits").alias("portraitCandidates"), F.lit(RECORD).alias("confidence"), wiki.alias("wikipedia"),
    )


def _resolved(merged: Column, values: Column, effective: Column | None = None) -> Column:
    """A field as it is resolved: the merged value, the one in effect, and the values that it comes from."""
    e = _variant(merged) if effective is None else effective
    return F.struct(_variant(merged).alias("mergedValue"), e.alias("effectiveValue"), F.lit("merged").alias("precedence"), values.alias("values"), F.array().cast("array<string>").alias("provenance"))


def canonical_entities(people: DataFrame, generated_at: str, kind: str = KIND) -> DataFrame:
    """Each person as an entity: resolved fields with their sources, no conflicts as yet, and the roster's own data."""
    p = prepared(people)
    text = lambda: F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    told = lambda f, v, c: F.array(_value(f, v, c, kind))
    empty = F.slice(told("", nothing, NAME), 1, 0)
    about = F.coalesce(F.when(nonempty(F.col("wikipedia_description")), F.col("wikipedia_description")), F.concat("name", F.lit(", "), F.coalesce(F.when(nonempty(F.col("calculus_name")), F.col("calculus_name")), F.lit("historical figure")), F.lit(".")))
    picture = F.get("portraits", F.lit(0))["id"]
    return p.select(
        F.col("entity").alias("id"), F.lit("person").alias("entityType"), "slug", F.lit("singleton").alias("mergeStatus"), F.lit("draft").alias("reviewStatus"), F.lit("draft").alias("visibility"), F.lit(RECORD).alias("mergeConfidence"),
        text().alias("mergeSignals"), text().alias("fieldConflicts"), F.array("src").alias("sourceRecordIds"), F.col("portraits").alias("portraitCandidates"), F.lit(generated_at).alias("updatedAt"),
        _resolved(F.col("name"), told("displayName", F.col("name"), NAME)).alias("displayName"), _resolved(text(), empty).alias("aliases"),
        _resolved(F.col("birth_year"), told("birthYear", F.col("birth_year"), NAME)).alias("birthYear"), _resolved(F.col("death_year"), told("deathYear", F.col("death_year"), NAME)).alias("deathYear"),
        _resolved(about, empty, _variant(F.col("wikipedia_description"))).alias("summary"), _resolved(F.col("hints"), told("domainIds", F.col("hints"), DOMAIN)).alias("domainIds"),
        _resolved(text(), empty).alias("traditionIds"), _resolved(text(), empty).alias("tagIds"), _resolved(picture, empty, _variant(nothing)).alias("preferredPortrait"),
        F.struct("calculus_number", "calculus_name", F.col("pid").alias("person_id"), *LISTS[:4], "centrality_score", "cluster_id", "pipeline_flags").alias("metadata"),
    )


def candidates(people: DataFrame) -> DataFrame:
    """Each person as a candidate for merging."""
    p = prepared(people)
    key = norm(F.col("name"))
    return p.select(F.concat(F.lit("candidate_"), "slug").alias("id"), F.lit("person").alias("entityType"), F.col("name").alias("displayName"), key.alias("normalizedName"), F.filter(F.split(key, r"(?U)\s+"), lambda t: t != "").alias("nameTokens"), F.col("birth_year").alias("birthYear"), F.col("death_year").alias("deathYear"), F.col("hints").alias("domainIds"), F.array("src").alias("sourceRecordIds"), F.col("portraits").alias("portraitCandidates"), F.lit(RECORD).alias("confidence"))


def summary(people: DataFrame) -> DataFrame:
    """The snapshot's counts, one row."""
    public = public_portrait(_of(people, "portrait_url"))
    n = F.count("*")
    return people.agg(n.alias("curatedRecordCount"), F.lit(0).alias("wikipediaRecordCount"), n.alias("candidateCount"), n.alias("canonicalEntityCount"), F.count_if(public).alias("publicEntityCount"), F.count_if(~public).alias("draftEntityCount"))


def publish(people: DataFrame, path: str, generated_at: str) -> None:
    """The snapshot's parts as JSON lines under ``path``, one folder a part; each is replaced whole."""
    parts = {"sourceRecords": source_records(people), "canonicalEntities": canonical_entities(people, generated_at), "candidates": candidates(people), "summary": summary(people).withColumn("generatedAt", F.lit(generated_at))}
    for name, rows in parts.items():
        rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


# The kinds of records of the two drive feeds.
DRIVE_INDEX = {"index": "indexRecordCount", "queue_entity": "queueEntityCount", "proposed_addition": "proposedAdditionCount"}
DRIVE_SEMANTIC = {"embedding": "embeddingCount"}


def drive_payload(records: DataFrame, kinds: dict[str, str], path: str | None = None) -> DataFrame:
    """The counts of a feed's kinds of records, one row; with ``path``, the records too, as JSON lines by kind."""
    wanted = records.where(F.col("record_type").isin(*kinds))
    if path:
        wanted.write.mode("overwrite").partitionBy("record_type").json(path)
    return wanted.agg(*(F.count_if(F.col("record_type") == k).alias(n) for k, n in kinds.items()))

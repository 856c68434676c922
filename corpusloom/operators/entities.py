"""Extracted people and relations: cleaning of model output and merging into the roster."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import eras
from corpusloom.functions.text import let, norm
from corpusloom.functions.unicode import match_key
from corpusloom.sources.json import strict

from .rewrites import suffix_owner

# Where evidence may come from.
EVIDENCE = ("in_source_text_direct", "secondary_source_inferred", "llm_training_knowledge", "llm_prior_pass_recalled", "research_task_queued")
DEFAULT_EVIDENCE = "llm_training_knowledge"
PERSON = "name string, birth_year int, death_year int, calculus_number int, nationality string, occupation string, evidence string"
RELATION = "subject string, predicate string, object string, evidence string"


def _ddl(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in fields.split(", ")))


RESPONSE = f"struct<persons: array<struct<{_ddl(PERSON)}>>, relationships: array<struct<{_ddl(RELATION)}>>>"


def known_evidence(e: Column) -> Column:
    return F.when(e.isin(*EVIDENCE), e).otherwise(F.lit(DEFAULT_EVIDENCE))


def cleaned(raw: Column) -> Column:
    """A model's answer as ``persons`` and ``relationships``; null where there is no JSON object.

    Fences are dropped and the text from the first ``{`` to the last ``}`` is read.
    Persons are unique by lower-cased name (the first stays, blank ones go), their
    eras are raised to the floor of their birth year, unknown evidence becomes the
    default, and relations stay whose object is one of the persons.
    """
    body = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?\s*|\s*```", ""), r"(?s)\{.*\}", 0)
    key = lambda c: norm(F.coalesce(c, F.lit("")))

    def persons(data: Column) -> Column:
        given = F.coalesce(data["persons"], F.array().cast(f"array<struct<{_ddl(PERSON)}>>"))
        first = let(F.transform(given, lambda p: key(p["name"])), lambda keys: F.filter(given, lambda p, i: (keys[i] != "") & (F.array_position(keys, keys[i]) == i + 1)))
        return F.transform(first, lambda p: p.withField("calculus_number", eras.raised(p["calculus_number"], p["birth_year"])).withField("evidence", known_evidence(p["evidence"])))

    def both(data: Column, fixed: Column) -> Column:
        given = F.coalesce(data["relationships"], F.array().cast(f"array<struct<{_ddl(RELATION)}>>"))
        kept = let(F.transform(fixed, lambda p: key(p["name"])), lambda names: F.filter(given, lambda r: F.array_contains(names, key(r["object"]))))
        kept = F.transform(kept, lambda r: r.withField("evidence", known_evidence(r["evidence"])))
        return F.struct(fixed.alias("persons"), kept.alias("relationships"))

    parsed = let(body, lambda b: F.from_json(F.when(strict(b).isNotNull(), b), RESPONSE))
    return let(parsed, lambda data: F.when(data.isNotNull(), let(persons(data), lambda fixed: both(data, fixed))))


def era_distribution(persons: DataFrame, by: str) -> DataFrame:
    """How many persons of a file each era has; those without an era don't count."""
    return persons.where("calculus_number is not null").groupBy(by, eras.label(F.col("calculus_number")).alias("era")).agg(F.count("*").alias("n"))


def semantic_relation(file_name: Column, subject: Column, predicate: Column, obj: Column, evidence: Column, by: str = "extraction") -> Column:
    """An extracted relation as an edge; ``by`` says in its provenance what found it."""
    return F.struct(
        F.coalesce(subject, F.lit("")).alias("source"), F.coalesce(obj, F.lit("")).alias("target"), F.coalesce(predicate, F.lit("related to")).alias("relation_type"), F.lit(1.0).alias("weight"), F.lit("low").alias("confidence"),
        F.coalesce(evidence, F.lit(DEFAULT_EVIDENCE)).alias("evidence_type"), F.concat(F.lit(f"{by}:"), file_name).alias("provenance"), F.lit("ai_hypothesis").alias("assertion_layer"),
    )


def suffix_matches(names: DataFrame, roster: DataFrame) -> DataFrame:
    """``names`` (``name``) with the one roster key that ends in them, for names of two words or more without an exact match.

    Every key counts, also several keys of one person, so two keys make a name ambiguous.
    """
    n = names.select("name", match_key(F.col("name")).alias("nkey")).where("nkey <> ''").distinct()
    keys = roster.select(match_key(F.col("name")).alias("key"), "pid", "ord").where("key <> ''")
    keys = keys.groupBy("key").agg(F.max_by("pid", "ord").alias("pid"))
    missed = n.join(keys, n["nkey"] == keys["key"], "left_anti").where(F.contains("nkey", F.lit(" ")))
    return suffix_owner(missed, "nkey", keys, "key", "pid").select("name", "pid")


def resolve_exact(people: DataFrame, extracted: DataFrame) -> DataFrame:
    """Order-free part of the merge: each extracted (``file_name``, ``name``, ``ord``) with its person, or the new person its key makes.

    A key that no person has becomes one new person, made by its first occurrence.
    """
    keys = people.select(match_key(F.col("name")).alias("key"), F.col("pid").cast("string").alias("person"), "ord").where("key <> ''")
    keys = keys.groupBy("key").agg(F.max_by("person", "ord").alias("person"))
    e = extracted.withColumn("key", match_key(F.col("name"))).where("key <> ''")
    return e.join(keys, "key", "left").withColumn("is_new", F.col("person").isNull()).withColumn("person", F.coalesce("person", F.concat(F.lit("new:"), F.col("key"))))


def source_files(resolved: DataFrame) -> DataFrame:
    """The files of each person, each once, in the order met."""
    first = resolved.groupBy("person", "file_name").agg(F.min("ord").alias("ord"))
    return first.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("ord", "file_name"))).alias("f")).select("person", F.col("f.file_name").alias("source_files"))


def merged_edges(resolved: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose subject is a known key, as edges of that person, each (source, target, type) once, the first in order."""
    keys = resolved.select("key", "person").distinct()
    r = relations.withColumn("key", match_key(F.coalesce("subject", F.lit("")))).where("key <> ''").join(keys, "key")
    r = r.select("person", "ord", F.coalesce("subject", F.lit("")).alias("source"), F.coalesce("object", F.lit("")).alias("target"), F.coalesce("predicate", F.lit("related to")).alias("relation_type"), "file_name", "evidence")
    # only what the first relation tells is carried; the rest of an edge is made of its key, or always the same
    first = r.groupBy("person", "source", "target", "relation_type").agg(F.min_by(F.struct("ord", "file_name", "evidence"), "ord").alias("r"))
    edge = semantic_relation(F.col("r.file_name"), F.col("source"), F.col("relation_type"), F.col("target"), F.col("r.evidence"))
    return first.select("person", F.col("r.ord").alias("ord"), edge.alias("e")).select("person", "ord", "e.*")


# --- the whole merge, in order ------------------------------------------------------

def _key(name: str | None) -> str:
    plain = unicodedata.normalize("NFD", name or "").encode("ascii", "ignore").decode("ascii")
    return " ".join(plain.split()).lower()


class Merge:
    """People and the keys they are known by, as files come in: new people and aliases are matched from then on."""

    def __init__(self) -> None:
        self.by_key: dict[str, str] = {}
        self.by_last: dict[str, set[str]] = {}
        self.since: dict[str, object] = {}

    def know(self, key: str, person: str, since=None) -> None:
        self.by_key[key] = person
        self.since[key] = since
        self.by_last.setdefault(key.rsplit(" ", 1)[-1], set()).add(key)

    def find(self, key: str) -> str | None:
        if key in self.by_key:
            return self.by_key[key]
        if " " not in key:
            return None
        ends = [k for k in self.by_last.get(key.rsplit(" ", 1)[-1], ()) if k.endswith(key)]
        return self.by_key[ends[0]] if len(ends) == 1 else None

    def person(self, name: str, at=None) -> tuple[str, bool] | None:
        key = _key(name)
        if not key:
            return None
        found = self.find(key)
        if found is None:
            found = "new:" + key
            self.know(key, found, at)
            return found, True
        if key not in self.by_key:
            self.know(key, found, at)
        return found, False


def known_names(people: DataFrame, persons: DataFrame, subjects: DataFrame) -> DataFrame:
    """What each name means: ``stage`` (1 a name of ``persons``, 2 of ``subjects``), ``name``, ``person``, ``is_new``, ``since``.

    A key means one person from the moment it is known, so only the first
    occurrence of a name walks through the merge; ``is_new`` says that it made the
    person, ``since`` is the ``file_ord`` from which its key is known (null: from
    the start).  Subjects make nothing known; those never known are left out.

    A suffix match depends on the names known at that moment.  An end of two words
    or more covers the last word and the letter before it, so names interact only
    if their keys agree in both (or are one word, and equal).  Each such tail is a
    group of its own that runs through its files in order (``file_ord``, text or
    number), so a last word that half of all names have is many groups.  Rows are
    sorted and stream past; a task holds the keys of one tail.
    """
    tail = F.regexp_extract(match_key(F.coalesce("name", F.lit(""))), r"(?:[^ ] )?[^ ]+$", 0)
    kind = persons.schema["file_ord"].dataType
    none = F.lit(None)
    last = people.groupBy("name").agg(F.max(F.struct("ord", F.col("pid").cast("string").alias("person"))).alias("r"))
    first = persons.groupBy("name").agg(F.min(F.struct("file_ord", "ord")).alias("r"))
    rows = (
        last.select("name", F.lit(0).alias("stage"), F.col("r.ord").alias("ord"), none.cast(kind).alias("file_ord"), "r.person")
        .unionByName(first.select("name", F.lit(1).alias("stage"), F.col("r.ord").alias("ord"), F.col("r.file_ord").alias("file_ord"), none.cast("string").alias("person")))
        .unionByName(subjects.select("name").distinct().select("name", F.lit(2).alias("stage"), none.cast("long").alias("ord"), none.cast(kind).alias("file_ord"), none.cast("string").alias("person")))
    )
    schema = StructType([StructField("stage", IntegerType()), StructField("name", StringType()), StructField("person", StringType()), StructField("is_new", BooleanType()), StructField("since", kind)])

    def run(batches):
        at, m, kinds = None, Merge(), to_arrow_schema(schema)
        for batch in batches:
            out = []
            for last_, stage, name, file_ord, person in zip(*(c.to_pylist() for c in batch.columns)):
                if last_ != at:
                    at, m = last_, Merge()
                key = _key(name)
                if not key:
                    continue
                if stage == 0:
                    m.know(key, person)
                elif stage == 1:
                    found, made = m.person(name, file_ord)
                    out.append((stage, name, found, made, m.since[key]))
                elif key in m.by_key:
                    out.append((stage, name, m.by_key[key], False, m.since[key]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    # names without a key are passed over in the tasks, and dealt over them: a filter would be pushed below the aggregates and make a key for each row
    dealt = F.when(F.col("last") == "", F.col("name")).otherwise(F.col("last"))
    rows = rows.withColumn("last", tail).repartition(dealt).sortWithinPartitions("last", "stage", "file_ord", "ord", "name")
    return rows.select("last", "stage", "name", "file_ord", "person").mapInArrow(run, schema)


def resolve_all(people: DataFrame, persons: DataFrame, relations: DataFrame) -> DataFrame:
    """The ordered merge, suffix matches included: matches, new people and edges as rows.

    Only distinct names are merged in order (``known_names``); the rows themselves
    are joined with what their name means.  An edge is the first relation of its
    person, subject, object and type from the file on in which the subject's key
    is known; within a file persons come before relations.
    """
    r = relations.select(F.col("subject").alias("name"), F.coalesce("object", F.lit("")).alias("target"), F.coalesce("predicate", F.lit("related to")).alias("relation_type"), "file_ord", F.col("ord").cast("long").alias("ord"), "file_name", F.coalesce("evidence", F.lit(DEFAULT_EVIDENCE)).alias("evidence_type"))
    known = known_names(people, persons, r)
    null = lambda n: F.lit(None).cast("string").alias(n)

    nth = F.row_number().over(Window.partitionBy("name").orderBy("file_ord", "ord"))
    e = persons.select("name", "file_ord", F.col("ord").cast("long").alias("ord"), "file_name").withColumn("nth", nth).join(known.where("stage = 1").select("name", "person", "is_new").hint("shuffle_hash"), "name")
    found = e.select("person", "name", F.when(F.col("is_new") & (F.col("nth") == 1), "new").otherwise("match").alias("kind"), "file_name", null("source"), null("target"), null("relation_type"), null("evidence_type"), "ord")

    r = r.join(known.where("stage = 2").select("name", "person", "since").hint("shuffle_hash"), "name").where("since is null or file_ord >= since")
    first = r.groupBy("person", "name", "target", "relation_type").agg(F.min(F.struct("file_ord", "ord", "file_name", "evidence_type")).alias("r"))
    edges = first.select("person", "name", F.lit("edge").alias("kind"), "r.file_name", F.col("name").alias("source"), "target", "relation_type", "r.evidence_type", "r.ord")
    return found.unionByName(edges)

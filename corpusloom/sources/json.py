"""JSON documents and line feeds, read as tolerantly as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let, strip

FEEDS = ("index", "queue_entity", "proposed_addition")


def strict(text: Column) -> Column:
    """A text as VARIANT if all of it is one JSON value, else null.

    The parser ignores what follows a value, so the text is read as the only
    element of an array and as the only field of an object: nothing but a whole
    value passes both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    first = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull() & named.isNotNull(), F.try_variant_get(v, "$[0]", "variant"))
    return let(listed, first)


def objects(line: Column) -> Column:
    """A line as VARIANT if it holds a JSON object, else null."""
    return let(strict(line), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT a line; blank, broken and other lines are dropped.  A missing file has no lines."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    return text.select(objects(F.col("value")).alias("record")).where("record is not null")


def people(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The people of a document that is a list or has them under ``people``; a byte order mark is ignored."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
    whole = F.coalesce(F.from_json("v", f"struct<people: array<struct<{schema}>>>")["people"], F.from_json("v", f"array<struct<{schema}>>"))
    return raw.select(F.inline(whole))


def response_lines(raw: Column) -> Column:
    """The objects of a model's answer: one a line, or the elements of one array; fences are dropped.  An array of JSON texts."""
    body = strip(F.regexp_replace(raw, r"```(?:jsonl?|json)?", ""))
    listed = F.transform(F.from_json(body, "array<variant>"), lambda v: v)
    single = F.filter(F.transform(F.split(body, "\n"), lambda ln: objects(ln)), lambda v: v.isNotNull())
    return F.when(F.startswith(body, F.lit("[")) & listed.isNotNull(), listed).otherwise(single)


def routed(records: DataFrame, kind: str = "record_type", kinds: tuple[str, ...] = FEEDS) -> dict[str, DataFrame]:
    """The records of each feed; other kinds (processing reports) belong to none."""
    return {k: records.where(F.col(kind) == k) for k in kinds}


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)

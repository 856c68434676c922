"""Writers: keyed upserts, replaced partitions, JSON and LaTeX files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_files(chunks: DataFrame, path: str) -> None:
    """Write chunks so that those of a file that is indexed again take the place of its old ones."""
    (chunks.repartition("source_file_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file_id").parquet(path))


def load_once(df: DataFrame, table: str, reset: bool = False) -> bool:
    """Fill a table unless it has rows; says whether it did."""
    spark = df.sparkSession
    if not reset and spark.catalog.tableExists(table) and not spark.table(table).isEmpty():
        return False
    df.write.mode("overwrite").saveAsTable(table)
    return True


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def route_json(records: DataFrame, path: str, kind: str = "record_type") -> None:
    """One folder a kind of record, in one pass."""
    records.write.mode("append").partitionBy(kind).json(path)


def write_json_document(value: dict, path: str) -> None:
    """A small JSON document, written beside its place and moved there."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(tmp, path)


def enriched(people: DataFrame, tags: DataFrame, suggested: DataFrame, relations: DataFrame) -> DataFrame:
    """The enriched roster's parts as JSON rows: ``part``, ``record``; one superset layout for both of its writers."""
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
    return part(people, "people").union(part(tags, "suggested_tags_registry")).union(part(suggested, "suggested_people_registry")).union(part(relations, "ai_relationships"))


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One folder a document with its text in it."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)

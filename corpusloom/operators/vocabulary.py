"""Closed tag vocabularies in text files: sections under headings, groups between blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def sections(lines: DataFrame, headings: dict[str, str], by: list[str] | None = None, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """``section, group_no, pos, tag`` for each line of a file (``by`` names the file).

    A line that starts with a heading opens its section; blank lines end groups.
    A vocabulary is one small file, so its lines meet in one task in order.
    """
    by = by or []
    s = strip(F.col(line))
    section = F.lit(None).cast("string")
    for head, name in reversed(headings.items()):
        section = F.when(F.startswith(s, F.lit(head)), name).otherwise(section)
    order = Window.partitionBy(*by).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    r = lines.select(*by, F.col(line_no).alias("n"), s.alias("tag"), section.alias("opens"))
    order = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("section", F.last("opens", ignorenulls=True).over(order))
    r = r.withColumn("island", F.sum(F.when((F.col("tag") == "") | F.col("opens").isNotNull(), 1).otherwise(0)).over(order))
    r = r.where("section is not null and opens is null and tag <> ''")
    in_section = Window.partitionBy(*by, "section").orderBy("n")
    return r.select(*by, "section", F.dense_rank().over(Window.partitionBy(*by, "section").orderBy("island")).alias("group_no"), F.row_number().over(in_section).alias("pos"), "tag", "n")


def tag_sections(tags: DataFrame) -> DataFrame:
    """Each tag's section; of several the last in file order."""
    return tags.groupBy("tag").agg(F.max_by("section", "n").alias("section"))


def unknown_tags(used: DataFrame, tags: DataFrame) -> DataFrame:
    """Used tags that no vocabulary has."""
    return used.join(tags.select("tag").distinct(), "tag", "left_anti")

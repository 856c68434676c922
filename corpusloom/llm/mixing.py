"""Mixing sources to target weights: weighted sampling by exponential keys.

DataFrame functions only.  A document's size is its number of words
(``[^\\x20\\x09-\\x0D]+``).  The budget, ``SHARE`` of all sizes, is shared over the
sources by weight; a target stops at ``CAP`` times its source's size and the
excess goes to the others by weight (a water level, found from prefix sums over
the sources in the order of their caps).  In a source each document has the key
``-ln(u) / w``, where ``u`` comes from a hash of its id and ``w`` is its quality
weight (Efraimidis and Spirakis: ascending keys are a weighted sample without
replacement).  A target takes as many complete epochs of the source as it holds;
the rest goes to documents by ascending key, as long as the middle of the
document lies within it, so that the sum is within half a document of the target.

Prefix sums are taken in two levels: each source's keys are cut into ``BINS``
ordered bins, sums over bins give each bin's offset, and rows are only sorted
within their bin, so a source with a third of all rows is spread over many tasks.

Defined results: a null or empty text has size 0 and is taken 0 times; null
sources are one source, the last; repeated rows (and ids) are documents of their
own; equal keys go by id, then size, then what else the row holds; an empty table
gives no rows; ``mix`` keeps extra columns and puts its own under a prefix that no
column of the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: less where more of the text is symbols."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * symbols / F.greatest(F.lit(1), F.length(text)))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a hash of ``key``."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def _sized(docs: DataFrame, weight: Column | None, carried: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    w = quality_weight(text) if weight is None else F.greatest(weight, F.lit(1e-6))
    key = -F.ln(uniform(F.col("doc_id"))) / w
    out = docs.select(*carried, "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    # a text key that no null can equal; the bin rises with the key
    return out.withColumns({"skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "bin": F.floor(F.col("key") / (F.col("key") + 1) * BINS).cast("int")})


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a source (``skey``, ``source``, ``source_size``) with its ``target``.  One row a source meets in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last(), "skey")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    all_ = Window.partitionBy()
    rows = sources.withColumn("w", w.cast("double")).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    rows = rows.withColumns({"budget": F.sum("source_size").over(all_) * share, "all_w": F.sum("w").over(all_), "ratio": F.col("limit") / F.col("w")})
    up = Window.orderBy("ratio", "skey")
    before = F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before_w = F.coalesce(F.sum("w").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("budget") - before) / (F.col("all_w") - before_w))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "skey", "level"))).over(all_)["level"]
    return rows.select("skey", "source", "source_size", F.coalesce(F.least("limit", level * F.col("w")), F.col("limit")).alias("target"))


def plan(docs: DataFrame, weight: Column | None = None, carried: list[str] | None = None) -> DataFrame:
    """Each document with ``size``, ``source_size``, ``target`` and ``copies`` (how many times the mix takes it).

    ``carried`` columns stay; those without maps also settle ties that size leaves.
    """
    rows = cut(_sized(docs, weight, carried or []))  # narrow rows, read twice below
    bins = rows.groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"), F.first("source").alias("source"))
    sources = bins.groupBy("skey").agg(F.sum("bin_size").alias("source_size"), F.first("source").alias("source"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = bins.select("skey", "bin", before.alias("bin_before")).join(targets(sources).drop("source"), "skey")
    settles = [F.xxhash64(*held)] if (held := [c for c in carried or [] if "map<" not in rows.schema[c].dataType.simpleString()]) else []
    in_bin = Window.partitionBy("skey", "bin").orderBy("key", "doc_id", "size", *settles).rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = rows.join(offsets, ["skey", "bin"]).withColumn("end", F.col("bin_before") + F.sum("size").over(in_bin)).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(F.col("end") - F.col("size") / 2.0 <= rest, 1).otherwise(0)).otherwise(0)
    return out.withColumn("copies", copies.cast("int"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None, prefix: str = "mix_") -> DataFrame:
    """The mixed corpus: every column of a document, as many rows as the mix takes it, and ``mix_copy`` (0, 1, ...; the prefix is repeated while a column has that name)."""
    names = docs.columns
    copy = f"{prefix}copy"
    while copy.lower() in {n.lower() for n in names}:
        copy = prefix + copy
    packed = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))
    taken = plan(packed, weight, ["row"]).where("copies > 0")
    out = taken.select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return out.select(*(F.col("row")[n].alias(n) for n in names), F.col("copy").alias(copy))


#: DuckDB SQL for ``op10``.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size,
    -ln((cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id AS varchar), '')), 1, 13) AS bigint) + 0.5::double) / 4503599627370496.0::double)
      / greatest(0.1::double, 1.0::double - 4.0::double * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::double / greatest(1, length(coalesce(text, '')))::double) AS key
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::double AS w, (2 * source_size)::double AS cap FROM s),
t AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::double * 1.5::double AS budget, sum(w) OVER () AS all_w FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (all_w - coalesce(sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM t),
g AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level)), cap) AS target FROM l),
k AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  cast(size * (epochs + CASE WHEN size > 0 AND upto - size / 2.0::double <= target - epochs * source_size THEN 1 ELSE 0 END) AS bigint) AS taken
FROM k
"""

"""Exact deduplication: groups by a 128-bit content hash, compared by bytes.

DataFrame functions only.  One pass over the texts leaves a narrow row a
document (id, MD5 and SHA-256 of the normalised text, a tag), written once.
Grouping these rows by MD5, pre-aggregated in each task, gives a group's size and
the row that stays.  Bytes are compared in groups of two and more: their texts,
pre-aggregated too, so that a task sends each text once however many copies it
read, must be one text a group.  Groups that hold unlike texts (collisions, which
can be made on purpose) are grouped again by hash and text.

Texts of single documents aren't shuffled while the hashes of the groups take
``BROADCAST_BYTES`` at most, counted before they are broadcast; beyond that, all
texts are compared.  Groups with more than one row in ``HOT`` of all rows (so
``HOT`` groups at most) go to the rows by broadcast, all others by a shuffle on
the hash: no key of a shuffle holds more than one row in ``HOT``.

Defined results: a null text counts as empty, and all empty texts are one group;
the row with the largest id stays, a null id is smaller than any; of rows alike
in text and id one stays, settled by the rest of its columns (those without
maps); repeated rows are rows of their own; an empty table gives no rows; extra
columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Bytes that the hashes of all groups may take to be broadcast, and one over the share of all rows from which a group is.
BROADCAST_BYTES, HOT = 64 << 20, 4096
HASH_BYTES = 16
FLAGS = ("keep_id", "group_size", "kept", "text_sha256")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def _normal(text: Column, normal: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(text, F.lit(""))
    return normal(text) if normal else text


def _rows(docs: DataFrame, id_col: str, text: Column, carried: list[str], keep_text: bool = False) -> DataFrame:
    """``hash, sha, id, settles, tag, row`` and, where asked, ``text``: what stands of a document while groups are found."""
    rest = [F.col(f"`{c}`") for c in carried if c != id_col and "map<" not in docs.schema[c].dataType.simpleString()]
    cols = {
        "hash": content_hash(text), "sha": F.unhex(F.sha2(text, 256)), "id": F.col(f"`{id_col}`"), "settles": F.xxhash64(*rest) if rest else F.lit(0).cast("long"),
        "tag": F.monotonically_increasing_id(), "row": F.struct(*(F.col(f"`{c}`") for c in carried)) if carried else F.lit(None).cast("int"),
    } | ({"text": text} if keep_text else {})
    return docs.select(*(c.alias(n) for n, c in cols.items()))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("id", "settles", "tag")).alias("best")).where("n > 1")


def _told(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Each row with its group's ``n`` and ``best``; null for a row alone.  Large groups meet their rows by broadcast."""
    hot, cold = groups.where(F.col("n") * HOT > total), groups.where(F.col("n") * HOT <= total)
    large = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return large.unionByName(others)


def _collided(docs: DataFrame, text: Column, groups: DataFrame, n_groups: int) -> DataFrame:
    """Hashes of groups that hold unlike texts."""
    texts = docs.select(content_hash(text).alias("hash"), text.alias("text"))
    if n_groups * HASH_BYTES <= BROADCAST_BYTES:
        texts = texts.join(F.broadcast(groups.select("hash")), "hash", "left_semi")
    return texts.distinct().groupBy("hash").agg(F.count("*").alias("unlike")).where("unlike > 1").select("hash")


def _flagged(docs: DataFrame, id_col: str, text_col: str, normal: Callable[[Column], Column] | None, carried: list[str]) -> DataFrame:
    """``id, row`` and ``FLAGS`` of every row."""
    text = _normal(F.col(f"`{text_col}`"), normal)
    rows, _ = written(_rows(docs, id_col, text, carried), "dedup-rows")
    groups, _ = written(_groups(rows, ["hash"]), "dedup-groups")
    total = rows.count()
    collided, _ = written(_collided(docs, text, groups, groups.count()), "dedup-collisions")
    if collided.isEmpty():
        out = _told(rows, groups, ["hash"], total)
    else:
        apart, _ = written(_rows(docs, id_col, text, carried, keep_text=True).join(collided, "hash", "left_semi"), "dedup-apart")
        out = _told(rows.join(collided, "hash", "left_anti"), groups.join(collided, "hash", "left_anti"), ["hash"], total)
        out = out.unionByName(_told(apart, _groups(apart, ["hash", "text"]), ["hash", "text"], total).drop("text"))
    alone = F.col("best").isNull()
    flags = {"keep_id": F.when(alone, F.col("id")).otherwise(F.col("best.id")), "group_size": F.coalesce("n", F.lit(1)).cast("long"), "kept": alone | (F.col("best.tag") == F.col("tag")), "text_sha256": F.lower(F.hex("sha"))}
    return out.select("id", "row", *(c.alias(n) for n, c in flags.items()))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with ``FLAGS``; texts are equal when ``normal`` of them is identical.  ``_`` goes before the flags' names while a column has one of them."""
    names = docs.columns
    while {(prefix + f).lower() for f in FLAGS} & {n.lower() for n in names}:
        prefix = f"_{prefix}"
    out = _flagged(docs, id_col, text_col, normal, names)
    return out.select(*(F.col("row")[n].alias(n) for n in names), *(F.col(f).alias(prefix + f) for f in FLAGS))


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    return _flagged(docs, id_col, text_col, normal, docs.columns).where("kept").select(*(F.col("row")[n].alias(n) for n in docs.columns))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(table(spark, sf_dir, "documents"), "doc_id", "text", None, []).select(F.col("id").alias("doc_id"), *FLAGS)


#: DuckDB SQL for ``op11``.
OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""Joins and rankings rewritten so that they shuffle on equal keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from corpusloom.sources.scratch import stored


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` names a column for the position from 0.  Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    return out.withColumn(rank, F.col("__n") - 1).drop("__n") if rank else out.drop("__n")


def first_wins(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row a key, the one with the smallest ``order`` (the largest with ``last``): a partial aggregate, no sort."""
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*(F.col(c) for c in df.columns)), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(row).select("__row.*")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_wins(df, keys, order, last=True)


def band_pairs(left: DataFrame, right: DataFrame, left_on: str, right_on: str, width: int) -> DataFrame:
    """Rows of both sides with ``abs(left_on - right_on) <= width``: an equal join on the band and its neighbours."""
    a = left.where(F.col(left_on).isNotNull()).withColumn("__band", F.explode(F.array(*(F.floor(F.col(left_on) / width) + d for d in (-1, 0, 1)))))
    b = right.where(F.col(right_on).isNotNull()).withColumn("__band", F.floor(F.col(right_on) / width))
    return a.join(b, "__band").where(F.abs(F.col(left_on) - F.col(right_on)) <= width).drop("__band")


#: Follows every character, so a text with it added is the end of all texts that begin with the text.
_END = "\U0010ffff"


def suffix_owner(names: DataFrame, name: str, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """``names`` with the ``owner`` of the one row whose ``key`` ends in ``name``; names with no such key or several go.

    Read backwards, the keys that end in a name are a range of the sorted keys.
    Keys and both ends of each name's range are range-partitioned and sorted
    together, and streamed past: an end learns how many keys stand before it, and
    whose the last is.  The difference of a name's ends counts its keys, so no pair
    is made, and however many keys end alike, they are dealt over as many tasks as
    they fill.  Each partition adds one row with its own count.
    """
    kind = keys.schema[owner].dataType.simpleString()
    columns = [c for c in names.columns]
    held = F.struct(*columns)
    backwards = F.reverse(F.col(name))
    none = F.lit(None)
    rows = (
        keys.select(F.reverse(F.col(key)).alias("at"), F.lit(1).alias("mark"), F.col(owner).alias("owner"), none.cast(names.select(held.alias("n")).schema["n"].dataType).alias("n"))
        .unionByName(names.select(backwards.alias("at"), F.lit(0).alias("mark"), none.cast(kind).alias("owner"), held.alias("n")))
        .unionByName(names.select(F.concat(backwards, F.lit(_END)).alias("at"), F.lit(2).alias("mark"), none.cast(kind).alias("owner"), held.alias("n")))
    )
    out_schema = rows.select("n", "mark", F.lit(0).alias("part"), F.lit(0).cast("long").alias("count"), "owner").schema
    out_schema = StructType([StructField(f.name, f.dataType) for f in out_schema])

    def run(batches):
        part, count, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            mark = b.column(0).to_numpy(zero_copy_only=False)
            is_key = mark == 1
            counts = count + np.cumsum(is_key)
            at = np.maximum.accumulate(np.where(is_key, np.arange(len(mark)), -1))
            # owners of the last key before each row; those before the batch come from the batch before
            owners = pa.concat_arrays([pa.array([last], b.column(1).type), b.column(1)])
            ends = np.flatnonzero(~is_key)
            if len(ends):
                take = pa.array(ends)
                yield pa.RecordBatch.from_arrays([b.column(2).take(take), b.column(0).take(take), pa.array(np.full(len(ends), part), pa.int32()), pa.array(counts[ends]), owners.take(pa.array(at[ends] + 1))], names=["n", "mark", "part", "count", "owner"])
            if len(mark):
                count, last = int(counts[-1]), owners[int(at[-1]) + 1].as_py()
        kinds = to_arrow_schema(out_schema)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, 9, part, count, last), kinds)], names=kinds.names)

    ends = stored(rows.repartitionByRange("at").sortWithinPartitions("at", "mark").select("mark", "owner", "n").mapInArrow(run, out_schema), "ends")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = ends.where("mark = 9").select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("counted"), F.last("owner", ignorenulls=True).over(before).alias("passed"))
    place = ends.where("mark <> 9").join(F.broadcast(parts), "part").select("n", "mark", (F.col("count") + F.col("counted")).alias("count"), F.coalesce("owner", "passed").alias("owner"))
    first, last = F.min(F.when(F.col("mark") == 0, F.col("count"))), F.max(F.when(F.col("mark") == 2, F.col("count")))
    found = place.groupBy("n").agg((last - first).alias("hits"), F.max(F.when(F.col("mark") == 2, F.struct("owner"))).alias("o"))
    return found.where("hits = 1").select("n.*", F.col("o.owner").alias(owner))

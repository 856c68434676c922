"""Incremental forms: files that arrive, events in windows, state that lasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def watch(new: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None, seconds: int | None = None) -> StreamingQuery:
    """Runs ``work`` on each batch of new rows and writes its result once.

    A batch's folder carries its number, so a batch that is run again after a
    failure replaces what it wrote.  Without ``seconds`` what is there is
    processed and the query ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        done = work(df)
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after:
            after(df.sparkSession.read.parquet(f"{out}/batch={number}"))

    w = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)
    return w.start()


def timed(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as a time with zone, which a watermark needs."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _late(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    return _late(timed(events), late).groupBy(F.window("ts", size), *keys).agg(*aggs)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    return _late(timed(events), late).groupBy(F.window("ts", size, step), *keys).agg(*aggs)


def sessions(events: DataFrame, gap: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    return _late(timed(events), late).groupBy(F.session_window("ts", gap).alias("window"), *keys).agg(*aggs)


def first_of(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; in a stream, within the watermark."""
    e = timed(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)


def smoothed(events: DataFrame, key: str, alpha: float, seed: float) -> DataFrame:
    """The running exponential average of each key's values, kept as state across batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        (value,) = state.get if state.exists else (seed,)
        for f in frames:
            for v in f.sort_values("ts")["value"]:
                value = alpha * v + (1 - alpha) * value
        state.update((value,))
        yield pd.DataFrame({key: [k[0]], "ema": [value]})

    kind = events.schema[key].dataType.simpleString()
    return timed(events).select(key, "ts", "value").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ema double", "ema double", "update", GroupStateTimeout.NoTimeout)

"""Failed files that come back after growing waits: retries as state of a stream.

Outcomes (``path, status, at``) come as a stream.  A failure sets a timer; when the
stream's time has passed it, the file is due again, each time after twice the wait, at
most ``most`` times, then it is given up.  A success clears the file's state and timer.
What was given up is forgotten after ``forget``, so that state doesn't grow without end.

State and timers are Spark's (``transformWithState`` on the RocksDB store), so they
outlast restarts, and a batch that is run again gives the rows it gave before.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST, WAIT, FORGET = 5, 15 * 60, 30 * 24 * 3600
DUE = "path string, retry int, status string, due timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """While a query starts that keeps such state; what was set before is set again."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Retries(StatefulProcessor):
    """``failures`` counts a file's failures in a row, ``handled`` is the time of the outcome that was counted last (ms)."""

    def __init__(self, most: int, wait: int, forget: int) -> None:
        self.most, self.wait, self.forget = most, wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "failures int, handled long")

    def _clear(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given: list[tuple] = []
        outcomes = pd.concat(list(rows)).sort_values(["at", "status"])
        for status, at in zip(outcomes["status"], outcomes["at"]):
            ms = int(at.timestamp() * 1000)
            failures, handled = self.state.get() if self.state.exists() else (0, -1)
            if ms <= handled:
                continue  # older than what is known, or the same again
            if status != "error":
                self._clear()
                continue
            if failures > self.most:
                continue  # given up
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            failures += 1
            self.state.update((failures, ms))
            if failures > self.most:
                given.append((key[0], failures - 1, "given up", pd.Timestamp(at)))
                self.handle.registerTimer(ms + 1000 * self.forget)
            else:
                self.handle.registerTimer(ms + 1000 * self.wait * 2 ** (failures - 1))
        if given:
            yield pd.DataFrame(given, columns=["path", "retry", "status", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, _ = self.state.get()
        if failures > self.most:
            self.state.clear()
            return
        yield pd.DataFrame([(key[0], failures, "retry", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=["path", "retry", "status", "due"])

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, most: int = MOST, wait: int = WAIT, forget: int = FORGET, late: str = "1 minute") -> DataFrame:
    """``path, retry, status`` (``retry`` or ``given up``) and ``due``, from a stream of outcomes; seconds in ``wait`` and ``forget``.

    Start the query within ``state_store``.  An outcome without a path or time is left out.
    """
    rows = outcomes.where(F.col("path").isNotNull() & F.col("at").isNotNull()).select("path", "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("path").transformWithStateInPandas(Retries(most, wait, forget), DUE, "Append", "EventTime")

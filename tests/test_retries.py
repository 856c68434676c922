"""Retries over restarts, and after a batch that was lost."""

import datetime as dt

import pytest

from corpusloom.streaming import retries as R

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_retries(spark, tmp_path):
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    spark.createDataFrame([], "path string, status string, at timestamp").write.parquet(source)
    lose = []

    def put(df, number):
        if lose:
            raise OSError(lose.pop())
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run(*outcomes):
        """A run of its own, as after a restart: state and timers come from the checkpoint."""
        spark.createDataFrame(list(outcomes), "path string, status string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, status string, at timestamp").parquet(source)
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        with R.state_store(spark):
            q = R.retries(stream, most=3, wait=60, forget=3600, late="0 seconds").writeStream.foreachBatch(put).option("checkpointLocation", mark).trigger(availableNow=True).start()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
        q.awaitTermination()

    def due():
        return sorted((r.path, r.retry, r.status, r.due) for r in spark.read.schema(R.DUE).parquet(out).select("path", "retry", "status", "due").collect())

    run(("a", "error", at(0)), ("b", "error", at(0)), ("c", "complete", at(0)), (None, "error", at(0)), ("d", "error", at(0)))
    assert due() == []
    run(("d", "complete", at(0.5)), ("tick", "complete", at(1.5)))  # a and b are due after a minute, d has come through
    first = [("a", 1, "retry", at(1)), ("b", 1, "retry", at(1))]
    assert due() == first
    lose.append("lost")
    with pytest.raises(Exception, match="lost"):
        run(("a", "error", at(2)), ("a", "error", at(2)), ("b", "complete", at(2)), ("tick", "complete", at(2.5)))
    assert due() == first
    run(("tick", "complete", at(3)))  # the batch that was lost is taken again, then the new one: two minutes aren't over
    assert due() == first
    run(("tick", "complete", at(4.5)))
    assert due() == sorted([*first, ("a", 2, "retry", at(4))])
    run(("a", "error", at(5)), ("tick", "complete", at(9.5)))
    run(("tick", "complete", at(10)))
    third = sorted([*first, ("a", 2, "retry", at(4)), ("a", 3, "retry", at(9))])
    assert due() == third
    run(("a", "error", at(11)), ("a", "error", at(10)))  # the fourth failure, and an older outcome
    run(("a", "error", at(20)), ("tick", "complete", at(21)))
    assert due() == sorted([*third, ("a", 3, "given up", at(11))])
    run(("tick", "complete", at(90)))  # forgotten: a new failure begins anew
    run(("a", "error", at(100)), ("tick", "complete", at(100.5)))
    run(("tick", "complete", at(102)))
    assert ("a", 1, "retry", at(101)) in due() and len(due()) == 6

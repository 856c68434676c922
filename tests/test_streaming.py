"""The streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from corpusloom.streaming import watch as W

from .oracle import DATA

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _split(spark, path, n=4):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    for i in range(n):
        e.where(F.col("event_id") % n == i).coalesce(1).write.mode("append").parquet(str(path))
    return e


def test_watch_processes_each_file_once(spark, tmp_path):
    e = _split(spark, tmp_path / "in")
    seen = []
    work = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    run = lambda: W.watch(W.arrivals(spark, str(tmp_path / "in"), SCHEMA, 1), work, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: seen.append(df.count())).awaitTermination()
    run()
    first = len(seen)
    run()
    assert first == len(seen) == 4
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == e.count()


def test_windows(spark, tmp_path):
    e = _split(spark, tmp_path / "in", 1)
    stream = W.tumbling(W.arrivals(spark, str(tmp_path / "in"), SCHEMA), "1 hour", ["event_type"], F.count("*").alias("n"), late="40 days")
    q = stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = W.tumbling(e, "1 hour", ["event_type"], F.count("*").alias("n"))
    as_rows = lambda df: sorted((str(r.window.start), r.event_type, r.n) for r in df.collect())
    assert as_rows(spark.table("tumbling")) == as_rows(batch)


def test_state(spark, tmp_path):
    e = _split(spark, tmp_path / "in", 1)
    s = W.smoothed(W.arrivals(spark, str(tmp_path / "in"), SCHEMA), "user_id", 0.3, 30.0)
    s.writeStream.format("memory").queryName("smoothed").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    from corpusloom.operators.state import ema

    want = {r.user_id: r.ema for r in ema(e, "user_id", "ts", F.col("value"), 0.3, 30.0).collect()}
    got = {r.user_id: r.ema for r in spark.table("smoothed").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)

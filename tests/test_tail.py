"""The end of a log, and what is added to it, in byte offsets."""

import random

import pytest

from corpusloom.sources import tail


def test_ranges_read_each_line_once(tmp_path, monkeypatch):
    r = random.Random(2)
    path = str(tmp_path / "log")
    for step, size in ((3, 5), (64, 7), (5, 1000)):
        monkeypatch.setattr(tail, "STEP", step)
        monkeypatch.setattr(tail, "RANGE", size)
        for _ in range(60):
            lines = ["x" * r.randint(0, 9) + "é" * r.randint(0, 2) for _ in range(r.randint(0, 12))]
            body = "".join(x + r.choice(["\n", "\r\n"]) for x in lines).encode() + b"open" * r.randint(0, 1)
            (tmp_path / "log").write_bytes(body)
            first = r.randint(1, 60)
            begin, end = tail.first_offset(path, first), tail.last_offset(path)
            got = [row for p in tail.ranges(begin, end) for row in tail.lines_between(path, *p.value)]
            starts = [0]
            for x in body.split(b"\n")[:-1]:
                starts.append(starts[-1] + len(x) + 1)
            low = len(body) - first
            assert [(a, t) for _, a, t in got] == [(a, t) for a, t in zip(starts, lines) if low <= 0 or a > low]


def test_tail_of_a_log(spark, tmp_path):
    spark.dataSource.register(tail.Tail)
    log = tmp_path / "run.log"
    log.write_text("".join(f"line {i}\n" for i in range(3000)) + "half")
    rows = spark.read.format("tail").load(str(log)).collect()
    assert rows[-1].line == "line 2999" and rows[0].offset > log.stat().st_size - 8000 and len(rows) == int(rows[-1].line[5:]) - int(rows[0].line[5:]) + 1
    assert spark.read.format("tail").load(str(tmp_path / "none")).count() == 0


def test_stream_over_a_growing_log(spark, tmp_path):
    spark.dataSource.register(tail.Tail)
    log, out, mark = tmp_path / "run.log", f"{tmp_path}/out", f"{tmp_path}/mark"
    log.write_text("".join(f"{i}\n" for i in range(100)) + "ha")

    def run():
        q = spark.readStream.format("tail").option("first", 30).load(str(log)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start()
        q.awaitTermination()
        return [r.line for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (len(r.line) < 3, r.offset))]

    first = [str(i) for i in range(91, 100)]
    assert sorted(run(), key=int) == first
    assert sorted(run(), key=int) == first
    with log.open("a") as f:
        f.write("lf\nnew 1\nnew 2\nop")
    assert set(run()) == {*first, "half", "new 1", "new 2"} and len(run()) == 12
    log.write_text("begun anew\n")
    assert set(run()) == {*first, "half", "new 1", "new 2", "begun anew"}


def test_offsets_of_no_file(tmp_path):
    assert tail.first_offset(str(tmp_path / "x"), 10) == tail.last_offset(str(tmp_path / "x")) == 0
    with pytest.raises(KeyError):
        tail.TailReader({})

"""Readers and writers on small folders."""

import json

from pyspark.sql import functions as F

from corpusloom.sources import files as SF
from corpusloom.sources import json as SJ
from corpusloom.sources import sinks as K


def test_incremental_files(spark, tmp_path):
    for n, text in (("a.pdf", "one"), ("b.PDF", "two"), ("c.txt", "no"), ("skip/d.pdf", "four")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(text)
    files = SF.collect(spark, str(tmp_path), skip=("/SKIP/",))
    assert files.count() == 2
    hashed = SF.hashed(files)
    state = hashed.select("path", F.lit("indexed").alias("status"), F.when(F.contains("path", F.lit("a.pdf")), F.col("hash")).otherwise("old").alias("hash"), F.lit(1).alias("context_version"))
    assert [r.path[-5:] for r in SF.to_index(files, state).collect()] == ["b.PDF"]
    assert sorted(r.text for r in SF.texts(files).collect()) == ["one", "two"]
    assert SF.collect(spark, str(tmp_path), max_bytes=2).count() == 0


def test_convert(spark, tmp_path):
    (tmp_path / "a.djvu").write_text("x")
    df = spark.createDataFrame([(str(tmp_path / "a.djvu"),)], "path string")
    assert SF.convert(df, ("cp", "{source}", "{target}")).first().converted == str(tmp_path / "a.pdf")
    assert SF.convert(df, ("false",)).first().converted is None and not (tmp_path / "a.pdf").exists()
    assert SF.convert(df, ("no such program",)).first().error


def test_json(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"a":1}\n\n[1]\n{bad\n{"a":2}x\n{"a":3}]\n{"a":4}}\n{"a":5},{"a":6}\n')
    assert [r.a for r in SJ.lines(spark, str(tmp_path / "f.jsonl")).select(F.variant_get("record", "$.a", "int").alias("a")).collect()] == [1]
    assert SJ.lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    for body in ([{"name": "A"}], {"people": [{"name": "A"}]}):
        (tmp_path / "p.json").write_text("﻿" + json.dumps(body))
        assert [r.name for r in SJ.people(spark, str(tmp_path / "p.json"), "name: string, birth_year: int").collect()] == ["A"]
    raw = spark.createDataFrame([('```jsonl\n{"a":1}\nx\n[2]\n{"a":3}\n```',), ('[{"a":1},{"a":2}]',)], "raw string")
    assert [len(r.v) for r in raw.select(F.transform(SJ.response_lines(F.col("raw")), lambda v: F.to_json(v)).alias("v")).collect()] == [2, 2]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "source_file_id string, text string")
    K.replace_files(rows(("a", "1"), ("a", "2"), ("b", "3")), out)
    K.replace_files(rows(("a", "9")), out)
    assert sorted((r.source_file_id, r.text) for r in spark.read.parquet(out).collect()) == [("a", "9"), ("b", "3")]
    K.route_json(spark.createDataFrame([("index", 1), ("queue_entity", 2)], "record_type string, x int"), str(tmp_path / "feeds"))
    assert spark.read.json(str(tmp_path / "feeds" / "record_type=index")).count() == 1
    K.write_json_document({"é": 1}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text(encoding="utf-8")) == {"é": 1} and not (tmp_path / "d.json.tmp").exists()
    one = spark.createDataFrame([("x", None)], "a string, b string")
    assert [json.loads(r.record) for r in K.enriched(one, one, one, one).where("part = 'people'").collect()] == [{"a": "x", "b": None}]

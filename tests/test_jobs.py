"""Jobs over growing copies of the tables, against the operators run at once over what should be there."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings, retrieval
from corpusloom.sources import scratch
from jobs import index_documents, search_index
from jobs.common import config
from jobs.queries import ORACLE_SQL, QUERIES

from .oracle import DATA, same

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    before = dict(spark.conf.getAll)
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])
    assert dict(spark.conf.getAll) == before


def rows(df, *drop):
    return sorted((tuple(r) for r in df.drop(*drop).select(*sorted(set(df.columns) - set(drop))).collect()), key=str)


def expected(spark, docs):
    """All chunks of the documents, made at once."""
    df = spark.createDataFrame([(str(i), t, lang, s) for i, (t, lang, s) in docs.items()], "doc string, text string, lang string, title string")
    return rows(index_documents.chunked(df, "\n"))


def test_index_grows(spark, tmp_path):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60).collect()]
    source, out, mark, conf = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark", config("index_documents")
    add = lambda some: spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    docs = {i: (t, lang, s) for i, t, lang, s in table[:40]}
    add(table[:40])
    first = index_documents.run(spark, source, out, mark, conf)
    assert rows(first, "batch") == expected(spark, docs)
    # new, changed, emptied and unchanged documents, one twice, one without an id, one of no language
    changed = (table[0][0], table[1][1] + "\n" + table[2][1], "en", "src0")
    more = [*table[40:], changed, (table[3][0], None, "en", "s"), table[4], table[41], (None, table[5][1], "en", "s"), (7000, table[6][1], None, "")]
    add(more)
    docs |= {i: (t or "", lang, s) for i, t, lang, s in more if i is not None and i != table[4][0]}
    second = rows(index_documents.run(spark, source, out, mark, conf), "batch")
    assert second == expected(spark, docs)
    state = index_documents.indexed(spark, out)
    assert [r.n for r in state.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [40, 23]  # 20 new, 2 changed, 1 without a language
    # nothing new, then a file of rows that are all known: no chunk is written
    assert rows(index_documents.run(spark, source, out, mark, conf), "batch") == second
    add(more[:5])
    assert rows(index_documents.run(spark, source, out, mark, conf), "batch") == second
    assert state.count() == 63 and not list(tmp_path.glob("out/chunks/batch=2/lang=*"))


def test_index_after_failures(spark, tmp_path, monkeypatch):
    """A batch that fails before its state is written, and one that fails after, are taken again with the same result."""
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").limit(12).collect()]
    source, out, mark, conf = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark", config("index_documents")
    spark.createDataFrame(table, SCHEMA).write.parquet(source)
    whole = expected(spark, {i: (t, lang, s) for i, t, lang, s in table})

    def fail(*_):
        raise OSError("lost")

    for name, state in (("chunked", False), ("drop", True)):
        with monkeypatch.context() as m:
            m.setattr(index_documents if name == "chunked" else scratch, name, fail)
            with pytest.raises(Exception, match="lost"):
                index_documents.run(spark, source, out, mark, conf)
        assert scratch.exists(spark, f"{out}/indexed/batch=0") is state
    assert rows(index_documents.run(spark, source, out, mark, conf), "batch") == whole
    assert index_documents.indexed(spark, out).count() == 12


def test_search_index_by_language(spark, tmp_path):
    """Two languages; one is then built anew from fewer documents, and the other stays."""
    conf = config("search_index") | {"docs_in_block": 4, "every": 1, "k": 5, "parts": 3}
    words = "alpha beta gamma delta the the the".split()
    text = lambda i: " ".join(words[(i * j) % 7] for j in range(1, 3 + i % 11))
    docs = [(i, text(i), ("en", "fr", None)[i % 3]) for i in range(90)] + [(None, "alpha", "en"), (500, None, "en"), (501, "", "fr")]
    asked = [(1, "the gamma"), (2, "Alpha delta delta"), (3, "nothing"), (4, None)]
    make = lambda some, name, schema: spark.createDataFrame(some, schema).repartition(3).write.parquet(f"{tmp_path}/{name}")
    make(docs, "docs", "doc_id long, text string, lang string")
    make(asked, "asked", "item_id long, text string")
    fewer = [d for d in docs if d[2] == "fr" and (d[0] or 0) % 2]
    make(fewer, "fewer", "doc_id long, text string, lang string")

    def check(now, docs):
        want = retrieval.sparse_leg(retrieval.term_weights(spark.createDataFrame(asked, "a long, t string"), "a", "t", "query_id"), retrieval.term_weights(spark.createDataFrame(docs, "i long, t string, l string").where("i is not null"), "i", "t"), 5)
        assert rows(now.where("kind = 'answer'").select("query_id", "id", "sparse_rank", "sparse_score")) == rows(want)
        held = [(int(i), r.lang, r.term, float(w)) for r in now.where("kind = 'index'").collect() for i, w in zip(r.ids.split(","), r.weights.split(","))]
        every = retrieval.term_weights(spark.createDataFrame(docs, "i long, t string, lang string").where("i is not null"), "i", "t").join(spark.createDataFrame(docs, "id long, t string, lang string").drop("t"), "id")
        assert sorted(held, key=str) == rows(every)

    run = lambda name: search_index.run(spark, f"{tmp_path}/{name}", f"{tmp_path}/asked", f"{tmp_path}/out", conf)
    check(run("docs"), docs)
    check(run("docs"), docs)
    check(run("fewer"), [d for d in docs if d[2] != "fr"] + fewer)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/asked")
    for _ in range(2):
        assert index_documents.run(spark, f"{tmp_path}/docs", f"{tmp_path}/chunks", f"{tmp_path}/mark", config("index_documents")).count() == 0
        assert search_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/asked", f"{tmp_path}/out", config("search_index")).count() == 0


def test_command_lines(spark, tmp_path):
    for name in ("index_documents", "search_index"):
        (tmp_path / f"{name}.json").write_text(json.dumps(config(name) | {"every": 1}))
    calls = {"index_documents": [f"{DATA}/documents.parquet", f"{tmp_path}/chunks", f"{tmp_path}/mark"], "search_index": [f"{DATA}/documents.parquet", f"{DATA}/benchmark.parquet", f"{tmp_path}/search"]}
    for name, paths in calls.items():
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *paths, "--config", f"{tmp_path}/{name}.json"], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "jobs " in done.stderr and str(tmp_path) in done.stderr
    assert index_documents.current(spark, f"{tmp_path}/chunks").count() > 100
    index = search_index.read_index(spark, f"{tmp_path}/search")
    assert {"lang", "part", *postings.INDEX} == set(index.columns) and index.count() > 1000

"""Equal texts and words one edit apart, against plain versions."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, spelling

from ..oracle import DATA
from . import plain


def flags(df):
    return sorted((tuple(r) for r in df.select("doc_id", *exact_dedup.FLAGS).collect()), key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (None, "a"), (None, "c"), (None, "c"), (5, None), (4, ""), (9, "a "), (8, "A"), (7, "é"), (6, "é"), *((100 + i, "hot") for i in range(300)), *((500 + i, f"t{i % 40}") for i in range(120))]


def test_equal_texts(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    want = plain.equal_texts(ROWS)
    assert flags(exact_dedup.marked(docs)) == want
    # no broadcast of hashes; no group that is large; all groups large
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert flags(exact_dedup.marked(docs)) == want
    for hot in (1, 10**9):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        assert flags(exact_dedup.marked(docs)) == want


def test_texts_whose_hashes_collide(spark, monkeypatch):
    """With a hash of sixteen values, only the comparison of bytes tells texts apart."""
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.encode(F.substring(F.md5(text), 1, 1), "utf-8"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for hot in (4096, 3):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        assert flags(exact_dedup.marked(docs)) == plain.equal_texts(ROWS)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "x", 5, {"k": 1}), (2, "X ", 6, {"k": 2}), (2, "x", 7, {"k": 3}), (None, None, None, None)], "doc_id long, text string, kept int, tag map<string,int>")
    stay = exact_dedup.keep_largest(docs, normal=lambda t: F.lower(F.trim(t)))
    assert stay.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in stay.collect()) in ([(0, ""), (2, "X ")], [(0, ""), (2, "x")])
    first = sorted(map(str, stay.collect()))
    assert all(sorted(map(str, exact_dedup.keep_largest(docs.repartition(n), normal=lambda t: F.lower(F.trim(t))).collect())) == first for n in (1, 3))
    told = exact_dedup.marked(docs)
    assert told.columns == [*docs.columns, "_keep_id", "_group_size", "_kept", "_text_sha256"]
    assert {(r.kept, r._group_size, r._kept) for r in told.collect()} == {(5, 2, False), (6, 1, True), (7, 2, True), (None, 1, True)}


def test_no_python_in_exact_dedup(spark):
    plan = exact_dedup.op11_exact_dedup(spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


letters = st.text("abAB éÀ×÷ß1.\n", max_size=60)


@settings(max_examples=200, deadline=None)
@given(letters, st.integers(1, 9))
def test_runs_in_pieces(text, piece):
    whole = [r for part in spelling.runs_of(text) for r in part]
    assert [r for part in spelling.runs_of(text, piece) for r in part] == whole == spelling.RUN.findall(text.encode().lower().decode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé𐀀", min_size=1, max_size=7), min_size=1, max_size=12, unique=True))
def test_keys_are_those_of_strings(words):
    """Equal keys, equal rests (and places), whatever hashes they come from."""
    key, kind, place, ids = spelling.deletion_keys(words, np.arange(len(words)))
    rest = [(words[i] if p < 0 else words[i][:p] + words[i][p + 1 :], k, p if k == spelling.PLACED else 0) for k, p, i in zip(kind, place, ids)]
    assert len(set(zip(key, rest))) == len(set(key)) == len(set(rest))
    whole = {(i, r) for (r, k, _), p, i in zip(rest, place, ids) if k == spelling.LEFT and p >= 0}
    assert whole == {(i, w[:p] + w[p + 1 :]) for i, w in enumerate(words) for p in range(len(w))}
    assert (kind == spelling.PLACED).sum() == sum(map(len, words))


def test_collisions_are_told_apart():
    rows = [(spelling.PLACED, 1, "abc", 9), (spelling.PLACED, 1, "adc", 2), (spelling.PLACED, 1, "xyz", 50), (spelling.PLACED, 2, "abd", 50), (spelling.LEFT, -1, "ac", 7), (spelling.LEFT, 1, "abc", 9), (spelling.LEFT, -1, "zz", 99), (spelling.PLACED, 1, "abc", 9)]
    assert sorted(spelling.neighbours(rows)) == [("abc", 1, 2, "adc"), ("abc", 1, 7, "ac"), ("ac", 1, 9, "abc"), ("adc", 1, 9, "abc")]


def test_shared_keys_over_batches(spark):
    """Groups that reach over batches come whole."""
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(200)})
    vocabulary = spark.createDataFrame([(w, i + 5, i) for i, w in enumerate(words)], "word string, n long, id long")
    want = {w: sum(plain.one_apart(w, x) for x in words) for w in words}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {x.word: x.n_near for x in spelling.near(vocabulary).collect()}
        assert got == {w: n for w, n in want.items() if n}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ids_that_collide(spark):
    """All words under one id: the strings tell them apart."""
    words = ["colour", "color", "colours", "dolour", "unlike"]
    got = spelling.near(spark.createDataFrame([(w, 5, 1) for w in words], "word string, n long, id long")).collect()
    assert {(x.word, x.n_near) for x in got} == {("colour", 3), ("color", 1), ("colours", 1), ("dolour", 1)}


def told(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants(spark):
    r = random.Random(5)
    for size in (3, 300):
        n = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))): 5 * 6 ** r.randint(0, 5) + r.randint(0, 1) for _ in range(size)}
        assert told(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(5))) == plain.spelling(n)
    chain = {"aaaaaa" + "b" * i: 5 * 5**i for i in range(13)}  # every form has a form
    got = told(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == plain.spelling(chain) and {x[2] for x in got} == {"aaaaaa" + "b" * 12}
    long = {"x" * 50_000: 5, "x" * 50_001: 30, "x" * 49_999 + "y": 7}
    got = told(spelling.variants(spark.createDataFrame(list(long.items()), "word string, n long")))
    assert [(len(w), len(f or ""), near) for w, f, _, _, near, _ in got] == [(50_000, 50_001, 2), (50_001, 0, 1), (50_000, 0, 1)] or {(x[3], x[4], x[5]) for x in got} == {(5, 2, 30), (30, 1, None), (7, 1, None)}


def test_counts(spark):
    docs = [(1, "Colour colour, COLOUR;Ünder À×÷àb " * 3), (1, "colour"), (2, None), (3, ""), (None, "colour " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.counts(df, change=spelling.damaged).collect()} == plain.spelled(docs)


def test_variants_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert told(spelling.op12_spelling_variants(spark, DATA)) == plain.spelling(plain.spelled(docs))

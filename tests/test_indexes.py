"""Search indexes against scoring everything, and suffixes by order against comparing all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.catalogue import QUERIES
from corpusloom.operators import entities, postings, retrieval, vectors
from corpusloom.operators.rewrites import suffix_owner
from corpusloom.plans.registry import table
from corpusloom.sources.scratch import stored


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


# --- vectors in cells ---------------------------------------------------------------


def recall(spark, data):
    nearest = {(r.query_id, r.id) for r in QUERIES["dense_topk"](spark, data).collect()}
    return len(nearest & {(r.query_id, r.id) for r in QUERIES["ann_topk"](spark, data).collect()}) / len(nearest)


def test_recall(spark):
    """All questions, those whose id 100 divides, against exact search over all rows."""
    assert recall(spark, "/root/testdata/sf0.01") >= 0.9
    index = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    cells = vectors.build(index)
    assert 1 <= cells.probes <= len(cells.centroids) and sum(n for n, _, _ in cells.stats.values()) == index.count()


@pytest.mark.parametrize("block", [4096, 16])
def test_cells_hold_all(spark, monkeypatch, block):
    """Clusters, one vector for a third of all rows, nulls, zeros, other lengths, ties: the exact search equals scoring everything."""
    monkeypatch.setattr(vectors, "INDEX_BLOCK", block)
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 5)
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 8)) * 3
    v = [(centers[i % 6] + r.normal(size=8)).tolist() for i in range(400)] + [[1.0, *[0.0] * 6, 2.0]] * 200 + [None, [0.0] * 8, [1.0, 2.0], [2.0, 1.0], []]
    index = spark.createDataFrame([(f"v{i:03}", x) for i, x in enumerate(v)], "id string, vector array<float>").repartition(4)
    asked = index.where("crc32(id) % 9 = 0 or id > 'v599'").select(F.col("id").alias("query_id"), "vector")
    cells = vectors.build(index)
    assert sum(n for n, _, _ in cells.stats.values()) == 604
    # no block of the index holds more than its share of the cell with a third of all rows
    assert cells.blocks.select(F.max(F.size("ids"))).first()[0] <= max(block, 3 * block if block == 16 else 0)
    for k in (1, 7):
        exact = rows(retrieval.dense_leg(asked, index, k))
        assert rows(vectors.search(asked, cells, k, exact=True)) == exact
    near = {(a, b) for _, _, b, a in rows(vectors.search(asked, cells, 7))}
    assert len(near & {(a, b) for _, _, b, a in exact}) >= 0.9 * len(exact)


def test_no_vectors(spark):
    index = spark.createDataFrame([(1, None)], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0]), (2, None)], "query_id long, vector array<float>")
    for df in (index, index.limit(0)):
        assert rows(vectors.search(asked, vectors.build(df), exact=True)) == []


def test_dense_leg_has_an_even_key(spark):
    """No exchange hashes on the vectors' length alone."""
    index = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = retrieval.dense_leg(index.where("id % 100 = 0").withColumnRenamed("id", "query_id"), index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("number" in line for line in exchanges) and all("number" in line or "query_id" in line for line in exchanges)


# --- postings in blocks --------------------------------------------------------------


def test_levels(spark):
    got = [r[0] for r in spark.range(1, 40).orderBy("id").select(postings.size_level(F.col("id"))).collect()]
    assert got == [*range(1, 8), *(4 * (n.bit_length() - 2) + (n >> n.bit_length() - 3) % 4 for n in range(8, 40))] and got == sorted(got)


def zipf(r, n):
    """Texts of very unlike lengths, with a word that all have and rare ones."""
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join(["the", *r.choices(words, [1 / (k + 1) for k in range(300)], k=int(3 * 1.6 ** r.randint(0, 9)))])) for i in range(n)]


@pytest.mark.parametrize("first", [1, 4])
def test_blocks_against_all_postings(spark, first):
    r = random.Random(8)
    docs = spark.createDataFrame([*zipf(r, 400), (900, None), (901, ""), (902, "?!")], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "the"), (2, "w1 w2 the"), (3, "W250 w250 w3"), (4, "absent"), (5, "w0 w5 w9 w40 w41"), (6, "")], "query_id long, text string")
    q = retrieval.term_weights(asked, "query_id", "text", "query_id")
    index = stored(postings.parted(postings.build(docs, "id", "text", 16), 4), "index", "part")
    assert index.select(F.max("n")).first()[0] <= 40
    for k in (1, 5, 1000):
        assert rows(postings.search(q, index, k, 4, first)) == rows(retrieval.sparse_leg(q, retrieval.term_weights(docs, "id", "text"), k))
    effort = {e.query_id: e for e in postings.plan(q, index, 5, 4, first)[2].collect()}
    assert all(e.blocks == e.read + e.skipped for e in effort.values()) and set(effort) == {1, 2, 3, 5}
    assert sum(e.skipped for e in effort.values()) > 0.5 * sum(e.blocks for e in effort.values())


# --- suffixes by order ---------------------------------------------------------------


def owners(names, keys):
    out = {}
    for n in names:
        hits = [p for k, p in keys if k.endswith(n)]
        if len(hits) == 1:
            out[n] = hits[0]
    return out


def test_suffix_ranges(spark):
    r = random.Random(3)
    for _ in range(4):
        part = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 3)))
        keys = list({" ".join(part() for _ in range(r.randint(1, 4))): i for i in range(150)}.items())
        names = sorted({" ".join(part() for _ in range(r.randint(1, 3))) for _ in range(80)} | {k for k, _ in keys[:5]})
        left = spark.createDataFrame([(n, len(n)) for n in names], "nm string, size int").repartition(3)
        right = spark.createDataFrame(keys, "k string, owner long").repartition(5)
        got = suffix_owner(left, "nm", right, "k", "owner")
        assert {x.nm: x.owner for x in got.collect()} == owners(names, keys) and got.columns == ["nm", "size", "owner"]
    nothing = right.limit(0)
    assert suffix_owner(left, "nm", nothing, "k", "owner").count() == 0 and suffix_owner(left.limit(0), "nm", right, "k", "owner").count() == 0


def test_one_last_word_in_many_tasks(spark):
    """Half of all names end in one word: they are dealt over tasks, in suffix search and in the ordered merge."""
    first = ["ada", "emmy", "karl", "olga", "ivo", "ugo", "lin", "ned", "pip", "zoë"]
    people = spark.createDataFrame([(i, f"{first[i % 10]} {first[i // 10 % 10]}{i} smith" if i % 2 else f"x{i} y{i}", i) for i in range(2000)], "pid long, name string, ord long")
    names = spark.createDataFrame([(f"{first[i // 10 % 10]}{i} smith",) for i in range(1, 400, 2)], "name string")
    got = {r.name: r.pid for r in entities.suffix_matches(names, people).collect()}
    assert got == {f"{first[i // 10 % 10]}{i} smith": i for i in range(1, 400, 2)}
    extracted = names.select(F.lit("f").alias("file_name"), F.lit(0).alias("file_ord"), "name", F.monotonically_increasing_id().alias("ord"))
    relations = spark.createDataFrame([], "file_name string, file_ord int, subject string, object string, predicate string, evidence string, ord long")
    merged = entities.resolve_all(people, extracted, relations).where("kind = 'match'")
    assert {r.name: int(r.person) for r in merged.collect()} == got
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert merged.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

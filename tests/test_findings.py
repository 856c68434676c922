"""What a reviewer found at larger sizes, held at small ones."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import latent
from corpusloom.operators import retrieval as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unit_makes_a_length_once(spark):
    """the length was made again for each number of a vector."""
    import re

    found = R.unit(F.col("v"))._jc.toString()
    assert len(re.findall("aggregate", found)) == 1


def test_dense_leg_over_many_blocks(spark, monkeypatch):
    """vectors stream past; null, empty and odd vectors, ties and text ids."""
    monkeypatch.setattr(R, "LEG_BLOCK", 7)
    rng = np.random.default_rng(3)
    index = [(f"i{n:03d}", [float(x) for x in rng.integers(-2, 3, 5)]) for n in range(90)] + [("none", None), ("empty", []), ("long", [1.0] * 6), ("zero", [0.0] * 5)]
    asked = [(n, [float(x) for x in rng.integers(-2, 3, 5)]) for n in range(11)] + [(20, None), (21, [1.0] * 6), (22, [1.0] * 9), (23, [0.0] * 5)]
    got = R.dense_leg(spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(index, "id string, vector array<double>"), 4).collect()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = set()
    for q, v in asked:
        found = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in index if v is not None and w is not None and len(v) == len(w))[:4]
        want |= {(q, i, n, round(-s, 6) + 0.0) for n, (s, i) in enumerate(found)}
    assert {(r.query_id, r.id, r.dense_rank, r.dense_score) for r in got} == want


def test_word_vectors_are_not_broadcast(spark, monkeypatch):
    """random vectors of all words went to every task, taken for small ones."""
    joined = []
    summed = latent._summed
    monkeypatch.setattr(latent, "_summed", lambda rows, *more: (joined.append(_plan(rows)), summed(rows, *more))[1])
    docs = spark.createDataFrame([(n, " ".join(f"w{(n * 7 + k * k) % 97}" for k in range(12))) for n in range(60)], "id long, text string")
    latent.fit(docs, "id", "text", rank=4, more=4)
    assert joined and not any("PythonMapInArrow" in p or "MapInArrow" in p for p in joined)


def test_chunks_of_one_batch_are_not_dealt_by_batch(spark, tmp_path):
    """with a state too large to be sent unasked, all chunks of a batch went to one task."""
    from jobs import index_documents as job

    chunk = ("c", "7", 0, "child", None, "text", "en", 1, 1, "t", "x", 0, "en")
    spark.createDataFrame([chunk], job.CHUNKS).drop("batch").write.partitionBy("lang").parquet(f"{tmp_path}/chunks/batch=0")
    spark.createDataFrame([("7", "h")], "doc string, hash string").write.parquet(f"{tmp_path}/indexed/batch=0")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = job.current(spark, str(tmp_path))
        assert "BroadcastHashJoin" in _plan(df)
        assert df.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_band_pairs_are_counted_by_size(spark, tmp_path):
    """a row a pair of supplier and part, which grew with the square of the tables."""
    from corpusloom.catalogue import QUERIES

    spark.createDataFrame([(1,), (7,), (61,), (61,), (59,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(n, n % 14) for n in range(500)] + [(900, None), (901, 64)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["band_pair_counts"](spark, str(tmp_path))
    sizes = [n % 14 for n in range(500)] + [64]
    want = {}
    for s in (1, 7, 61, 61, 59):
        for p in sizes:
            if abs(s % 60 - p) <= 5:
                n, total = want.get(s, (0, 0))
                want[s] = n + 1, total + p
    assert {r.supplier: (r.n, r.sizes) for r in df.collect()} == want
    assert "p_partkey" not in _plan(df) and _plan(df).count("HashAggregate") >= 6


def test_expansion_reads_the_words_of_its_passages_only(spark):
    """the words of all documents were dealt by document for those of a few passages."""
    from corpusloom.operators import feedback

    docs = spark.createDataFrame([(n, f"apple w{n} w{n % 5} tree") for n in range(40)], "id long, text string")
    hits = spark.createDataFrame([(0, 3, 1.0, 0), (0, 8, 1.0, 1)], "query_id long, id long, sparse_score double, sparse_rank int")
    df = feedback.relevance(hits, R.term_weights(docs, "id", "text"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2  # once a reading of the words
    assert {r.term: r.p for r in df.collect()} == {"apple": 0.25, "tree": 0.25, "w3": 0.375, "w8": 0.125}


PEOPLE = [("0", "Ann", 0), ("1", "Bob", 1), ("2", "Ann", 2), ("3", "Cid", 3), ("4", "Dee", 4)]
RELATION = "owner string, owner_name string, position long, source string, target string, relation_type string, weight double, assertion_layer string"


def test_ties_of_edges_do_not_depend_on_order(spark):
    """of two edges that one owner has at one position, the one read first stayed."""
    from corpusloom.operators import graph

    people = spark.createDataFrame(PEOPLE, "id string, name string, ord long")
    tied = [("1", "Bob", 0, "Bob", "Cid", "cited", w, layer) for w, layer in ((0.7, "canonical"), (None, "canonical"), (0.5, "ai_hypothesis"))]
    found = {tuple(graph.build_edges(people, spark.createDataFrame(rows, RELATION).coalesce(1), True).first()) for rows in (tied, tied[::-1], tied[1:] + tied[:1])}
    assert found == {("1", "3", "cited", 0, 0.5, "ai_hypothesis", graph.HYPOTHESIS_COLOR)}


def test_edges_of_one_id_are_joined_alone(spark):
    """A neighbourhood of one joined the names of all relations."""
    from corpusloom.operators import graph

    people = spark.createDataFrame(PEOPLE, "id string, name string, ord long")
    names = ["Ann", "Bob", "Cid", "Dee", "Nobody", None]
    rows = [(o, name, (i + j) % 2, s, t, "cited", i / 10, None if j else "ai_hypothesis") for o, name in (("0", "Ann"), ("1", "Bob"), ("2", None), ("9", "Eve"), ("4", "Dee")) for i, s in enumerate(names) for j, t in enumerate(names)]
    relations = spark.createDataFrame(rows, RELATION)
    every = {tuple(r) for r in graph.build_edges(people, relations, True).collect()}
    for one in ("0", "1", "2", "3", "4", "9", "none"):
        some = {tuple(r) for r in graph.build_edges(people, relations, True, one).collect()}
        assert some <= every and {e for e in every if one in e[:2]} == {e for e in some if one in e[:2]}
    assert len(some) == 0


def test_postings_are_made_where_the_documents_are(spark):
    """a posting was shuffled twice, with its term, before it stood in its list."""
    import re
    from collections import Counter

    from corpusloom.operators import postings

    texts = ["The the cat", "", None, "--", "cat's cat; CAT_1", "a " * 40, *(f"w{n % 7} w{n % 5} the" for n in range(30))]
    rows = [(None if n % 3 == 0 else "en" if n % 3 == 1 else "", f"d{n:02d}", t) for n, t in enumerate(texts)] + [("en", "d07", "w0 w1 twice"), ("", None, "no id")]
    index = postings.build(spark.createDataFrame(rows, "lang string, id string, text string").repartition(3), "id", "text", 4, by="lang")
    assert len(re.findall("Exchange hashpartitioning", _plan(index))) == 1
    made = index.collect()
    got = Counter()
    for r in made:
        assert r.n == len(r.ids) == len(r.weights) and r.max_weight == max(r.weights) and len(set(r.ids)) == r.n and [i for i in r.ids if i] == sorted(i for i in r.ids if i)
        got.update({(r.lang, r.term, i): w for i, w in zip(r.ids, r.weights)})
    want = Counter()
    for lang, i, t in rows:
        want.update((lang, w, i) for w in re.findall("[a-z0-9]+", (t or "").lower()))
    assert got == want and len({(r.lang, r.term, r.block) for r in made}) == len(made)


def test_a_language_is_guessed_from_words_split_once(spark):
    """a text was split into words again for each comparison of two languages' scores."""
    from corpusloom import providers

    guess = providers.get("language")
    assert guess(F.col("text"), first=None)._jc.toString().count("split(") == 1
    texts = [("the THE le", "en"), ("le der", "fr"), ("der el", "de"), ("El niño y", "es"), ("the le", "en"), ("é-the_ x", "en"), ("the le les", "fr"), ("", "en"), (None, "en"), ("dér lé", "en")]
    assert [(r.text, r.g) for r in spark.createDataFrame(texts, "text string, want string").withColumn("g", guess(F.col("text"), first=None)).collect()] == texts


def test_first_edges_of_a_name_are_the_first_of_all(spark):
    """all edges of a name were gathered for a text that shows eight."""
    from corpusloom.operators import people as P

    people = spark.createDataFrame([(n, name) for n, name in enumerate(["Ann", "ann ", "Bob", "Cid", None])], "pid long, name string")
    edges = spark.createDataFrame([(" ANN" if n % 2 else "Ann" if n % 3 else "Cid", f"t{n % 4}", "cited", n / 40, "x", (n * 7) % 40) for n in range(40)], "source string, target string, relation_type string, weight double, assertion_layer string, ord long")
    every, some = ({r.pid: r.semantic_relationships for r in P.nested_edges(people, edges, n).collect()} for n in (None, P.SHOWN_RELATIONS))
    assert some == {pid: e[: P.SHOWN_RELATIONS] for pid, e in every.items()}
    assert sorted(map(len, some.values())) == [0, 0, 7, 8, 8]


def test_a_region_is_told_from_its_spans_once(spark):
    """blank spans were sought anew for each kind a region can be, and a text normalised for each layer."""
    import re

    from corpusloom.functions import text as T
    from corpusloom.operators import layers as L

    box = {"y0": F.col("y0"), "y1": F.col("y0") + 20, "x0": F.col("x0"), "x1": F.col("x0") + F.col("wide")}
    kind = L.region_type(box, F.lit(600), F.lit(800), F.col("spans"))
    assert len(re.findall("filter", kind._jc.toString())) == 1
    span = lambda text, size, flags=0: (text, size, flags)
    rows = [
        (0, 80, 400, [span("a", 10.0)], "running_title"), (300, 80, 400, [], "paragraph"), (300, 80, 400, [span("  \t", 20.0), span(None, 20.0)], "paragraph"), (300, 80, 400, None, "paragraph"),
        (650, 80, 400, [span("a", 8.2)], "footnote"), (300, 80, 400, [span("a", 8.2)], "paragraph"), (300, 80, 400, [span("a", 7.0)], "footnote"), (300, 80, 400, [span("a", 9.0), span("b", 15.0), span(" ", 7.0)], "heading"),
        (300, 80, 400, [span("a", 12.0, 16)], "subheading"), (300, 80, 400, [span("a", 12.0)], "paragraph"), (300, 10, 80, [span("a", 10.0)], "margin_note"), (300, 80, 400, [span("Fig. 1", 9.0)], "caption"), (300, 80, 400, [span("a", None)], "paragraph"),
    ]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, y0 int, x0 int, wide int, spans array<struct<text: string, size: double, flags: int>>, want string")
    assert [(r.n, r.got) for r in df.select("n", kind.alias("got")).orderBy("n").collect()] == [(n, r[-1]) for n, r in enumerate(rows)]
    lines = [("a-\nb-\nc", "ab- c"), (" a  b\t", "a b"), ("a\n\nb\nc", "a\n\nb c"), ("a-b", "a-b"), ("", ""), (None, None), ("\n", "")]
    assert [(r.t, r.x) for r in spark.createDataFrame(lines, "t string, w string").select("t", T.layer_text(F.col("t")).alias("x")).collect()] == lines


def test_pairs_are_counted_in_batches(spark):
    """F8: each pair of words was a row before it was counted, and passages were searched for each of three readings."""
    import re
    from collections import Counter

    from corpusloom.operators import compression

    texts = ["The the\tTHE cat", "", None, " \n ", "a\xa0b  a\xa0b\rÉté", "cat", "the the", *(f"w{n % 5} w{n % 3} w{n % 5}" for n in range(40))]
    model = compression.counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text")
    assert "Generate" not in _plan(model)
    want = Counter()
    for t in texts:
        low = [w.lower() for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        want.update(zip(["", *low], low))
    assert {(r.v, r.w): r.n for r in model.collect()} == want


def test_merged_edges_carry_what_the_first_relation_tells(spark):
    """whole edges, with their key and constants once more, were sorted in a task."""
    from corpusloom.operators import entities as E

    resolved = spark.createDataFrame([("ann", "1"), ("ann", "1"), ("bob", "new:bob")], "key string, person string")
    rows = [("f2", "Ann", "knows", "X", None, 2), ("f1", "Ann", "knows", "X", "in_source_text_direct", 1), ("f3", "ANN", None, None, None, 3), ("f4", None, "knows", "X", None, 4), ("f5", "Eve", "knows", "X", None, 5), ("f6", "Bob", "knows", None, None, 6)]
    df = E.merged_edges(resolved, spark.createDataFrame(rows, "file_name string, subject string, predicate string, object string, evidence string, ord long"))
    sorted_rows = df._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    assert "ai_hypothesis" not in sorted_rows
    assert df.columns == ["person", "ord", "source", "target", "relation_type", "weight", "confidence", "evidence_type", "provenance", "assertion_layer"]
    told = lambda *x: (*x[:5], 1.0, "low", x[5] or E.DEFAULT_EVIDENCE, f"extraction:{x[6]}", "ai_hypothesis")
    assert {tuple(r) for r in df.collect()} == {told("1", 1, "Ann", "X", "knows", "in_source_text_direct", "f1"), told("1", 3, "ANN", "", "related to", None, "f3"), told("new:bob", 6, "Bob", "", "knows", None, "f6")}


def _merged_in_order(people, persons, relations):
    """The merge row by row: each file's persons, then its relations."""
    keys, out, edges = {}, [], set()
    for pid, name, _ in sorted(people, key=lambda r: r[2]):
        if key := " ".join((name or "").split()).lower():
            keys[key] = str(pid)
    rows = [(f or "", 0, n, (f, name)) for f, n, name in persons] + [(f or "", 1, n, (f, *r)) for f, n, *r in relations]
    for *_, stage, n, r in sorted(rows, key=lambda r: r[:3]):
        key = " ".join((r[1] or "").split()).lower()
        if not key:
            continue
        if stage == 0:
            ends = [k for k in keys if k.endswith(key)] if " " in key else []
            found, made = (keys[key], False) if key in keys else (keys[ends[0]], False) if len(ends) == 1 else ("new:" + key, True)
            keys.setdefault(key, found)
            out.append((found, r[1], "new" if made else "match", r[0], None, n))
        elif key in keys:
            edge = (keys[key], r[1], r[2], r[3])
            if edge not in edges:
                edges.add(edge)
                out.append((keys[key], r[1], "edge", r[0], (r[2], r[3]), n))
    return sorted(out, key=repr)


def test_names_are_merged_once(spark):
    """every person and relation went through Python one by one, and had its key made by four patterns."""
    import random

    from corpusloom.operators import entities as E

    r = random.Random(11)
    part = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 2)))
    name = lambda: r.choice([None, " ", "\x1c", "\t"]) if r.random() < 0.1 else r.choice([str.upper, str.lower, lambda x: f" {x}"])(" ".join(part() for _ in range(r.randint(1, 3))))
    people = [(i, name(), (i * 7) % 40) for i in range(40)]
    persons = [(r.choice(["f1", "f10", "f2", "f3", None]), n, name()) for n in range(200)]
    relations = [(r.choice(["f0", "f1", "f10", "f2", "f3", None]), n, name(), r.choice("xy"), r.choice("pq")) for n in range(600)]
    p = spark.createDataFrame(people, "pid long, name string, ord long")
    e = spark.createDataFrame([(f, f, n, x) for f, n, x in persons], "file_name string, file_ord string, ord long, name string").repartition(3)
    rel = spark.createDataFrame([(f, f, n, s, o, t, None) for f, n, s, o, t in relations], "file_name string, file_ord string, ord long, subject string, object string, predicate string, evidence string").repartition(3)
    df = E.resolve_all(p, e, rel)
    got = [(x.person, x.name, x.kind, x.file_name, (x.target, x.relation_type) if x.kind == "edge" else None, x.ord) for x in df.collect()]
    assert sorted(got, key=repr) == _merged_in_order(people, persons, relations)
    assert {x[2] for x in got} == {"match", "new", "edge"}
    # what goes to Python is made of distinct names
    under = df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1:]
    assert len(under) == 2 and all(plan.count("Aggregate") >= 3 for plan in under)


def test_edges_are_told_once_a_name(spark):
    """whole edges were gathered and joined with each person, and told for each anew."""
    from corpusloom.operators import people as P

    people = spark.createDataFrame([(n, name) for n, name in enumerate(["Ann", "ann ", "Bob", "Cid", None])], "pid long, name string")
    edges = spark.createDataFrame([(" ANN" if n % 2 else "Ann" if n % 3 else "Cid", f"t{n % 4}" if n % 5 else None, "cited", n / 40, "x", (n * 7) % 40) for n in range(40)], "source string, target string, relation_type string, weight double, assertion_layer string, ord long")
    told = {"n": F.size, "targets": lambda r: F.array_join(F.transform(r, lambda x: x["target"]), ",", "-")}
    some = P.nested_edges(people, edges, fields=("target",), told=told)
    plan = [line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LogicalRDD" not in line]
    joined = "\n".join(plan).split("Join")[1]
    assert "transform" in joined and "weight" not in joined and some.columns == ["pid", "name", "n", "targets"]
    every = {r.pid: r.semantic_relationships for r in P.nested_edges(people, edges).collect()}
    assert {r.pid: (r.n, r.targets) for r in some.collect()} == {pid: (len(e), ",".join(x.target or "-" for x in e)) for pid, e in every.items()}
    assert sorted(map(len, every.values())) == [0, 0, 7, 33, 33] and set(every[0][0].asDict()) == {"ord", *P.EDGE_FIELDS}


def test_a_word_moves_once_a_block(spark, monkeypatch):
    """F1 of the fourth round: the vector of a word was sent to each document that has it, and back from each."""
    moved, summed = [], latent._summed
    monkeypatch.setattr(latent, "_summed", lambda rows, *more: (moved.append(rows.count()), summed(rows, *more))[1])
    texts = [" ".join(f"w{n}" for n in range(12) if (d * 7 + n * n) % 5) for d in range(300)] + ["", None, "once", "\u0130stanbul W1 w1"]
    docs = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "id string, text string").coalesce(1)
    one = latent.fit(docs, "id", "text", rank=4, more=4)
    words = one.terms.count()
    assert len(moved) == 3 and max(moved) <= words + 8 + 1 and words == 12
    # the same in many blocks, some of them without a word that counts
    whole = {r.id: r.vector for r in latent.vectors(docs, "id", "text", one).collect()}
    monkeypatch.setattr(latent, "CELLS", 100)
    monkeypatch.setattr(latent, "SLICE", 2)
    many = latent.fit(docs, "id", "text", rank=4, more=4)
    assert np.allclose(one.values, many.values, rtol=1e-6) and many.terms.count() == words
    parts = {r.id: r.vector for r in latent.vectors(docs, "id", "text", many).collect()}
    assert parts.keys() == whole.keys() == {f"d{n}" for n in range(304)}
    a, b = (np.array([v[k] for k in sorted(v)]) for v in (whole, parts))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-4 * (a @ a.T).max()) and not any(whole["d300"] + whole["d301"] + whole["d302"]) and any(whole["d303"])
    assert {r.id for r in latent.learned(docs, "id", "text").collect()} == whole.keys()

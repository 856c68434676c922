"""Expansion, rerank, compression and languages against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compression, feedback, language, late, retrieval

# --- expansion -----------------------------------------------------------------------


def test_expansion_against_plain(spark):
    r = random.Random(4)
    docs = [(i, Counter(r.choices("abcdefgh", k=r.randint(1, 12)))) for i in range(40)]
    index = spark.createDataFrame([(i, t, float(n)) for i, c in docs for t, n in c.items()], "id long, term string, weight double").repartition(3)
    asked = {1: {"a": 2.0, "b": 1.0}, 2: {"h": 1.0}, 3: {"zz": 1.0}}
    q = spark.createDataFrame([(i, t, w) for i, ts in asked.items() for t, w in ts.items()], "query_id long, term string, weight double")
    hits = retrieval.sparse_leg(q, index, 5)
    got = {(x.query_id, x.term): x.weight for x in feedback.rm3(q, hits, index, docs=3, terms=4, mix=0.6).collect()}
    want = {}
    for i, ts in asked.items():
        found = sorted(((-sum(w * c[t] for t, w in ts.items()), d) for d, c in docs if any(c[t] for t in ts)))[:3]
        p = Counter()
        for s, d in found:
            for t, n in dict(docs)[d].items():
                p[t] += s / sum(x for x, _ in found) * n / dict(docs)[d].total()
        best = sorted(((-round(v, 9), t) for t, v in p.items()))[:4]
        for t, w in ts.items():
            want[i, t] = want.get((i, t), 0) + 0.6 * w / sum(ts.values())
        for v, t in best:
            want[i, t] = want.get((i, t), 0) + 0.4 * v / sum(x for x, _ in best)
    assert got == pytest.approx(want, abs=1e-8) and got[3, "zz"] == 0.6
    pooled = retrieval.pooled(feedback.hypotheses(q, index, 5)).collect()
    assert {x.question_id for x in pooled} == {1, 2} and all(x.place == 0 or x.rrf_score <= 2 / 61 for x in pooled)


# --- late interaction ------------------------------------------------------------------


def test_late_interaction(spark, monkeypatch):
    vectors = late.Words()
    cos = lambda a, b: float(late.word_vector(a) @ late.word_vector(b))
    for block in (2, 4096):
        monkeypatch.setattr(late, "BLOCK", block)
        for question, text in (("the Cat sat", "a cat, sitting; SAT"), ("gödel 1931", "Kurt Godel in 1931 proved"), ("x", "y z w v u")):
            q, d = late.distinct_words(question), late.distinct_words(text)
            assert late.max_sim(question, text, vectors) == pytest.approx(np.mean([max(cos(a, b) for b in d) for a in q]), abs=1e-6)
    assert late.max_sim("same words", "words same", vectors) == 1.0
    assert late.max_sim("colour", "colours", vectors) > 0.5 > late.max_sim("colour", "window", vectors)
    assert [late.max_sim(a, b, vectors) for a, b in ((None, "x"), ("x", None), ("", ""), ("?!", "x"))] == [0.0] * 4
    candidates = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3), (2, "a", 0)], "query_id long, id string, place int")
    questions = spark.createDataFrame([(1, "green hill"), (2, None)], "query_id long, question string")
    texts = spark.createDataFrame([("a", "blue sea"), ("b", "a hill"), ("c", "green hills, hill")], "id string, text string")
    got = [(r.query_id, r.id, r.place, r.fused_place) for r in late.reranked(candidates, questions, texts, 3).orderBy("query_id", "place").collect()]
    assert [g[:3] for g in got][:2] == [(1, "c", 0), (1, "b", 1)] and (2, "a", 0, 0) in got and len(got) == 4
    assert late.reranked(candidates, questions, texts, 3, most=2).where("query_id = 1").count() == 2


# --- compression -----------------------------------------------------------------------


def test_compression_against_plain(spark):
    r = random.Random(6)
    sentence = lambda n: " ".join(r.choice(["The", "the", "of", "red", "house", "stands", "hill,", "rare" + str(r.randint(0, 30))]) for _ in range(n))
    docs = [(i, sentence(r.randint(1, 90))) for i in range(40)] + [(90, None), (91, ""), (92, " " * 300)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(4)
    n, after, before = Counter(), Counter(), defaultdict(set)
    for _, t in docs:
        w = (t or "").lower().split()
        for a, b in zip(["", *w], w):
            n[a, b] += 1
            after[a] += 1
            before[b].add(a)
    kinds = Counter(a for a, _ in n)
    model = compression.counts(df, "text")
    assert {(x.v, x.w): x.n for x in model.collect()} == n
    chance = lambda a, b: max(n[a, b] - 0.75, 0) / after[a] + 0.75 * kinds[a] / after[a] * len(before[b]) / len(n)
    for a in after:  # what follows a word sums to 1
        assert sum(chance(a, b) for b in before) == pytest.approx(1)
    got = {x.id: x for x in compression.compressed(df, ["id"], "text", model).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, t in docs:
        if t is None or len(t) < 200 or not t.split():
            assert got[i].compressed == t
            continue
        w, low = t.split(), t.lower().split()
        info = [round(-math.log2(chance(a, b)), 6) for a, b in zip(["", *low], low)]
        keep = sorted(sorted(range(len(w)), key=lambda k: (-info[k], k))[: math.ceil(0.25 * len(w))])
        assert got[i].compressed == " ".join(w[k] for k in keep) and (got[i].n_words, got[i].kept) == (len(w), len(keep))


# --- languages -------------------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text", (F.col("doc_id") % 3 == 1).alias("held_out"))
    told = language.guessed(docs, language.learn(docs.where(~F.col("held_out")))).where("held_out").collect()
    assert len(told) == 333 and sum(r.lang == r.guess for r in told) / len(told) > 0.95


def test_grams_in_pieces(monkeypatch):
    text = "Ünïcode  text\n" * 40 + "𐀀𐀁𐀂"
    whole = np.concatenate(list(language.grams(text)))
    t = " " + " ".join(text.lower().split()) + " "
    assert whole.tolist() == [((ord(a) << 42) + (ord(b) << 21) + ord(c)) % language.BUCKETS for a, b, c in zip(t, t[1:], t[2:])]
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.concatenate(list(language.grams(text))).tolist() == whole.tolist()


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "de", "der hund und die katze"), (3, "de", None), (4, None, "nothing"), (5, "de", "")], "id long, lang string, text string")
    got = {r.id: r.guess for r in language.guessed(docs, language.learn(docs)).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] == got[5] == "de"
    nothing = language.guessed(docs, language.learn(docs.where("lang = 'xx'"))).collect()
    assert len(nothing) == 5 and {r.guess for r in nothing} == {None}

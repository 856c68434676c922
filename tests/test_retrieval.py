"""Search in blocks against all pairs, and terms of very many documents."""

import numpy as np

from corpusloom.operators import retrieval as R


def test_dense_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    vectors = [(i, None if i == 5 else r.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)] + [(200, [0.0] * 4), (201, [1.0, 2.0])]
    index = spark.createDataFrame([(f"v{i}", v) for i, v in vectors], "id string, vector array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in vectors if i % 9 == 0 or i > 100], "query_id long, vector array<float>")

    def unit(v):
        n = np.sqrt(sum(x * x for x in v))
        return np.array(v) / n if n else np.array(v)

    want = []
    for q, v in vectors:
        if v is not None and (q % 9 == 0 or q > 100):
            scores = sorted((-(round(float(unit(v) @ unit(w)), 6) + 0.0), f"v{i}") for i, w in vectors if w is not None and len(w) == len(v))
            want += [(q, i, -s, n) for n, (s, i) in enumerate(scores[:7])]
    for sizes in ((4096, 256), (7, 3)):
        monkeypatch.setattr(R, "INDEX_BLOCK", sizes[0])
        monkeypatch.setattr(R, "QUESTION_BLOCK", sizes[1])
        got = sorted((x.query_id, x.dense_rank, x.id, x.dense_score) for x in R.dense_leg(asked, index, 7).collect())
        assert got == sorted((q, n, i, s) for q, i, s, n in want)


def test_sparse_terms(spark):
    docs = spark.createDataFrame([(i, "the " * (i % 4) + f"w{i % 7} w{i % 7}") for i in range(60)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "The w3 nothing"), (2, "w5")], "query_id long, text string")
    got = {(x.query_id, x.sparse_rank): (x.id, x.sparse_score) for x in R.sparse_leg(R.term_weights(asked, "query_id", "text", "query_id"), R.term_weights(docs, "id", "text"), 4).collect()}
    score = lambda q, i: (i % 4) * (q == 1) + 2.0 * (i % 7 == {1: 3, 2: 5}[q])
    for q in (1, 2):
        want = sorted((-score(q, i), i) for i in range(60) if score(q, i))[:4]
        assert [got[q, n] for n in range(4)] == [(i, -s) for s, i in want]

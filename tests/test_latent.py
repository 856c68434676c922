"""The learned space against NumPy's SVD of the whole matrix."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import latent

from .oracle import DATA


def matrix(spark, docs):
    import re

    rows = [(r.id, [w for w in re.split("[^a-z0-9]+", (r.text or "").lower()) if w]) for r in docs.collect()]
    df = {}
    for _, ws in rows:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    terms = sorted(w for w, n in df.items() if n >= 2)
    at = {w: i for i, w in enumerate(terms)}
    a = np.zeros((len(rows), len(terms)))
    for i, (_, ws) in enumerate(rows):
        for w in set(ws) & set(at):
            a[i, at[w]] = (1 + np.log(ws.count(w))) * (np.log((1 + len(rows)) / (1 + df[w])) + 1)
    return [i for i, _ in rows], a


def angles(a, b):
    return np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)


def test_space(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text").repartition(5)
    space = latent.fit(docs, "id", "text", rank=8, more=12)
    ids, a = matrix(spark, docs)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(space.values, s[:8], rtol=0.02)
    got = {r.id: r.vector for r in latent.vectors(docs, "id", "text", space).collect()}
    v = np.array([got[i] for i in ids])
    # what a document's vector is: its row times the leading right singular vectors; those apart from the rest are found well
    strong = int((s[:8] > 1.2 * s[8]).sum())
    assert strong >= 3 and angles(v[:, :strong], u[:, :strong]).min() > 0.999
    assert np.allclose(np.linalg.norm(v, axis=0), space.values, rtol=0.02)


def test_low_rank_is_exact(spark):
    """Four kinds of texts: four directions, and unrelated texts are orthogonal."""
    kinds = ["red green blue", "one two three", "cat dog", "north south east west"]
    docs = spark.createDataFrame([(i, " ".join([kinds[i % 4]] * (1 + i % 3))) for i in range(80)] + [(90, None), (91, "unseen")], "id long, text string").repartition(4)
    space = latent.fit(docs, "id", "text", rank=6, more=4)
    assert (space.values > 1e-6).sum() == 4
    got = {r.id: np.array(r.vector) for r in latent.vectors(docs, "id", "text", space).collect()}
    assert not got[90].any() and not got[91].any() and len(got) == 82
    for i in range(8):
        for j in range(8):
            cos = got[i] @ got[j] / np.linalg.norm(got[i]) / np.linalg.norm(got[j])
            assert abs(cos - (i % 4 == j % 4)) < 1e-6


def test_triangle_tree(spark, monkeypatch):
    monkeypatch.setattr(latent, "FAN", 2)
    a = np.random.default_rng(1).normal(size=(200, 5))
    rows = spark.createDataFrame([(x.tolist(),) for x in a], "v array<double>").repartition(7)
    r = latent.triangle(rows, 5)
    assert np.allclose(r.T @ r, a.T @ a)

"""Reranking by late interaction: every word of the question looks for the word of the passage that is most like it.

A word's vector is a sum of signed unit vectors, one for each of its trigrams
(with a mark before and after), so inflected and misspelt words are near and
equal words are equal.  A passage scores the mean, over the question's distinct
words, of the largest cosine with any of its words.  Pairs of question and
candidate stream through Arrow batches; a passage's distinct words meet the
question's in blocks, one matrix product each, so a very long text needs no more
memory than a short one but for its set of words.

Null and empty texts score 0, as do questions without words.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .retrieval import K_RERANK, PLACES
from .rewrites import top_k

DIM, BLOCK, KNOWN = 64, 4096, 200_000
_WORD = re.compile("[a-z0-9]+")


def word_vector(word: str) -> np.ndarray:
    """The unit vector of a lower-cased word."""
    v = np.zeros(DIM)
    marked = f"<{word}>"
    for i in range(len(marked) - 2):
        h = md5(marked[i : i + 3].encode()).digest()
        v[h[0] % DIM] += 1.0 if h[1] % 2 else -1.0
    n = np.sqrt(v @ v)
    return v / n if n else v


class Words:
    """Vectors of words, those met last kept."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = word_vector(w)
        return np.array([self.known[w] for w in words]).reshape(-1, DIM)


def distinct_words(text: str | None) -> list[str]:
    return sorted(set(_WORD.findall((text or "").lower())))


def max_sim(question: str | None, text: str | None, vectors: Words) -> float:
    asked, there = distinct_words(question), distinct_words(text)
    if not asked or not there:
        return 0.0
    q, best = vectors.of(asked), np.full(len(asked), -1.0)
    for at in range(0, len(there), BLOCK):
        best = np.maximum(best, (q @ vectors.of(there[at : at + BLOCK]).T).max(1))
    return round(float(best.mean()), PLACES) + 0.0


def scored(pairs: DataFrame, question: str = "question", text: str = "text", score: str = "rerank_score") -> DataFrame:
    """``pairs`` without the two texts, and with their score."""
    kept = [c for c in pairs.columns if c not in (question, text)]
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in kept), f"{score} double"])

    def run(batches):
        vectors = Words()
        for b in batches:
            scores = [max_sim(q, t, vectors) for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(scores, pa.float64())], names=[*kept, score])

    return pairs.select(question, text, *kept).mapInArrow(run, schema)


def reranked(candidates: DataFrame, questions: DataFrame, texts: DataFrame, k: int = K_RERANK, most: int | None = None) -> DataFrame:
    """``candidates`` (``query_id, id, place``) in the order of their score: the first ``k``, of the first ``most`` by place.

    ``questions`` has ``query_id, question``, ``texts`` ``id, text``; a candidate without a text scores 0.  Ties keep their order.
    """
    first = candidates if most is None else candidates.where(candidates["place"] < most)
    pairs = first.join(questions, "query_id").join(texts, "id", "left")
    out = scored(pairs)
    return top_k(out.withColumnRenamed("place", "fused_place"), ["query_id"], [out["rerank_score"].desc(), "fused_place"], k, "place")


def text_vectors(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, vector``: the sum of the vectors of a text's words, each as often as it stands; zeros without words."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        vectors = Words()
        for b in batches:
            out = np.zeros((b.num_rows, DIM))
            for n, text in enumerate(b.column(1).to_pylist()):
                counts = Counter(_WORD.findall((text or "").lower()))
                words = list(counts)
                for at in range(0, len(words), BLOCK):
                    out[n] += np.array([counts[w] for w in words[at : at + BLOCK]]) @ vectors.of(words[at : at + BLOCK])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select(id_col, text_col).mapInArrow(run, f"id {kind}, vector array<double>")

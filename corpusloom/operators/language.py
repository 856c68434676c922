"""Languages by character trigrams: naive Bayes over profiles counted from texts of known language.

A trigram is three code points of the lower-cased text, with a space before and
after it and white space as one space; its number is made of the three code points and
falls into one of ``BUCKETS`` buckets, so a model has ``BUCKETS`` rows and a
column a language whatever it is fitted on, and can be broadcast.  Counting and
scoring run over whole texts in NumPy, in pieces of bounded size.

Add-one smoothing; a language's prior is its share of the texts.  Texts without a
language don't train.  A null or empty text has one gram (the space twice is none), so
it gets the likeliest prior; ties go to the smaller name; without any model the guess is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, PIECE, PLACES = 262_139, 1 << 20, 4  # a prime, so that all three code points count
_SPACE = re.compile("[\x20\x09-\x0d]+")


@dataclass
class Profiles:
    names: list[str]
    prior: np.ndarray
    #: Logarithms of likelihoods: a row a language, a column a bucket.
    table: np.ndarray


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's trigrams, in pieces."""
    codes = np.frombuffer(_SPACE.sub(" ", f" {(text or '').lower()} ").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(len(codes) - 2, 0), PIECE):
        c = codes[at : at + PIECE + 2].astype(np.int64)
        yield ((c[:-2] << 42) + (c[1:-1] << 21) + c[2:]) % BUCKETS


def counted(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang, bucket, n`` (the texts themselves at bucket -1), summed in each task first."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                texts[lang] = texts.get(lang, 0) + 1
                for g in grams(text):
                    at, n = np.unique(g, return_counts=True)
                    s[at] += n
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(s[at], texts[lang]))], names=["lang", "bucket", "n"])

    given = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_col)
    return given.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles of the languages that ``docs`` name; at most ``BUCKETS`` rows a language come to the driver."""
    rows = counted(docs, lang_col, text_col).toArrow()
    lang, bucket, n = rows.column(0).to_pylist(), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    names = sorted(set(lang))
    of = np.array([names.index(x) for x in lang], int)
    table = np.zeros((len(names), BUCKETS))
    texts = np.zeros(len(names))
    texts[of[bucket < 0]] = n[bucket < 0]
    table[of[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    all_ = table.sum(1, keepdims=True) if len(names) else table
    return Profiles(names, np.log(texts / texts.sum()) if len(names) else texts, np.log((table + 1) / (all_ + BUCKETS)))


def guessed(docs: DataFrame, profiles: Profiles, text_col: str = "text", guess: str = "guess", score: str = "score") -> DataFrame:
    """``docs`` without the text and with the likeliest language and the logarithm of its likelihood."""
    kept = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"{guess} string, {score} double"])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = shared.value
        for b in batches:
            names, scores = [], []
            for text in b.column(0).to_pylist():
                s = p.prior + sum((p.table[:, g].sum(1) for g in grams(text)), np.zeros(len(p.names)))
                s = np.round(s, PLACES)
                best = int(s.argmax()) if len(s) else None
                names.append(None if best is None else p.names[best])
                scores.append(None if best is None else float(s[best]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, guess, score])

    return docs.select(text_col, *kept).mapInArrow(run, schema)

"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs (Greek, Cyrillic, full-width) and digit or
sign substitutions to Latin letters, drops zero-width and combining marks and
turns all else into one space.  A lexicon entry is a word (`` word ``) or the
beginning of words (`` begin``); at each word the entry with the largest weight
counts once.  An exception phrase takes back the weight of the entries inside
it.  The sum of weights, as such and by the length of the text, gives the score
through a logistic curve fitted to the labelled rows.

``learn`` takes at most ``LABEL_BOUND`` labelled rows (those with the smallest
hashed ids), counts folded words and beginnings in toxic and other rows with
Spark, and keeps at most ``LEXICON_BOUND`` entries whose share of toxic rows no
chance explains: log-odds as weights.  Built-in entries stay unless the labels
speak against them.

Defined results: null and empty texts score the curve's value for no match;
repeated rows are scored each on its own; an empty label table leaves the
built-in lexicon; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_sample, map_texts, picked, steps, table, texts

LABEL_BOUND = 12_000
LEXICON_BOUND = 5_000
THRESHOLD = 0.7
#: Lengths of the beginnings of words that are counted beside whole words.
BEGINNINGS = (4, 5, 6, 7)

# Folds of look-alike characters and of digits and signs that stand for letters.
HOMOGLYPHS = "аaеeоoрpсcхxуyіiјjѕsԁdһhкkмmтtвbнnαaεeιiκkνvοoρpτtυuχxγyωwѵvɡgɑaıiłløoßsæa"
SUBSTITUTES = "0o1i3e4a5s7t8b@a$s!i€e|l"

#: Built-in entries and phrases in which an entry is meant harmlessly.
BUILT_IN = {
    " idiot": 3.0, " moron": 3.0, " scum ": 3.0, " loser": 2.0, " stupid": 2.0, " worthless ": 2.0, " pathetic ": 2.0, " imbecile": 3.0, " disgusting ": 2.0, " trash ": 1.5, " clown ": 1.5,
    " shut up ": 1.5, " hate you ": 2.5, " kill yourself ": 4.0,
}
EXCEPTIONS = (" not stupid ", " stupid mistake ", " no idiot ", " is not worthless ", " winner and loser ", " trash can ", " clown fish ", " circus clown ")


def _fold_table() -> dict[int, str]:
    out: dict[int, str] = {}
    for cp in range(0x80, 0x2500):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if base == c:
            continue
        if all("a" <= x <= "z" for x in base):
            out[cp] = base
    for cp in range(0xFF21, 0xFF5B):
        out[cp] = unicodedata.normalize("NFKC", chr(cp)).lower()
    for a, b in zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2]):
        out[ord(a)] = out[ord(a.upper()[0])] = b
    for a, b in zip(SUBSTITUTES[::2], SUBSTITUTES[1::2]):
        out[ord(a)] = b
    for cp in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370)):
        out[cp] = ""
    for cp in range(0x80):
        c = chr(cp)
        if cp not in out:
            out[cp] = c.lower() if c.isalpha() else " "
    return out


class _Folds(dict):
    """Characters without an entry: letters lower-cased, all else a space."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        got = c.lower() if c.isalpha() else " "
        self[cp] = got
        return got


_TABLE = _Folds(_fold_table())
_ENDS = str.maketrans({c: " " for c in "!|"})


def folded(text: str) -> str:
    """The folded text between spaces.  ``!`` and ``|`` stand for letters inside words only."""
    if "!" in text or "|" in text:
        text = " ".join(w.rstrip("!|").lstrip("|") for w in text.split())
    return f" {' '.join(text.translate(_TABLE).split())} "


def entries_of(text: str) -> set[str]:
    """The words and beginnings of words that a text has."""
    words = set(folded(text).split())
    out = {f" {w} " for w in words if 3 <= len(w) <= 24}
    for n in BEGINNINGS:
        out.update(" " + w[:n] for w in words if n < len(w) <= 24)
    return out


@dataclass
class Lexicon:
    """Weights by entry, exception phrases and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.4, 1.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def machine(self):
        if self._machine is None:
            a = ahocorasick.Automaton()
            for p in self.exceptions:
                a.add_word(p, (len(p), 0.0))
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            a.make_automaton()
            self._machine = a
        return self._machine

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._machine = None

    def features(self, text: str) -> tuple[float, float, int]:
        """Logarithms of the weight sum and of the weight in a hundred words; the number of matches."""
        line = folded(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(line) > 2 and len(self.machine()):
            for end, (n, w) in self.machine().iter(line):
                start = end - n + 1
                if w == 0.0:
                    spared.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        for a, b in spared:
            for at in [x for x in best if a <= x <= b]:
                del best[at]
        total = sum(best.values())
        words = line.count(" ") - 1 if len(line) > 2 else 0
        return math.log1p(total), math.log1p(100 * total / max(20, words)), len(best)

    def score(self, x: tuple[float, float, int]) -> float:
        z = self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted(x: np.ndarray, y: np.ndarray, l2: float = 0.02) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression on the two sums; weights stay at or above 0."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.array([-3.0, 1.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - l2 * b * [0, 1, 1]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, l2, l2])
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -1, 1)
        b[1:] = np.maximum(b[1:], 0.05)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND, lexicon_bound: int = LEXICON_BOUND) -> Lexicon:
    """A lexicon from labelled rows (``doc_id``, ``toxic``) and their whole texts."""
    spark = docs.sparkSession
    chosen = hash_sample(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", bound)
    # at most ``bound`` ids and marks: 16 bytes each
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # copies of a text would count its words again and again
    sample = cut(sample.withColumn("__h", F.md5("text")).dropDuplicates(["__h", "toxic"]).drop("__h"))
    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Lexicon(dict(BUILT_IN))

    def spread(batches):
        for batch in steps(batches, "text"):
            entries, marks = [], []
            for text, mark in zip(texts(batch, "text"), batch.column("toxic").to_pylist()):
                got = entries_of(text)
                entries += got
                marks += [mark] * len(got)
            # words in one row of the batch add up here before they are shuffled
            both = pa.table({"entry": pa.array(entries, pa.string()), "bad": pa.array(marks, pa.int64())}).group_by("entry").aggregate([("bad", "sum"), ("bad", "count")])
            yield from both.select(["entry", "bad_sum", "bad_count"]).rename_columns(["entry", "bad", "n"]).combine_chunks().to_batches()

    counts = cut(sample.mapInArrow(spread, "entry string, bad long, n long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where("bad >= 3 or n >= 8"))
    share = bad / (bad + good)
    weight = F.log((F.col("bad") + 0.1) / F.lit(bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.1) / F.lit(good + 1.0))
    # Chernoff bound on seeing so many toxic rows by chance, against the number of entries tried
    p = (F.col("bad") - 0.01) / F.col("n")
    surprise = F.col("n") * (p * F.log(p / F.lit(share)) + (1 - p) * F.log((1 - p) / F.lit(1 - share)))
    least = 3 + 1.25 * math.log(max(10.0, (bad + good) * 3.0))
    found = counts.where(F.col("bad") >= 3).where(F.col("bad") > F.col("n") * (share + 0.5 * (1 - share))).select("entry", "bad", weight.alias("w"), surprise.alias("s")).where(F.col("s") >= least)
    rows = found.orderBy(F.desc("s"), "entry").limit(lexicon_bound).collect()
    # a built-in entry stays unless the labels speak against it
    against = {r["entry"] for r in counts.where(F.col("entry").isin(*BUILT_IN) & (F.col("n") >= 8) & (F.col("bad") < F.col("n") * 2 * share)).select("entry").collect()}
    weights = {e: w for e, w in BUILT_IN.items() if e not in against} | {r["entry"]: float(min(8.0, r["w"])) for r in rows if r["w"] > 1.0}
    lexicon = Lexicon(weights)
    given = spark.sparkContext.broadcast(lexicon)

    def measure(batches):
        lex = given.value
        for batch in steps(batches, "text"):
            x = [lex.features(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in x], pa.float64()), "b": pa.array([v[1] for v in x], pa.float64()), "y": batch.column("toxic").cast(pa.float64())})

    seen = sample.mapInArrow(measure, "a double, b double, y double").toPandas().sort_values(["a", "b", "y"])  # at most ``bound`` rows of three numbers
    lexicon.curve = fitted(seen[["a", "b"]].to_numpy(), seen["y"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``score``, ``n_matches``."""
    given = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        lex = given.value

        def run(values):
            x = [lex.features(t) for t in values]
            return {"score": [lex.score(v) for v in x], "n_matches": [v[2] for v in x]}

        return run

    return map_texts(docs, id_col, text_col, make, "score double, n_matches int")


def accepted(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all columns, that score below the threshold."""
    given = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = given.value
        for batch in steps(batches, text_col):
            yield picked(batch, [i for i, t in enumerate(texts(batch, text_col)) if lex.score(lex.features(t)) < threshold])

    return docs.mapInArrow(run, docs.schema)


def held_out() -> "F.Column":
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out()))
    out = score(docs, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")

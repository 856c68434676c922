"""Quality rules: fixed counts and a hashed n-gram logistic regression.

Words are ``[^\\x20\\x09-\\x0D]+``.  The regression's features are word unigrams and
bigrams and character 3- and 5-grams of the whole text, hashed into ``BUCKETS``
weights each; a text's value for a feature is its share of the text's n-grams of
that kind.  It is trained by full-batch Adagrad on at most ``LABEL_BOUND`` rows of
``labels`` (those with the smallest hashed ids) of at most ``CHAR_BOUND``
characters together.  A labelled text that alone has over a hundredth of
``CHAR_BOUND`` is left out of the training sample (not of the scoring), so that no
few texts use up the sample; the others count in the sample's order.  Every fifth of them is held out to fit Platt's two
calibration coefficients.  Scoring runs in Arrow batches.

Defined results: null and empty texts have no words, fail the base rules and get
the calibrated bias; repeated rows are judged each on its own; without labels of
both classes every probability is 0.5 (kept unless the base rules fail); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes_of, hash_sample, map_texts, mixed, prefix_hashes, slice_hashes, table, word_bounds

LABEL_BOUND = 2000
CHAR_BOUND = 12_000_000
#: A text of more than this share of the sample's characters doesn't train.
TEXT_SHARE = 100
BUCKETS = 1 << 17
THRESHOLD = 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
_KINDS = ("word", "bigram", "char3", "char5")
_SYMBOL_CODES = np.array(sorted(map(ord, "#*$%&|<>")), dtype=np.uint32)
_IS_SYMBOL = np.zeros(128, dtype=bool)
_IS_SYMBOL[_SYMBOL_CODES] = True


@dataclass
class Parts:
    """A text's codes, the bounds and hashes of its words."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    words: np.ndarray


def parts_of(text: str) -> Parts:
    codes = codes_of(text)
    start, end = word_bounds(codes)
    sums = prefix_hashes(codes)
    return Parts(codes, start, end, sums, slice_hashes(sums, start, end))


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; ``ids`` name the words exactly."""
    if len(ids) < 4:
        return 0
    k = np.uint64(int(ids.max()) + 1)
    if int(k) < 1 << 21:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.column_stack([ids[:-2], ids[1:-1], ids[2:]]), axis=0, return_inverse=True, return_counts=True)
    twice = (counts[inverse.ravel()] > 1).astype(np.int64)
    hit = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(hit, np.arange(len(twice)), twice)
    np.subtract.at(hit, np.arange(len(twice)) + 3, twice)
    return int((np.cumsum(hit)[:-1] > 0).sum())


_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def duplicate_lines(text: str) -> int:
    """``\\n``-split lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(_HAS_WORD.search(line))
        else:
            seen.add(line)
    return n


def grams(p: Parts) -> dict[str, np.ndarray]:
    """Hashed n-grams of each kind: bucket numbers."""
    mask = np.uint64(BUCKETS - 1)
    out = {"word": p.words & mask}
    with np.errstate(over="ignore"):
        out["bigram"] = mixed(p.words[:-1] * np.uint64(31) + p.words[1:]) & mask
    n = len(p.codes)
    for size, kind in ((3, "char3"), (5, "char5")):
        at = np.arange(max(0, n - size + 1))
        out[kind] = slice_hashes(p.sums, at, at + size) & mask
    return {k: v.astype(np.int64) for k, v in out.items()}


@dataclass
class Model:
    """Weights by kind and bucket, a bias, and the two calibration coefficients."""

    weights: dict[str, np.ndarray]
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, g: dict[str, np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[k][v].mean()) for k, v in g.items() if len(v)) if self.weights else 0.0

    def probability(self, g: dict[str, np.ndarray]) -> float:
        z = self.scale * self.logit(g) + self.shift
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fitted(values: list[str], y: np.ndarray, rounds: int = 40, rate: float = 2.0, l2: float = 1e-6) -> Model:
    """Train on four fifths of the rows, calibrate on the rest."""
    held = np.arange(len(values)) % 5 == 4
    if len(set(y[~held])) < 2:
        return Model({})
    rows: dict[str, list] = {k: [] for k in _KINDS}
    for text in values:
        for k, v in grams(parts_of(text)).items():
            at, n = np.unique(v, return_counts=True)
            rows[k].append((at.astype(np.int32), (n / max(1, len(v))).astype(np.float32)))
    flat = {k: (np.concatenate([a for a, _ in r]), np.concatenate([n for _, n in r]), np.cumsum([0] + [len(a) for a, _ in r])) for k, r in rows.items()}
    del rows
    owner = {k: np.repeat(np.arange(len(values), dtype=np.int32), np.diff(cut)) for k, (_, _, cut) in flat.items()}
    w = {k: np.zeros(BUCKETS, dtype=np.float32) for k in _KINDS}
    seen = {k: np.full(BUCKETS, 1e-8, dtype=np.float32) for k in _KINDS}
    bias, bias_seen = 0.0, 1e-8
    train = (~held).astype(np.float32)
    # both classes weigh the same in training; calibration restores the rows' own odds
    balance = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * train

    def logits() -> np.ndarray:
        return bias + sum(np.bincount(owner[k], weights=w[k][a] * n, minlength=len(values)) for k, (a, n, _) in flat.items())

    for _ in range(rounds):
        miss = (balance * (y - 1 / (1 + np.exp(-np.clip(logits(), -30, 30))))).astype(np.float32)
        for k, (a, n, _) in flat.items():
            g = np.bincount(a, weights=miss[owner[k]] * n, minlength=BUCKETS).astype(np.float32) - l2 * w[k]
            seen[k] += g * g
            w[k] += rate * g / np.sqrt(seen[k])
        g = float(miss.sum())
        bias_seen += g * g
        bias += 0.1 * g / bias_seen**0.5
    z, t = logits()[held], y[held].astype(float)
    # Platt's targets keep the curve finite where the held-out rows are parted cleanly
    up, down = (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2)
    t = np.where(t == 1, up, down)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        ga, gb = ((t - p) * z).sum() - 1e-3 * (a - 1), (t - p).sum()
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, [ga, gb]), -1, 1)
        a, b = max(1e-3, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return Model(w, float(bias), float(a), float(b))


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND, char_bound: int = CHAR_BOUND) -> Model:
    """A model from labelled rows (``doc_id``, ``quality``) and their whole texts, at most ``bound`` rows and ``char_bound`` characters, without texts over a ``TEXT_SHARE``-th of these."""
    chosen = hash_sample(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``bound`` ids and marks
    rows = rows.select("quality", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(7), "doc_id").alias("h"), "doc_id")
    values, y, held = [], [], 0
    for r in sorted(_bounded(rows, char_bound), key=lambda r: (r["h"], r["doc_id"], r["text"])):
        if held + len(r["text"]) <= char_bound:
            held += len(r["text"])
            values.append(r["text"])
            y.append(r["quality"])
    return fitted(values, np.array(y, dtype=np.int64)) if values else Model({})


def _bounded(rows: DataFrame, char_bound: int) -> list:
    """The rows without over-long texts whose running total of characters, in the sample's order, stays within the bound."""
    from pyspark.sql import Window

    total = F.sum(F.length("text")).over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over the bounded sample only
    short = rows.where(F.length("text") <= char_bound // TEXT_SHARE)  # before the running total, which a long text would end
    return short.withColumn("total", total).where(F.col("total") <= char_bound).drop("total").collect()


def judged(values: list[str], model: Model, threshold: float = THRESHOLD) -> dict[str, list]:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
    out: dict[str, list] = {n: [] for n in names}
    for text in values:
        p = parts_of(text)
        n = len(p.words)
        low = p.codes[p.codes < 128]
        # words are told apart by 64-bit hashes within one text
        _, ids = np.unique(p.words, return_inverse=True)
        repeats = repeated_words(ids.astype(np.uint64))
        failed = n < 50 or 100 * repeats > 50 * n
        probability = model.probability(grams(p)) if model.weights else 0.5
        row = (n, int((p.end - p.start).sum()), int(_IS_SYMBOL[low].sum()), duplicate_lines(text), repeats, failed, not failed and probability >= threshold, probability)
        for k, v in zip(names, row):
            out[k].append(v)
    return out


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = given.value
        return lambda values: judged(values, m, threshold)

    return map_texts(docs, id_col, text_col, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))

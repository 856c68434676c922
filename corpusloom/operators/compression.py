"""Passages cut to what they say that a reader wouldn't guess: a word model with Kneser-Ney counts, and a budget of words.

The model counts pairs of neighbouring words over all documents.  A word after
another is as likely as its discounted share of what follows that word, and for
the rest as its share of all different pairs (how many words it follows, not how
often it stands).  A word's information is the negative logarithm of that.  Of a
passage the share ``RATE`` of its words with the most information stays, in order;
passages of fewer than ``SHORT`` characters stay whole.

Words are runs of ``[^\\x20\\x09-\\x0D]``, in lower case for the model.  A passage's
first word follows the empty word.  Of equal informations the earlier word stays;
words or pairs that no document has count as seen once by half.  Null passages stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import stored

RATE, SHORT, DISCOUNT, PLACES = 0.25, 200, 0.75, 6
_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def pairs(tokens: Column) -> Column:
    """Each word (``w``) with the one before (``v``), its place and how it is written."""
    low = F.transform(tokens, F.lower)
    return F.transform(F.arrays_zip(F.concat(F.array(F.lit("")), low).alias("v"), low.alias("w"), tokens.alias("token")), lambda p, i: F.struct(i.alias("pos"), p["v"].alias("v"), p["w"].alias("w"), p["token"].alias("token")))


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``v, w, n``: how often each pair stands; counted in each batch of texts first."""

    def run(batches):
        for b in batches:
            split = pc.split_pattern(b.column(0), " ")
            tokens = split.flatten()
            kept = pc.not_equal(tokens, "")
            tokens, of = tokens.filter(kept).dictionary_encode(), pc.list_parent_indices(split).filter(kept).to_numpy()
            if not len(tokens):
                continue
            w = tokens.indices.to_numpy().astype(np.int64) + 1
            v = np.where(np.diff(of, prepend=-1) != 0, 0, np.roll(w, 1))  # a text's first word follows the empty word, 0
            names = pa.concat_arrays([pa.array([""]), tokens.dictionary])
            pair, n = np.unique(v * len(names) + w, return_counts=True)
            for i in range(0, len(n), 10_000):
                at = pair[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at // len(names))), names.take(pa.array(at % len(names))), pa.array(n[i : i + 10_000])], names=["v", "w", "n"])

    one_line = F.translate(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "\t\n\x0b\f\r", "     ")
    return docs.select(one_line.alias("text")).mapInArrow(run, "v string, w string, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def informations(asked: DataFrame, model: DataFrame) -> DataFrame:
    """``asked`` (``v``, ``w``, all different) with ``info`` in bits by the counts ``model`` (``v, w, n``)."""
    asked = stored(asked, "asked-pairs")  # its size known to the planner: the model need not be shuffled for few pairs
    seen = lambda c: model.join(asked.select(c).distinct(), c, "left_semi")
    after = seen("v").groupBy("v").agg(F.sum("n").alias("after"), F.count("*").alias("kinds"))
    before = seen("w").groupBy("w").agg(F.count("*").alias("follows"))
    kinds = model.count()
    share = F.coalesce("follows", F.lit(0.5)) / F.lit(max(kinds, 1))
    p = F.coalesce(F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("after"), F.lit(0.0)) + F.coalesce(DISCOUNT * F.col("kinds") / F.col("after"), F.lit(1.0)) * share
    counted = model.join(asked.select("v", "w"), ["v", "w"], "left_semi")
    out = asked.join(counted, ["v", "w"], "left").join(after, "v", "left").join(before, "w", "left")
    return out.select("v", "w", F.round(-F.log2(p), PLACES).alias("info"))


def compressed(passages: DataFrame, keys: list[str], text_col: str, model: DataFrame, rate: float = RATE, short: int = SHORT) -> DataFrame:
    """``keys``, ``n_words``, ``kept`` and ``compressed`` of each passage; ``keys`` are unique."""
    passages = stored(passages.select(*keys, F.col(text_col).alias("text")), "passages")  # read for long, short and blank ones
    long = passages.where(F.length("text") >= short)
    each = stored(long.select(*keys, F.explode(pairs(words(F.col("text")))).alias("p")).select(*keys, "p.*").where("w is not null"), "passage-words")
    info = informations(each.select("v", "w").distinct(), model)
    ranked = each.join(info, ["v", "w"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("info")).alias("less"), "pos", "token"))).alias("a"))
    kept = F.slice("a", F.lit(1), F.ceil(F.size("a") * rate).cast("int"))
    in_order = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token")))), lambda x: x["token"])
    cut = ranked.select(*keys, F.size("a").alias("n_words"), F.size(kept).alias("kept"), F.array_join(in_order, " ").alias("compressed"))
    n = F.size(words(F.col("text")))
    whole = passages.where((F.length("text") < short) | F.col("text").isNull()).select(*keys, n.alias("n_words"), n.alias("kept"), F.col("text").alias("compressed"))
    blank = long.where(n == 0).select(*keys, n.alias("n_words"), n.alias("kept"), F.col("text").alias("compressed"))
    return cut.unionByName(whole).unionByName(blank)

"""Questions expanded by what a first search finds: a relevance model mixed with the question (RM3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import stored

from . import retrieval as R
from .rewrites import top_k

#: Passages and terms that feed back, the question's share of the mix, and the places that a weight is rounded to before terms are ranked.
DOCS, TERMS, MIX, PLACES = 10, 20, 0.5, 9


def relevance(hits: DataFrame, index: DataFrame, docs: int = DOCS, score: str = "sparse_score", rank: str = "sparse_rank") -> DataFrame:
    """``query_id, term, p``: how likely a term is in what is relevant.

    A passage counts by its share of the first ``docs`` passages' scores, a term in
    it by its share of the passage's weight.  Only these passages' terms are read.
    """
    first = hits.where(F.col(rank) < docs).select("query_id", "id", F.col(score).alias("s"))
    all_ = first.groupBy("query_id").agg(F.sum("s").alias("all_s"))
    # the planner takes this below the counting of words, so that other passages' words are neither counted nor moved
    terms = index.join(first.select("id").distinct(), "id", "left_semi").join(first, "id")
    sizes = terms.groupBy("query_id", "id").agg(F.sum("weight").alias("size"))
    share = (F.col("s") / F.col("all_s")) * (F.col("weight") / F.col("size"))
    return terms.join(sizes, ["query_id", "id"]).join(all_.where("all_s > 0"), "query_id").groupBy("query_id", "term").agg(F.round(F.sum(share), PLACES).alias("p"))


def rm3(queries: DataFrame, hits: DataFrame, index: DataFrame, docs: int = DOCS, terms: int = TERMS, mix: float = MIX) -> DataFrame:
    """``query_id, term, weight`` of the expanded questions: ``mix`` of the question's own terms, the rest of its likeliest ones.

    Both parts sum to 1.  A question that finds nothing keeps its own terms, at ``mix``; ties go to the smaller term.
    """
    likely = top_k(relevance(hits, index, docs), ["query_id"], [F.desc("p"), F.col("term")], terms)
    kept = likely.groupBy("query_id").agg(F.sum("p").alias("all_p"))
    back = likely.join(kept, "query_id").select("query_id", "term", ((1 - mix) * F.col("p") / F.col("all_p")).alias("w"))
    own = queries.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    asked = own.join(own.groupBy("query_id").agg(F.sum("weight").alias("all_w")), "query_id").select("query_id", "term", (mix * F.col("weight") / F.col("all_w")).alias("w"))
    return asked.unionByName(back).groupBy("query_id", "term").agg(F.round(F.sum("w"), PLACES).alias("weight"))


def hypotheses(queries: DataFrame, index: DataFrame, k: int = R.K_SPARSE, **options) -> DataFrame:
    """Each question as two: as asked (``query_id`` 2n) and expanded (2n + 1), with the ``k`` best of each as ``retrieval.pooled`` takes them (``question_id`` n)."""
    first = stored(R.sparse_leg(queries, index, k), "first-hits")  # read often, and few
    second = R.sparse_leg(stored(rm3(queries, first, index, **options), "expanded"), index, k)
    both = first.withColumn("no", F.lit(0)).unionByName(second.withColumn("no", F.lit(1)))
    return both.select((F.col("query_id") * 2 + F.col("no")).alias("query_id"), F.col("query_id").alias("question_id"), F.col("id").cast("string").alias("id"), F.round(R.rrf(F.col("sparse_rank")), R.PLACES).alias("rrf_score"), F.col("sparse_rank").alias("place"))

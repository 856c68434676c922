"""Exact hybrid retrieval: dense and sparse legs, reciprocal rank fusion, passages and answers.

Questions are a table (``query_id`` and a vector, or a query's terms), so that a
batch of them is answered by one plan.  A leg keeps ``k`` rows a question before
anything is joined, and scores are rounded before they are ranked, so that equal
scores are equal on every engine; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let

from .rewrites import top_k

K_DENSE, K_SPARSE, K_PEOPLE, K_RERANK, K_CONTEXT = 30, 20, 5, 10, 5
RRF_K = 60
PLACES = 6


def unit(a: Column) -> Column:
    """The vector at length 1, in doubles; a zero vector stays.  The dot product of two is their cosine."""
    length = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    # the length is named, or it is made again for each number
    return let(a.cast("array<double>"), lambda d: let(length(d), lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n))))


#: Vectors in a stored block of an index, of the questions, and in a block that is held at once; the parts that a term of the index is split into.
INDEX_BLOCK, QUESTION_BLOCK, LEG_BLOCK, SALTS = 4096, 256, 16_384, 16


def pack(rows: DataFrame, key: str, by: list[str], size: int) -> DataFrame:
    """Vectors (``key``, ``v``) packed by task into rows of at most ``size`` with equal ``by`` and length: ``by``, ``ids``, ``dim`` and the numbers ``m``.  Null vectors go."""
    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), f"ids array<{kind}>, dim int, m binary"])
    names = [*by, "ids", "dim", "m"]

    def run(batches):
        held: dict[tuple, list] = {}
        n = 0

        def packed(mark, part):
            m = np.concatenate([v for _, v in part]).tobytes() if mark[-1] else b""
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in mark[:-1]), pa.array([[i for i, _ in part]]), pa.array([mark[-1]], pa.int32()), pa.array([m], pa.binary())], names=names)

        for batch in batches:
            for i, v, *mark in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                if v.is_valid:
                    x = v.values.to_numpy(zero_copy_only=False)
                    mark = (*mark, len(x))
                    part = held.setdefault(mark, [])
                    part.append((i, x))
                    n += 1
                    if len(part) == size:
                        n -= size
                        yield packed(mark, held.pop(mark))
            if n > 16 * size:
                yield from (packed(mark, part) for mark, part in held.items())
                held.clear()
                n = 0
        yield from (packed(mark, part) for mark, part in held.items())

    return rows.select(key, "v", *by).mapInArrow(run, schema)


def best_of_blocks(pairs: DataFrame, queries: DataFrame, k: int, score: str) -> DataFrame:
    """``query_id, id`` and ``score`` of the ``k`` best a question of each pair of blocks (``ids, m, qids, qm, dim``): one matrix product a pair."""
    kinds = queries.schema["query_id"].dataType.simpleString(), pairs.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for ids, m, qids, qm, dim in zip(*(batch.column(i) for i in range(5))):
                ids, qids = ids.values, qids.values
                a, b = (np.frombuffer(x.as_buffer(), np.float64).reshape(len(n), dim.as_py()) for x, n in ((m, ids), (qm, qids)))
                scores = np.round(b @ a.T, PLACES) + 0.0
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                rows, cols = [], []
                for row, s in enumerate(scores):
                    at = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    at = at[np.lexsort((order[at], -s[at]))][:k]
                    rows.append(np.full(len(at), row))
                    cols.append(at)
                rows, cols = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(scores[rows, cols])], names=["query_id", "id", score])

    return pairs.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, {score} double")


def nearest(index: DataFrame, queries: DataFrame, by: list[str], k: int, score: str) -> DataFrame:
    """``query_id, id`` and ``score``: for each question (``query_id, v``) the ``k`` best vectors (``id, v``) with equal ``by``, whole numbers, and equal length; none are null.

    Both sides are sorted together, vectors before questions, and stream past once in
    batches of bounded rows: a task holds the vectors of one ``by`` and length.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    on = [*by, "dim", "asks"]
    none = F.lit(None)
    rows = (
        index.select(*by, F.size("v").alias("dim"), F.lit(0).alias("asks"), "id", none.cast(kinds[0]).alias("query_id"), "v")
        .unionByName(queries.select(*by, F.size("v").alias("dim"), F.lit(1).alias("asks"), none.cast(kinds[1]).alias("id"), "query_id", "v"))
    )

    def best(ids, order, a, qids, b):
        exact = b @ a.T
        rows, cols, found = [], [], []
        for row, s in enumerate(exact):
            # what rounds to the score of the k-th is no more than a last place under it
            at = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 1.5 * 10.0**-PLACES)
            rounded = np.round(s[at], PLACES) + 0.0
            first = np.lexsort((order[at], -rounded))[:k]
            rows.append(np.full(len(first), row))
            cols.append(at[first])
            found.append(rounded[first])
        return pa.RecordBatch.from_arrays([qids.take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(found))], names=["query_id", "id", score])

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(len(on))], axis=1)
            begin = np.flatnonzero(np.any(np.diff(marks, axis=0, prepend=marks[:1] - 1), axis=1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows]):
                *mark, asks = marks[a].tolist()
                if mark != at:
                    at, held, block = mark, [], None
                part = batch.slice(a, b - a)
                m = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b - a, mark[-1])
                if not asks:
                    held.append((part.column("id"), m))
                    continue
                if held:
                    ids = pa.concat_arrays([i for i, _ in held])
                    order = np.empty(len(ids), np.int64)
                    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    block, held = (ids, order, np.concatenate([v for _, v in held])), []
                if block:
                    for q in range(0, b - a, QUESTION_BLOCK):
                        yield best(*block, part.column("query_id").slice(q, QUESTION_BLOCK), m[q : q + QUESTION_BLOCK])

    dealt = rows.repartition(*by, "dim").sortWithinPartitions(*on)
    return dealt.select(*on, "id", "query_id", "v").mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, {score} double")


def dense_leg(queries: DataFrame, index: DataFrame, k: int = K_DENSE, rank: str = "dense_rank", score: str = "dense_score") -> DataFrame:
    """The ``k`` nearest rows of ``index`` (``id``, ``vector``) to each of ``queries`` (``query_id``, ``vector``).

    Questions are a stated set against all rows.  A row of the index has one of as
    many numbers as there are blocks of ``LEG_BLOCK`` rows, and each question goes to
    every number, so that the key is even and the index moves once.  A block gives
    ``k`` rows a question at most.  Lengths are divided out before.
    """
    numbers = max(1, -(-index.count() // LEG_BLOCK))
    given = F.col("vector").isNotNull()
    q = queries.where(given).select("query_id", unit(F.col("vector")).alias("v")).select("*", F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("number"))
    rows = index.where(given).select("id", unit(F.col("vector")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(numbers)).cast("int").alias("number"))
    return top_k(nearest(rows, q, ["number"], k, score), ["query_id"], [F.desc(score), F.col("id")], k, rank)


def sparse_leg(queries: DataFrame, index: DataFrame, k: int = K_SPARSE, rank: str = "sparse_rank", score: str = "sparse_score") -> DataFrame:
    """Dot products over shared terms; both sides have one row a term (``query_id``/``id``, ``term``, ``weight``).

    Terms that no question has go first, which the planner does before it counts
    the index's terms; a term of very many documents is split into ``SALTS`` parts by document.
    """
    q = queries.select("query_id", "term", F.col("weight").alias("query_weight"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = index.join(q.select("term").distinct(), "term", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    scored = asked.join(q.select("*", parts), ["term", "salt"]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), PLACES).alias(score))
    return top_k(scored, ["query_id"], [F.desc(score), F.col("id")], k, rank)


def term_weights(docs: DataFrame, id_col: str, text_col: str, out_id: str = "id") -> DataFrame:
    """Term frequencies: one row a document and lower-cased word."""
    words = F.explode(F.filter(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), lambda w: w != ""))
    return docs.select(F.col(id_col).alias(out_id), words.alias("term")).groupBy(out_id, "term").agg(F.count("*").cast("double").alias("weight"))


def rrf(*ranks: Column) -> Column:
    return sum((F.coalesce(1.0 / (RRF_K + r + 1), F.lit(0.0)) for r in ranks), F.lit(0.0))


def fused(dense: DataFrame, sparse: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Candidates of all legs by fused score: ``query_id, id, source_no, dense_rank, sparse_rank, rrf_score, place``.

    Equal scores keep the order in which candidates come up: dense hits, then
    hits of the sparse leg only, then people (whose ids are prefixed ``tl:``).
    """
    out = dense.select("query_id", F.col("id").cast("string").alias("id"), "dense_rank")
    if sparse is not None:
        out = out.join(sparse.select("query_id", F.col("id").cast("string").alias("id"), "sparse_rank"), ["query_id", "id"], "full_outer")
    else:
        out = out.withColumn("sparse_rank", F.lit(None).cast("int"))
    out = out.withColumn("source_no", F.when(F.col("dense_rank").isNotNull(), 0).otherwise(1))
    if people is not None:
        tl = people.select("query_id", F.concat(F.lit("tl:"), F.col("id").cast("string")).alias("id"), "dense_rank", F.lit(None).cast("int").alias("sparse_rank"), F.lit(2).alias("source_no"))
        out = out.unionByName(tl)
    out = out.withColumn("rrf_score", F.round(rrf(F.col("dense_rank"), F.col("sparse_rank")), PLACES))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "source_no", F.coalesce("dense_rank", "sparse_rank"), "id")
    return out.withColumn("place", F.row_number().over(w) - 1)


def pooled(candidates: DataFrame, question: str = "question_id") -> DataFrame:
    """Candidates of several hypotheses of a question: summed fused scores, first seen first among equals."""
    seen = F.min(F.struct("query_id", "place"))
    out = candidates.groupBy(question, "id").agg(F.round(F.sum("rrf_score"), PLACES).alias("rrf_score"), seen.alias("seen"))
    w = Window.partitionBy(question).orderBy(F.desc("rrf_score"), "seen", "id")
    return out.select(question, "id", "rrf_score", (F.row_number().over(w) - 1).alias("place"))


def reranked(candidates: DataFrame, score: Column | None = None, k: int = K_RERANK) -> DataFrame:
    """The ``k`` best: by ``score`` if a provider gives one, else in fused order."""
    if score is None:
        return candidates.where(F.col("place") < k)
    return top_k(candidates.withColumn("rerank_score", score), ["query_id"], [F.desc("rerank_score"), F.col("place")], k, "place")


def passage(number: Column, title: Column, file_name: Column, author: Column, year: Column, page: Column, context: Column, text: Column) -> Column:
    """``[Source n: author, title, year, p. x]``, the context in its tag, the text."""
    from corpusloom.functions.text import blank_to_null, nonempty

    page_s = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("p. "), page.cast("string")))
    source = F.coalesce(blank_to_null(title), file_name, F.lit("Unknown source"))
    citation = F.concat_ws(", ", blank_to_null(author), source, blank_to_null(year.cast("string")), page_s)
    body = F.when(nonempty(context), F.concat(F.lit("<context>"), context, F.lit("</context>\n"), text)).otherwise(text)
    return F.concat(F.lit("[Source "), number.cast("string"), F.lit(": "), citation, F.lit("]\n"), body)


def person_passage(number: Column, name: Column, birth: Column, death: Column, era: Column, text: Column, roster: str = "People timeline") -> Column:
    """As ``passage`` for a person of the roster, cited by its title."""
    from corpusloom.functions.text import dates_note

    dates = dates_note(birth, death)
    shown = F.when(dates != "", F.concat(F.lit(" "), dates)).otherwise("")
    era_s = F.when(era.isNotNull(), F.concat(F.lit(" [Era "), era.cast("string"), F.lit("]"))).otherwise("")
    return F.concat(F.lit("[Source "), number.cast("string"), F.lit(f": {roster} — "), F.coalesce(name, F.lit("Unknown")), shown, era_s, F.lit("]\n"), F.coalesce(text, F.lit("")))


def fallback_answer(candidates: DataFrame, text: str = "text", service: str = "LLM", k: int = 3) -> DataFrame:
    """What a question gets when no model answers: its first ``k`` passages."""
    line = F.concat(F.lit("["), (F.col("place") + 1).cast("string"), F.lit("] "), F.col(text))
    top = candidates.where(F.col("place") < k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return top.select("query_id", F.concat(F.lit(f"{service} API unavailable. Top retrieved passages:\n\n"), F.array_join(F.col("lines.line"), "\n\n")).alias("answer"))


def context_order(passages: Column, documented: bool = False) -> Column:
    """Passages for the prompt.  As in use: unchanged.  ``documented``: the second best goes last."""
    if not documented:
        return passages
    n = F.size(passages)
    return F.when(n <= 2, passages).otherwise(F.concat(F.slice(passages, 1, 1), F.slice(passages, 3, n - 2), F.slice(passages, 2, 1)))

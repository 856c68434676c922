"""A sparse index of posting blocks with their largest weights, and top-k search that skips blocks.

Documents are dealt to blocks of about ``docs`` documents of like size (number of
words, in steps of a quarter of a power of two), so that long documents, whose
weights are large, stand together and blocks of short ones have small bounds.  A
row of the index is one term in one block: its documents, their weights and the
largest weight.  However frequent a term is, its rows are spread by block.

A question first sums the largest weights of its terms in each block, which reads
no postings.  The few blocks with the largest sums are scored; the k-th best of
their scores is one that the answer's k-th can't be under, so only blocks whose
sum reaches it are scored after that, and all others are skipped.  The answer is
that of scoring everything.

Ids are unique (merge rows that share one first) and weights aren't negative.
Null or empty texts have no terms; ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from corpusloom.sources.scratch import stored

from .retrieval import K_SPARSE, PLACES
from .rewrites import top_k

DOCS, PARTS, FIRST = 1024, 64, 4
LEVEL = 1 << 40  # blocks a size may have
INDEX = ("term", "block", "n", "max_weight", "ids", "weights")


def words(text: Column) -> Column:
    """The lower-cased words of a text, as ``retrieval.term_weights`` takes them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The same words with a space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def size_level(n: Column) -> Column:
    """Steps of a quarter of a power of two, in whole numbers: 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9, ..."""
    bits = F.length(F.bin(n))
    return F.when(n < 4, n).otherwise(4 * (bits - 2) + F.floor(n / F.pow(F.lit(2.0), bits - 3)) % 4).cast("int")


def dealt(key: Column) -> Column:
    """A whole number from 52 bits of a hash of ``key``."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long")


def build(docs: DataFrame, id_col: str, text_col: str, docs_in_block: int = DOCS, by: str | None = None) -> DataFrame:
    """The index (``INDEX``) of ``docs``; with ``by``, one index a value of that column, which goes first.

    A block's number is made in the row from the document's size, its id and the
    number of documents of that size: a table of at most 128 rows a value of
    ``by``, which is stored and sent to all tasks.  A document is shuffled once, as
    text; a block's postings are made in the task that has the block's documents.
    """
    keys = [by] if by else []
    rows = docs.select(*keys, F.col(id_col).alias("id"), spaced(F.col(text_col)).alias("text"))
    n = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
    rows = rows.withColumn("level", size_level(n.cast("long")))
    counts = stored(rows.groupBy(*keys, "level").agg(F.count("*").alias("of_level")), "levels")
    on = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(counts[k]) for k in [*keys, "level"]))
    block = rows["level"].cast("long") * LEVEL + F.pmod(dealt(F.col("id")), F.ceil(F.col("of_level") / docs_in_block))
    placed = rows.join(F.broadcast(counts), on).select(*(rows[k] for k in keys), block.alias("block"), "id", "text")
    dealt_out = placed.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "id")
    kinds = {f.name: f.dataType for f in dealt_out.schema}
    schema = StructType([*(StructField(k, kinds[k]) for k in keys), StructField("term", StringType()), StructField("block", LongType()), StructField("n", LongType()), StructField("max_weight", DoubleType()), StructField("ids", ArrayType(kinds["id"])), StructField("weights", ArrayType(DoubleType()))])
    return dealt_out.mapInArrow(lambda batches: _lists(batches, len(keys), to_arrow_schema(schema)), schema)


def _lists(batches, n_keys: int, schema: pa.Schema):
    """Rows of the index from documents (keys, ``block, id, text``) sorted by all but the text; a task holds the postings of one block."""
    mark, last, ids, found, n = None, None, [], [], 0

    def lists():
        terms = pa.chunked_array([f[0] for f in found]).unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy() for c in terms.chunks])
        doc, count = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        order = np.lexsort((doc, code))
        code, doc, count = code[order], doc[order], count[order].astype(float)
        # rows that share an id are one document
        begin = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        code, doc, count = code[begin], doc[begin], np.add.reduceat(count, begin)
        at = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(at, len(code))
        lists_of = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(kind)
        own = [pa.array([m] * len(at), schema.field(i).type) for i, m in enumerate(mark[:-1])]
        columns = [*own, terms.chunk(0).dictionary.take(pa.array(code[at])), pa.array([mark[-1]] * len(at), pa.int64()), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(count, at))]
        columns += [lists_of(pa.concat_arrays(ids).take(pa.array(doc)), schema.field("ids").type), lists_of(pa.array(count), schema.field("weights").type)]
        made = pa.RecordBatch.from_arrays(columns, names=schema.names)
        for i in range(0, len(at), 10_000):
            yield made.slice(i, 10_000)

    for b in batches:
        marks = list(zip(*(b.column(i).to_pylist() for i in range(n_keys + 1))))
        begins = [i for i, m in enumerate(marks) if i == 0 or m != marks[i - 1]]
        for a, z in zip(begins, [*begins[1:], len(marks)]):
            if marks[a] != mark:
                if found:
                    yield from lists()
                mark, ids, found, n = marks[a], [], [], 0
            part = b.slice(a, z - a)
            known = part.column(n_keys + 1).to_pylist()
            new = np.array([n + i == 0 or v != (known[i - 1] if i else last) for i, v in enumerate(known)])
            doc = n - 1 + np.cumsum(new)
            n, last = int(doc[-1]) + 1, known[-1]
            ids.append(part.column(n_keys + 1).filter(pa.array(new)))
            split = pc.split_pattern(part.column(n_keys + 2), " ")
            words = split.flatten()
            kept = pc.not_equal(words, "")
            words = words.filter(kept).dictionary_encode()
            if len(words):
                of = doc[pc.list_parent_indices(split).filter(kept).to_numpy()]
                key, count = np.unique(words.indices.to_numpy().astype(np.int64) * n + of, return_counts=True)
                found.append((pa.DictionaryArray.from_arrays(pa.array(key // n, pa.int32()), words.dictionary), key % n, count))
    if found:
        yield from lists()


def parted(index: DataFrame, parts: int = PARTS) -> DataFrame:
    """The index with ``part``, a number from the term, to store it by: a question reads the parts of its terms."""
    return index.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))


def _asked(queries: DataFrame, index: DataFrame, parts: int) -> tuple[DataFrame, list[str]]:
    q = queries.groupBy("query_id", "term").agg(F.sum("weight").alias("query_weight"))
    return (parted(q, parts), ["part", "term"]) if "part" in index.columns else (q, ["term"])


def bounds(queries: DataFrame, index: DataFrame, parts: int = PARTS) -> DataFrame:
    """``query_id, block, bound``: what a document of the block can score at most."""
    q, on = _asked(queries, index, parts)
    return index.select(*on, "block", "max_weight").join(q, on).groupBy("query_id", "block").agg(F.sum(F.col("max_weight") * F.col("query_weight")).alias("bound"))


def scored(queries: DataFrame, index: DataFrame, wanted: DataFrame, parts: int = PARTS) -> DataFrame:
    """``query_id, id, sparse_score`` of all documents of the blocks ``wanted`` (``query_id, block``)."""
    q, on = _asked(queries, index, parts)
    # stored, so that the planner knows how small it is, and the index need not be shuffled
    wanted = stored(wanted.select("query_id", "block").join(q, "query_id"), "wanted")
    hits = index.join(wanted, [*on, "block"])
    each = hits.select("query_id", "query_weight", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
    return each.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum(F.col("p.weights") * F.col("query_weight")), PLACES).alias("sparse_score"))


def plan(queries: DataFrame, index: DataFrame, k: int = K_SPARSE, parts: int = PARTS, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search does: the first blocks' scores, the blocks scored after them, and ``effort`` (``query_id, blocks, read, skipped``)."""
    every = stored(bounds(queries, index, parts), "bounds")
    top = stored(top_k(every, ["query_id"], [F.desc("bound"), F.col("block")], first).select("query_id", "block"), "first-blocks")
    begun = stored(scored(queries, index, top, parts), "first-scores")
    reached = top_k(begun, ["query_id"], [F.desc("sparse_score"), F.col("id")], k, "n").where(F.col("n") == k - 1).select("query_id", F.col("sparse_score").alias("least"))
    others = every.join(top, ["query_id", "block"], "left_anti").join(reached, "query_id", "left")
    rest = others.where(F.col("least").isNull() | (F.col("bound") + 10.0**-PLACES >= F.col("least"))).select("query_id", "block")
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    effort = count(every, "blocks").join(count(top.unionByName(rest), "read"), "query_id").withColumn("skipped", F.col("blocks") - F.col("read"))
    return begun, rest, effort


def search(queries: DataFrame, index: DataFrame, k: int = K_SPARSE, parts: int = PARTS, first: int = FIRST) -> DataFrame:
    """As ``retrieval.sparse_leg``, from the index: ``query_id, id, sparse_rank, sparse_score`` of the ``k`` best a question (``query_id, term, weight``)."""
    begun, rest, _ = plan(queries, index, k, parts, first)
    return top_k(begun.unionByName(scored(queries, index, rest, parts)), ["query_id"], [F.desc("sparse_score"), F.col("id")], k, "sparse_rank")

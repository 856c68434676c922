"""Vectors of texts learned from the tables: a randomised truncated SVD of the weighted term-document matrix.

A row of the matrix is a document: ``(1 + ln tf) * idf`` of its words.  A random
projection of the rows spans nearly the same space as the leading singular
vectors; each pass multiplies by the matrix and its transpose once more and makes
the columns orthonormal again (range finder with power iterations).  The random
numbers come from hashes of the words, so none are stored or sent.

Texts are split once, where they are read, into blocks of about ``CELLS`` different
words of documents: a block has a list of its words, its documents have places in
that list.  A pass sends a block the vectors of its words and makes both products
there, by document and then by word; only the latter leave it and are summed by
word.  So a word moves once a block, not once a document; in all passes but the last
as short numbers.  Columns are made
orthonormal by a tree of small QR factorisations: a task turns its rows into one
``width`` by ``width`` triangle, tasks stack ``FAN`` of these and factor them again until
one is left, so neither the driver nor a task holds more than ``FAN`` triangles.

Each row is a document, whatever its id.  Words in fewer than ``least`` documents are
left out.  Documents without other words get zero vectors; null texts count as
empty.  Singular values that are lost in the rounding of their squares (under some
3e-7 of the largest) are zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.sources.scratch import stored

from .postings import spaced

RANK, MORE, POWER, LEAST, FAN = 64, 16, 2, 2, 64
#: A block is closed at so many different words of documents, or documents; texts are split so many at a time.
CELLS, DOCS, SLICE = 1 << 21, 1 << 14, 32
#: Rounding leaves nothing of squares this small, relative to the largest.
LOST = 1e-13


@dataclass
class Space:
    """``terms`` (``term``, ``idf``, ``v``: what a document's weights are multiplied by) and the singular values."""

    terms: DataFrame
    values: np.ndarray


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` in blocks, stored.

    Of ``kind`` 0 a row a document: ``block, id, at`` (places of its words), ``tf``; of
    ``kind`` 1 a row a word of a block: ``block, term, at`` (its place), ``tf`` (in how many of
    the block's documents).
    """
    rows = docs.select(F.col(id_col).alias("id"), spaced(F.col(text_col)).alias("text"))
    schema = f"kind int, block long, id {rows.schema['id'].dataType.simpleString()}, term string, at array<int>, tf array<int>"
    schema = docs.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(schema)
    return stored(rows.mapInArrow(lambda batches: _blocks(batches, kinds), schema), "blocks", "kind")


def _blocks(batches, schema: pa.Schema):
    held, cells, docs, made = [], 0, 0, 0

    def lists(sizes, values):
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))

    def rows(kind, n, *columns):
        own = (pa.array(np.full(n, kind)), pa.array(np.full(n, TaskContext.get().partitionId() << 32 | made)), *columns)
        out = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own, schema)], schema=schema)
        for i in range(0, n, 10_000):
            yield out.slice(i, 10_000)

    def block():
        terms = pa.chunked_array([h[1] for h in held]).unify_dictionaries()
        at = np.concatenate([c.indices.to_numpy() for c in terms.chunks])
        tf, sizes = (np.concatenate([h[i] for h in held]) for i in (2, 3))
        words = terms.chunk(0).dictionary
        one = np.ones(len(words), int)
        yield from rows(0, docs, pa.concat_arrays([h[0] for h in held]), pa.nulls(docs), lists(sizes, at), lists(sizes, tf))
        yield from rows(1, len(words), pa.nulls(len(words)), words, lists(one, np.arange(len(words))), lists(one, np.bincount(at, minlength=len(words))))

    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            split = pc.split_pattern(part.column(1), " ")
            kept = pc.not_equal(split.flatten(), "")
            words = split.flatten().filter(kept).dictionary_encode()
            many = max(len(words.dictionary), 1)
            key, tf = np.unique(pc.list_parent_indices(split).filter(kept).to_numpy().astype(np.int64) * many + words.indices.to_numpy(), return_counts=True)
            held.append((part.column(0), pa.DictionaryArray.from_arrays(pa.array(key % many, pa.int32()), words.dictionary), tf, np.bincount(key // many, minlength=part.num_rows)))
            cells, docs = cells + len(key), docs + part.num_rows
            if cells >= CELLS or docs >= DOCS:
                yield from block()
                held, cells, docs, made = [], 0, 0, made + 1
    if held:
        yield from block()


def _documents(made: DataFrame) -> DataFrame:
    return made.where("kind = 0").select("block", "id", "at", "tf")


def _words(made: DataFrame) -> DataFrame:
    # a column of its own name for the block, so that a group of words can meet one of documents
    return made.where("kind = 1").select(F.col("block").alias("block"), "term", F.col("at")[0].alias("place"), F.col("tf")[0].alias("docs"))


def _normals(terms: list[str], width: int) -> np.ndarray:
    """``width`` random numbers a word, from its hash."""
    from zlib import crc32

    return np.array([np.random.default_rng([crc32(t.encode()), len(t)]).standard_normal(width) for t in terms]).reshape(-1, width)


def _vectors(column, width: int) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), width)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _rows(docs: pa.Table, words: pa.Table):
    """Of each document of a block where its words stand among ``words``, and their weights; words that aren't there stand after all and weigh nothing."""
    at, tf = (_column(docs, c).flatten().to_numpy() for c in ("at", "tf"))
    ends = np.cumsum(pc.list_value_length(_column(docs, "at")).to_numpy()) if len(docs) else []
    place = _column(words, "place").to_numpy()
    of, idf = np.full(max(at.max(initial=-1), place.max(initial=-1)) + 1, -1), np.append(_column(words, "idf").to_numpy(), 0.0)
    of[place] = np.arange(len(place))
    at = of[at]
    w = (1 + np.log(tf)) * idf[at]
    return [(at[a:z], w[a:z]) for a, z in zip([0, *ends[:-1]], ends)]


def _times_small(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``v`` times ``m``, and a row of nothing for the words that aren't there."""
    x = np.zeros((len(v) + 1, m.shape[1]))
    np.matmul(v, m, out=x[:-1])
    return x


def _products(made: DataFrame, words: DataFrame, width: int, m: np.ndarray, kind: str) -> DataFrame:
    """``term, v``: of each block with the matrix A the rows of ``A' A x``, where ``x`` are the ``v`` of ``words`` times ``m``.

    Under ``#0``, ``#1``, ... the rows of ``(A x)' A x``, under ``#`` the sum of the rows of ``A x``.
    """

    def run(docs, words):
        rows, x = _rows(docs, words), _times_small(_vectors(_column(words, "v"), width), m)
        y, out = np.zeros((len(rows), width)), np.zeros((len(x) + width + 1, width))
        for n, (at, w) in enumerate(rows):
            y[n] = w @ x[at]
            out[at] += w[:, None] * y[n]
        out[len(words) : -1] = np.vstack([y.T @ y, y.sum(0)])
        terms = [_column(words, "term").cast(pa.string()), pa.array([*(f"#{i}" for i in range(width)), "#"])]
        return pa.table([pa.concat_arrays(terms), _lists(out[:-1].astype("f4" if kind == "float" else "f8", copy=False))], names=["term", "v"])

    return _documents(made).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, f"term string, v array<{kind}>")


def _summed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Sums of the vectors ``v`` by ``key``."""
    kind, numbers = rows.schema[key].dataType.simpleString(), rows.schema["v"].dataType.simpleString()

    def run(batches):
        known, sums = {}, np.zeros((1024, width))
        for b in batches:
            if b.num_rows:
                code = b.column(0).dictionary_encode()
                of = code.indices.to_numpy()
                order = np.argsort(of, kind="stable")
                begin = np.flatnonzero(np.diff(of[order], prepend=-1))
                at = [known.setdefault(k, len(known)) for k in code.dictionary.to_pylist()]
                if len(known) > len(sums):
                    sums = np.vstack([sums, np.zeros((max(len(sums), len(known) - len(sums)), width))])
                sums[at] += np.add.reduceat(_vectors(b.column(1), width)[order], begin)
        names = list(known)
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), _lists(sums[i : i + len(part)].astype("f4" if "float" in numbers else "f8", copy=False))], names=[key, "v"])

    return rows.select(key, "v").repartition(key).mapInArrow(run, f"{key} {kind}, v {numbers}")


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """The triangle R of a QR factorisation of all rows (``v``), by a tree."""

    def reduced(batches):
        r = np.zeros((0, width))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.vstack([r, _vectors(b.column(b.num_columns - 1), width)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), TaskContext.get().partitionId()), pa.int32()), _lists(r)], names=["part", "v"])

    left = stored(rows.select("v").mapInArrow(reduced, "part int, v array<double>"), "triangles")
    while left.select("part").distinct().count() > FAN:
        tasks = -(-left.select("part").distinct().count() // FAN)
        left = stored(left.repartition(tasks, F.floor(F.col("part") / FAN)).select("v").mapInArrow(reduced, "part int, v array<double>"), "triangles")
    last = [r.v for r in left.orderBy("part", "v").collect()]  # FAN triangles at most
    return np.linalg.qr(np.vstack([np.array(last).reshape(-1, width), np.zeros((width, width))]), mode="r")


def _times(rows: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """The vectors of ``rows`` times a small matrix."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(_vectors(b.column(1), len(m)) @ m)], names=[key, "v"])

    return rows.select(key, "v").mapInArrow(run, f"{key} {kind}, v array<double>")


def fit(docs: DataFrame, id_col: str, text_col: str, rank: int = RANK, more: int = MORE, power: int = POWER, least: int = LEAST) -> Space:
    """The space of the ``rank`` largest singular values, found with ``more`` columns than that."""
    return _fitted(blocks(docs, id_col, text_col), rank, more, power, least)


def _fitted(made: DataFrame, rank: int = RANK, more: int = MORE, power: int = POWER, least: int = LEAST) -> Space:
    width = rank + more
    n = _documents(made).count()
    df = _words(made).groupBy("term").agg(F.sum("docs").alias("df")).where(F.col("df") >= least)
    idf = stored(df.select("term", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    words = stored(_words(made).join(idf, "term").select("block", "term", "place", "idf"), "words")

    def random(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(_normals(b.column(0).to_pylist(), width).astype("f4"))], names=["term", "v"])

    # stored, as the planner takes an array that isn't for one number, and would send all of them to every task
    sums, m = stored(idf.select("term").mapInArrow(random, "term string, v array<float>"), "random"), np.eye(width)
    for turn in range(power + 1):
        if turn:
            # orthonormal columns, each near a singular vector, so that what is rounded is rounded within one direction
            _, size, v = np.linalg.svd(triangle(sums.where("term not like '#%'"), width))
            kept = size > LOST * max(size[0], 1e-300)
            m = v.T * np.where(kept, 1 / np.where(kept, size, 1.0), 0.0)
        # short numbers do for directions to begin the last pass with
        sums = stored(_summed(_products(made, words.join(sums, "term"), width, m, "double" if turn == power else "float"), "term", width), "by-term")
    # Q = A x half is orthonormal, as half' (A x)' A x half is one; the SVD of A' Q, whose rows are those of the sums times half, from the small triangle
    told = {r.term: np.array(r.v) for r in sums.where("term like '#%'").collect()}
    total, square = told.get("#", np.zeros(width)), np.array([told.get(f"#{i}", np.zeros(width)) for i in range(width)])
    squares, w = np.linalg.eigh((square + square.T) / 2)
    kept = squares > LOST * max(squares[-1], 1e-300)
    half = w * np.where(kept, 1 / np.sqrt(np.where(kept, squares, 1.0)), 0.0)
    _, values, u = np.linalg.svd(triangle(sums.where("term not like '#%'"), width) @ half)
    kept = values > 1e-9 * max(values[0], 1e-300)
    # the documents' singular vectors are those whose sum isn't negative
    m = half @ u.T * np.where(total @ half @ u.T < 0, -1.0, 1.0) * np.where(kept, 1 / np.where(kept, values, 1.0), 0.0)
    found = _times(sums.where("term not like '#%'"), "term", m[:, :rank])
    return Space(stored(idf.join(stored(found, "multiplied"), "term"), "space"), np.where(kept, values, 0.0)[:rank])


def vectors(docs: DataFrame, id_col: str, text_col: str, space: Space, rank: int | None = None) -> DataFrame:
    """``id, vector`` of every row: its weights times the word vectors; nearly orthogonal for unrelated texts, of any table, fitted or not."""
    return _placed(blocks(docs, id_col, text_col), space, rank)


def _placed(made: DataFrame, space: Space, rank: int | None = None) -> DataFrame:
    held = len(space.values)
    width = rank or held

    def run(docs, words):
        x = _times_small(_vectors(_column(words, "v"), held), np.eye(held)[:, :width])
        out = np.array([w @ x[at] for at, w in _rows(docs, words)]).reshape(-1, width)
        return pa.table([_column(docs, "id"), _lists(out)], names=["id", "vector"])

    words = _words(made).join(space.terms, "term").select("block", "place", "idf", "v")
    kind = made.schema["id"].dataType.simpleString()
    return _documents(made).groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, f"id {kind}, vector array<double>")


def learned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, vector`` of every row, in the space of the same texts, which are split once."""
    made = blocks(docs, id_col, text_col)
    return _placed(made, _fitted(made))

"""An inverted-file index of vectors: cells around k-means centroids, few of which a question reads.

Centroids are fitted by Spark's k-means on a bounded sample (``SAMPLE`` rows a
cell, those of the smallest hashed ids; ``MAX_CELLS`` cells at most), and every
row goes to the cell of its nearest centroid.  A cell is stored in blocks of about
``retrieval.INDEX_BLOCK`` vectors, so a cell that holds a third of all rows is
many rows of the index, read by many tasks.

How many cells a question reads is found from ``CALIBRATED`` rows of the sample:
enough that ``target`` of the ``k`` nearest of them to ``QUESTIONS`` of their own lie
in the cells read first, counted against all of them.  The exact search goes on from
there: by the triangle inequality a row of a cell is no nearer than the centroid's
distance less the cell's radius, so only cells that can hold a row as near as the
k-th found are read.

Vectors are compared by cosine, null ones are left out, zero ones score 0.
Vectors of another length than most are cells of their own, one a length.  Ties go
to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import stored

from .retrieval import INDEX_BLOCK, K_DENSE, PLACES, QUESTION_BLOCK, best_of_blocks, pack, unit
from .rewrites import top_k

SAMPLE, MAX_CELLS, ROUNDS, QUESTIONS = 64, 4096, 10, 256
CALIBRATED = 16_384  # rows of the sample that the cells to read are found from
TARGET = 0.95
#: Questions and cells that a task holds before it passes them on.
HELD = 65_536


@dataclass
class Cells:
    """``blocks`` (``cell, salt, ids, dim, m``), the centroids, ``stats`` (cell: rows, radius, blocks) and the cells that a question reads first."""

    blocks: DataFrame
    centroids: np.ndarray
    stats: dict[int, tuple[int, float, int]]
    probes: int


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * v @ centroids.T, 0.0))


def _sample(rows: DataFrame, bound: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("id"), "id").limit(bound)


def fit(rows: DataFrame, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centroids for ``n`` rows (``id, v``, all of one length), and some of the sample they were fitted to."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = max(1, min(MAX_CELLS, round(n**0.5)))
    sample = stored(_sample(rows, SAMPLE * cells).select("v"), "sample")
    model = KMeans(k=cells, maxIter=ROUNDS, seed=seed, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centroids = np.array(model.clusterCenters())
    some = sample.limit(CALIBRATED).toArrow().column("v").combine_chunks()
    return centroids, some.flatten().to_numpy().reshape(-1, centroids.shape[1])


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The cells to read so that ``target`` of the ``k`` nearest of the sample's questions lie in them, the question itself not counted."""
    asked = sample[:: max(1, len(sample) // QUESTIONS)][:QUESTIONS]
    scores = asked @ sample.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, 1 : k + 1]
    cell = _distances(sample, centroids).argmin(1)
    order = _distances(asked, centroids).argsort(1, kind="stable").argsort(1)
    ranks = np.take_along_axis(order, cell[near], axis=1)
    if not ranks.size:
        return len(centroids)
    return int(np.searchsorted(np.cumsum(np.bincount(ranks.ravel(), minlength=len(centroids))), target * ranks.size) + 1)


def build(index: DataFrame, k: int = K_DENSE, target: float = TARGET) -> Cells:
    """The index of all rows (``id``, ``vector``)."""
    rows = index.where(F.col("vector").isNotNull()).select("id", unit(F.col("vector")).alias("v"))
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Cells(rows.select(F.lit(0).alias("cell"), F.lit(0).alias("salt"), F.array("id").alias("ids"), F.lit(0).alias("dim"), F.lit(b"").alias("m")), np.zeros((0, 0)), {}, 0)
    dim = max(sizes, key=lambda d: (sizes[d], d))
    centroids, sample = fit(rows.where(F.size("v") == dim), sizes[dim])
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    kind = rows.schema["id"].dataType.simpleString()

    def assigned(batches):
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            cell, far = -lengths.astype(np.int32) - 1, np.zeros(b.num_rows)
            at = np.flatnonzero(lengths == dim)
            for part in np.array_split(at, max(1, len(at) // 4096)):
                if len(part):
                    d = _distances(b.column(1).take(pa.array(part)).flatten().to_numpy().reshape(len(part), dim), shared.value)
                    cell[part], far[part] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    placed = stored(rows.mapInArrow(assigned, f"id {kind}, v array<double>, cell int, far double"), "placed")
    told = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    stats = {r.cell: (r.n, r.radius if r.cell >= 0 else np.inf, -(-r.n // INDEX_BLOCK)) for r in told.collect()}  # MAX_CELLS rows and one a length
    parts = F.broadcast(told.select("cell", F.ceil(F.col("n") / INDEX_BLOCK).alias("parts")))
    salted = placed.join(parts, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = salted.select("id", "v", "cell", "salt").repartition("cell", "salt").sortWithinPartitions("cell", "salt", "id")
    blocks = stored(pack(dealt, "id", ["cell", "salt"], INDEX_BLOCK), "vectors")
    return Cells(blocks, centroids, stats, min(len(centroids), probes_for(sample, centroids, k, target)))


def _probed(asked: DataFrame, cells: Cells, first: int, last: int | None) -> DataFrame:
    """Questions (``query_id, v, reach``) packed by the cells they read: those at places ``first`` to ``last`` by distance that ``reach`` (null: any distance) gets to."""
    kind = asked.schema["query_id"].dataType.simpleString()
    dim = cells.centroids.shape[1]
    full = np.array(sorted(c for c in cells.stats if c >= 0), int)
    shared = asked.sparkSession.sparkContext.broadcast((cells.centroids[full], np.array([cells.stats[c][1] for c in full])))
    odd = {c for c in cells.stats if c < 0}
    salts = {c: s[2] for c, s in cells.stats.items()}

    def run(batches):
        centroids, radius = shared.value
        held: dict[int, list] = {}
        n = 0

        def passed(cell, rows):
            m = np.concatenate([v for _, v in rows]).tobytes() if len(rows[0][1]) else b""
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([salts[cell]], pa.int32()), pa.array([[i for i, _ in rows]]), pa.array([len(rows[0][1])], pa.int32()), pa.array([m], pa.binary())], names=["cell", "salts", "qids", "qdim", "qm"])

        for b in batches:
            for i, v, reach in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                v = v.values.to_numpy(zero_copy_only=False)
                if len(v) == dim:
                    d = _distances(v[None], centroids)[0]
                    order = np.argsort(d, kind="stable")[first:last]
                    if reach is not None:
                        order = order[d[order] - radius[order] <= reach + 1e-9]
                    chosen = full[order].tolist()
                else:
                    chosen = [-len(v) - 1] if first == 0 and -len(v) - 1 in odd else []
                for c in chosen:
                    part = held.setdefault(c, [])
                    part.append((i, v))
                    n += 1
                    if len(part) == QUESTION_BLOCK:
                        yield passed(c, held.pop(c))
                if n > HELD:
                    yield from (passed(c, rows) for c, rows in held.items())
                    held.clear()
                    n = 0
        yield from (passed(c, rows) for c, rows in held.items())

    blocks = asked.select("query_id", "v", "reach").mapInArrow(run, f"cell int, salts int, qids array<{kind}>, qdim int, qm binary")
    return blocks.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "qids", "qdim", "qm")


def search(queries: DataFrame, cells: Cells, k: int = K_DENSE, exact: bool = False, rank: str = "dense_rank", score: str = "dense_score") -> DataFrame:
    """The ``k`` nearest rows to each of ``queries`` (``query_id``, ``vector``), as ``retrieval.dense_leg``: of the cells read first, or with ``exact`` of all."""
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", unit(F.col("vector")).alias("v"), F.lit(None).cast("double").alias("reach"))
    order = [F.desc(score), F.col("id")]
    found = best_of_blocks(_joined(cells, _probed(asked, cells, 0, cells.probes)), queries, k, score) if cells.stats else _nothing(queries, cells, score)
    best = top_k(found, ["query_id"], order, k, rank)
    if not exact or not cells.stats:
        return best
    best = stored(best, "first-cells")
    last = best.where(F.col(rank) == k - 1).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col(score) - 10.0**-PLACES))).alias("reach"))
    rest = best_of_blocks(_joined(cells, _probed(asked.drop("reach").join(last, "query_id", "left"), cells, cells.probes, None)), queries, k, score)
    return top_k(best.drop(rank).unionByName(rest), ["query_id"], order, k, rank)


def _joined(cells: Cells, probed: DataFrame) -> DataFrame:
    return cells.blocks.join(probed, ["cell", "salt"]).select("ids", "m", "qids", "qm", "dim")


def _nothing(queries: DataFrame, cells: Cells, score: str) -> DataFrame:
    return queries.select("query_id").limit(0).join(cells.blocks.select(F.explode("ids").alias("id"))).withColumn(score, F.lit(0.0))

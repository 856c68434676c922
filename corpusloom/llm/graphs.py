"""Connected components of an edge table, by rounds of joins; nothing is collected to the driver but one number a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_EDGE = "a long, b long"
#: A graph of so many contracted edges at most (16 bytes each) is solved by one task; a larger one by rounds of joins.
SMALL = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node each is connected with, by minimum labels with pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(batches):
    """A partition's edges as stars: edges are gathered until they are as many as the stars so far, then joined with these, so each is passed a few times."""
    nodes, tops = np.zeros(0, np.int64), np.zeros(0, np.int64)
    more, n = [], 0
    for batch in batches:
        more.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
        n += batch.num_rows
        if n >= max(200_000, len(nodes)):
            nodes, tops = roots(*(np.concatenate([x, *(m[k] for m in more)]) for k, x in enumerate((nodes, tops))))
            more, n = [], 0
    if more:
        nodes, tops = roots(*(np.concatenate([x, *(m[k] for m in more)]) for k, x in enumerate((nodes, tops))))
    keep = nodes != tops
    for at in range(0, int(keep.sum()), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep][at : at + 100_000]), pa.array(tops[keep][at : at + 100_000])], names=["a", "b"])


def _solved(batches):
    """The last step of a small graph: every node and the smallest node it is connected with."""
    pairs = [[batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)] for batch in batches]
    if pairs:
        nodes, tops = roots(*(np.concatenate([p[k] for p in pairs]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tops)], names=["id", "label"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``edges`` (``a``, ``b``, longs) → ``id``, ``label`` (the smallest id of the component) for each node that has an edge.

    Each task first turns its edges into stars, so that a node has one edge a task
    at most; a node's neighbours are then tied to the smallest of them instead of to
    the node, which keeps what is connected and leaves a node hardly more than one
    edge.  Then every node takes the smallest label next to it and its label's
    label, until nothing changes.  With ``small`` edges left at most, one task does that in one step.
    """
    stars = edges.select("a", "b").mapInArrow(_contracted, _EDGE).groupBy("a").agg(F.collect_set("b").alias("bs"), F.min("b").alias("b"))
    stars = stars.select("b", F.explode(F.array_append("bs", F.col("a"))).alias("a")).where("a > b").distinct()
    stars = cut(stars)
    if stars.limit(small + 1).count() <= small:
        return cut(stars.coalesce(1).mapInArrow(_solved, "id long, label long"))
    both = cut(stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("label").alias("above"))
        step = cut(step.join(up, "new").select("id", F.least("new", "above").alias("new"), (F.col("label") != F.least("new", "above")).alias("moved")))
        moved = step.agg(F.count_if("moved")).first()[0]
        labels = step.select("id", F.col("new").alias("label"))
        if not moved:
            return labels

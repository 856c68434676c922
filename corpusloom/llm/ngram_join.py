"""Similarity join on word shingles: a MinHash LSH forest, then exact verification.

A text's shingles are its runs of ``SHINGLE`` words (``[^\\x20\\x09-\\x0D]+``); a text
of fewer words has itself as its one shingle.  Two texts are linked if the
Jaccard similarity of their shingle sets is at least ``THRESHOLD``.

1. Equal texts become one; its smallest id stands for it.  Inside, a text goes by
   its name, a 64-bit hash of its key, as unlike texts may share an id.
2. A text has a label in each of ``TREES`` tries: ``DEPTH`` MinHash values of 16 bits.
   Spark sorts the labels of each trie; in sorted order the texts below a node
   stand together, and the common prefix of two neighbours is the depth of the
   node that parts them.  One pass over the sorted labels thus gives the whole
   forest as ties (neighbour, neighbour, common prefix), also across the bounds of partitions.
3. The join begins with prefixes of ``DEPTH`` values.  Texts that share a node of that
   depth in some trie are brought together through the connected components of
   the ties.  Many of them merely share boilerplate, so their whole signatures, a byte
   a value, are compared first: a pair is a candidate if at least ``least_equal`` of
   them are equal, which a pair at the threshold misses less than once in a thousand million.
   Only the connected components of candidates are verified exactly.  The similarities of the links found tell
   how many were missed: a pair of similarity s shares a node of depth d with
   probability ``1 - (1 - s**d) ** TREES``, so each link found stands for one over
   that many.  One link at the threshold is added to what was found, as what
   nothing speaks of may still be there.  While the estimated recall is below ``RECALL``,
   the prefix is shortened to the longest at which it would be met, and what
   meets there for the first time is verified, down to ``least_depth``, at which a pair at
   the threshold is missed less than once in ten million.
4. Signatures and sets are both compared in pieces.  A component too large for one task is cut by classes of set size (linked
   sets differ by a factor of the threshold at most, so only neighbouring classes
   meet) and by hashed name into blocks of bounded size; each pair of blocks is a piece of work.
   A piece gives a count of links for each text and one edge to the smallest
   name of its linked group.
5. A class is a connected component of the verified links; its id is the smallest
   id of its texts.

Defined results: null and empty texts are equal texts without shingles and have
no links; repeated rows are copies; unlike texts under one id are told apart by
their keys, each with a row of its own; rows with a null id are left out of ``classes``
and stay in ``keep_first``; an empty table gives no rows; extra columns, whatever
their names, are ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, mixed, steps, table, texts, word_hashes
from .graphs import components, roots

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
#: Estimated share of links that the forest must have found before prefixes are no longer shortened.
RECALL = 0.999999
#: A block of a large component: texts and shingles at most (on average over hashed names).
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 400_000
#: A block of signatures of a large component, texts at most (on average over hashed names).
BLOCK_SIGNED = 2048
#: Bins of similarity, from the threshold to 1, in which links are counted.
BINS = 20
SEED = 20240601


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles, in order."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(min(size, len(w))))
        for k in range(min(size, len(w))):
            out = mixed(out * np.uint64(0x100000001B3) + w[k : k + n])
    return out


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a node of ``depth`` in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is missed less than once in ten million; 1 if there is none."""
    return next((d for d in range(depth, 1, -1) if 1 - found_share(threshold, d, trees) < 1e-7), 1)


def least_equal(threshold: float = THRESHOLD, values: int = TREES * DEPTH) -> int:
    """The largest number of equal values that a pair at the threshold falls short of less than once in a thousand million."""
    below, k = 0.0, 0
    while k < values:
        below += math.exp(math.lgamma(values + 1) - math.lgamma(k + 1) - math.lgamma(values - k + 1) + k * math.log(threshold) + (values - k) * math.log1p(-threshold)) if threshold < 1 else 0.0
        if below >= 1e-9:
            break
        k += 1
    return k


def estimated_recall(links: np.ndarray, depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """The share of all links that were found at ``depth``, from the counts of those found by similarity bin and one more at the threshold."""
    counts = np.concatenate([[1], links])
    lows = np.concatenate([[threshold], threshold + (1 - threshold) * np.arange(len(links)) / len(links)])
    return float(counts.sum() / sum(c / found_share(s, depth, trees) for c, s in zip(counts, lows)))


def next_depth(links: np.ndarray, depth: int, least: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int | None:
    """The prefix to shorten to, None if ``depth`` meets the recall or can't be shortened."""
    if depth <= least or estimated_recall(links, depth, threshold, trees) >= recall:
        return None
    return next((d for d in range(depth - 1, least, -1) if estimated_recall(links, d, threshold, trees) >= recall), least)


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def labels_of(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The MinHash values of a text, 16 bits each, big-endian, trie after trie."""
    x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(a), np.uint32(2**32 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            np.minimum(low, (a[:, None] * (x[None, at : at + 512] ^ b[:, None])).min(axis=1), out=low)
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        low = (low ^ (low >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (low >> np.uint32(16)).astype(">u2").tobytes()


def text_key() -> Column:
    """The key that ``signed`` gives a text."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def signed(docs: DataFrame, trees: int = TREES, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, the text's key, its number of shingles, its labels (none without shingles)."""

    def make():
        a, b = coefficients(trees * DEPTH)

        def run(values):
            out = {"tkey": [], "n": [], "labels": []}
            for t in values:
                sh = shingles(t, size)
                out["tkey"].append(hashlib.sha256(t.encode("utf-8")).digest()[:16])
                out["n"].append(len(sh))
                out["labels"].append(labels_of(sh, a, b) if len(sh) else None)
            return out

        return run

    return map_texts(docs.where("doc_id is not null"), "doc_id", "text", make, "tkey binary, n long, labels binary")


# --- the forest -------------------------------------------------------------------

_TIES = "a long, b long, depth int, part int, last boolean, tree int, label binary"


def _neighbours(least: int):
    """From sorted (tree, label, name): ties of neighbours whose common prefix has ``least`` values or more, and the first and the last row."""

    def run(batches):
        part = TaskContext.get().partitionId()
        edge = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(len(tree), DEPTH)
            if edge is None:
                yield _edge_row(part, False, tree[0], label[0], name[0])
            else:
                tree, name, label = np.concatenate([edge[0], tree]), np.concatenate([edge[2], name]), np.concatenate([edge[1], label])
            same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            at = np.flatnonzero((same >= least) & (name[1:] != name[:-1]))
            if len(at):
                none = pa.nulls(len(at), pa.int32())
                cols = [pa.array(name[at + 1]), pa.array(name[at]), pa.array(same[at], pa.int32()), none, pa.nulls(len(at), pa.bool_()), none, pa.nulls(len(at), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "depth", "part", "last", "tree", "label"])
            edge = tree[-1:], label[-1:], name[-1:]
        if edge is not None:
            yield _edge_row(part, True, edge[0][0], edge[1][0], edge[2][0])

    return run


def _edge_row(part: int, last: bool, tree, label: np.ndarray, name) -> pa.RecordBatch:
    row = {"a": int(name), "b": None, "depth": None, "part": part, "last": last, "tree": int(tree), "label": label.tobytes()}
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row.values(), kinds)], names=list(row))


def forest(labelled: DataFrame, trees: int = TREES, least: int = 1) -> DataFrame:
    """(``name``, ``labels``) → ties (``a``, ``b``, ``depth``) of neighbours in the sorted tries with common prefixes of ``least`` values or more.

    Labels are dealt to tasks by range of (trie, label, name), so a node with very many texts spreads over several.
    What stands at a partition's two ends, two rows for each partition, is joined on the driver.
    """
    width = 2 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = labelled.select("name", "labels", tree).select("tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "name")
    rows = rows.repartitionByRange("tree", "label", "name").sortWithinPartitions("tree", "label", "name")
    found = cut(rows.mapInArrow(_neighbours(least), _TIES))
    ends = sorted(found.where("part is not null").select("part", "last", "tree", "label", "a").collect(), key=lambda r: (r.part, r["last"]))
    across = []
    for x, y in zip(ends, ends[1:]):
        if x.part != y.part and x.tree == y.tree and x.a != y.a:
            same = next((k for k in range(DEPTH) if x.label[2 * k : 2 * k + 2] != y.label[2 * k : 2 * k + 2]), DEPTH)
            if same >= least:
                across.append((y.a, x.a, same))
    ties = found.where("part is null").select("a", "b", "depth")
    return ties.union(labelled.sparkSession.createDataFrame(across, "a long, b long, depth int")) if across else ties


# --- exact verification ---------------------------------------------------------


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share.

    Shingles in few sets add their pairs one by one; those in many are columns
    of a matrix that is multiplied by itself, some columns at a time.
    """
    m = len(sets)
    if m == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    seen = np.diff(np.concatenate([first, [len(flat)]]))
    out = np.zeros((m, m), dtype=np.float32)
    few = max(8, m // 10)
    for d in np.unique(seen[(seen > 1) & (seen <= few)]):
        at = first[seen == d]
        for part in np.array_split(at, len(at) * int(d) ** 2 // 1_000_000 + 1):
            rows = owner[part[:, None] + np.arange(d)]
            pairs = rows[:, :, None] * m + rows[:, None, :]
            out += np.bincount(pairs.ravel(), minlength=m * m).reshape(m, m) if pairs.size * 4 > m * m else _sparse(pairs.ravel(), m)
    many = np.flatnonzero(seen > few)
    width = max(64, 4_000_000 // m)
    for at in range(0, len(many), width):
        part = many[at : at + width]
        x = np.zeros((m, len(part)), dtype=np.float32)
        for c, s in enumerate(part):
            x[owner[first[s] : first[s] + seen[s]], c] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _sparse(pairs: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(m * m, dtype=np.float32)
    at, n = np.unique(pairs, return_counts=True)
    out[at] = n
    return out.reshape(m, m)


def links_of(ids: np.ndarray, sets: list[np.ndarray], apart: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its links within the piece and the smallest id of its linked group; the links' counts by bin of similarity.

    ``apart``: arrays in which only texts with different values are looked at.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    c = common_counts(sets)
    sums = sizes[:, None] + sizes[None, :]
    linked = c * np.float32(1 + threshold) >= np.float32(threshold - 1e-5) * sums  # what is near the threshold is settled below
    np.fill_diagonal(linked, False)
    for x in apart:
        linked &= x[:, None] != x[None, :]
    i, j = np.nonzero(np.triu(linked))
    both = c[i, j].astype(np.float64)
    similar = both / (sizes[i].astype(np.float64) + sizes[j] - both)
    exact = similar >= threshold - 1e-12
    i, j, similar = i[exact], j[exact], similar[exact]
    n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    bins = np.bincount(np.clip(((similar - threshold) / (1 - threshold) * BINS + 1e-9).astype(np.int64), 0, BINS - 1), minlength=BINS)
    top = ids.copy()
    if len(i):
        nodes, low = roots(ids[i], ids[j])
        at = np.searchsorted(nodes, ids)
        at[at == len(nodes)] = 0
        hit = nodes[at] == ids
        top[hit] = low[at[hit]]
    return n, top, bins


def close_pairs(signatures: np.ndarray, least: int) -> np.ndarray:
    """Which two rows of bytes are equal in ``least`` places or more; tiles of rows, so that the counts stay in the processor's cache."""
    m, width = signatures.shape
    if m <= 32:
        return (signatures[:, None] == signatures[None]).sum(axis=2) >= least
    out = np.zeros((m, m), dtype=bool)
    columns = np.ascontiguousarray(signatures.T)
    tile = 512
    for a in range(0, m, tile):
        for b in range(a, m, tile):
            x, y = columns[:, a : a + tile], columns[:, b : b + tile]
            n = np.zeros((x.shape[1], y.shape[1]), dtype=np.uint8 if width < 256 else np.uint16)
            for k in range(width):
                n += x[k][:, None] == y[k]
            out[a : a + tile, b : b + tile] = n >= least
            out[b : b + tile, a : a + tile] = (n >= least).T
    return out


def stars_of(ids: np.ndarray, close: np.ndarray) -> list[tuple[int, int]]:
    """An edge from each text of a connected group to its smallest id; each row of ``close`` is read once."""
    left = np.ones(len(ids), dtype=bool)
    out = []
    for s in np.argsort(ids):
        if not left[s]:
            continue
        left[s], line = False, np.array([s])
        while len(line):
            near = close[line].any(axis=0) & left
            left &= ~near
            line = np.flatnonzero(near)
            out.extend((int(ids[k]), int(ids[s])) for k in line)
    return out


def _groups(batches):
    """Pieces in order: their key and their rows (name, block, before, sh)."""
    key, group = None, []
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("label", "i", "j", "name", "block", "before", "sh")]
        for label, i, j, name, block, before, sh in zip(*cols):
            if key != (label, i, j):
                if len(group) > 1:
                    yield key, group
                key, group = (label, i, j), []
            group.append((name, block, before, sh))
    if len(group) > 1:
        yield key, group


def _close(least: int):
    def run(batches):
        out = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=["a", "b"])
            out.clear()
            return batch

        for key, group in _groups(batches):
            ids, block, before = (np.array([g[k] for g in group], dtype=np.int64) for k in range(3))
            close = close_pairs(np.frombuffer(b"".join(g[3] for g in group), dtype=np.uint8).reshape(len(group), -1)[:, 1::2], least)  # the low byte of each value
            for x in [before] + [block] * (key[1] != key[2]):
                close &= x[:, None] != x[None, :]
            out += stars_of(ids, close)
            if len(out) > 20_000:
                yield flush()
        if out:
            yield flush()

    return run


_PIECES = "name long, links long, top long, bins array<long>"


def _verify(threshold: float):
    def run(batches):
        out = []

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["name", "links", "top", "bins"])
            out.clear()
            return batch

        for key, group in _groups(batches):
            ids, block, before = (np.array([g[k] for g in group], dtype=np.int64) for k in range(3))
            n, top, bins = links_of(ids, [np.frombuffer(g[3], dtype=np.uint64) for g in group], [before] + [block] * (key[1] != key[2]), threshold)
            at = np.flatnonzero(n)
            out.extend((int(ids[k]), int(n[k]), int(top[k]), bins.tolist() if k == at[0] else None) for k in at)
            if len(out) > 20_000:
                yield flush()
        if out:
            yield flush()

    return run


def _pieces(sets: DataFrame, parts: DataFrame, threshold: float, block_texts: int, block_shingles: int) -> DataFrame:
    """(``name``, ``n``, ``label``, ``before``) of components, with their sets → pieces: ``label``, blocks ``i`` and ``j``, and the rows of both."""
    blocks = lambda m, n: F.greatest(F.lit(1), F.ceil(m / block_texts), F.ceil(n / block_shingles)).cast("long")
    # linked sets are in the same class of size or the next
    parts = parts.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(threshold))) + 1e-9).cast("long"))
    sizes = parts.groupBy("label", "class").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    # some sixty classes a component at most; only counts are dealt by component, never its rows
    large = sizes.groupBy("label").agg(blocks(F.sum("m"), F.sum("n")).alias("all"), F.map_from_entries(F.collect_list(F.struct("class", blocks(F.col("m"), F.col("n"))))).alias("blocks"))
    large = cut(large.where("all > 1").select("label", "blocks"))
    parts = parts.join(large, "label", "left")
    code = lambda class_, k: class_ * F.lit(2**32) + k
    parts = parts.withColumn("block", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(code(F.col("class"), F.pmod(F.xxhash64("name"), F.col("blocks")[F.col("class")]))))
    near = F.filter(F.sequence(F.col("class") - 1, F.col("class") + 1), lambda c: F.map_contains_key("blocks", c))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks")[c] - 1), lambda k: code(c, k))))
    parts = parts.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)))
    parts = parts.select("name", "label", "before", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return sets.join(parts, "name").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "name")


def _met(parts: DataFrame, before: DataFrame | None) -> DataFrame:
    """Components (``name``, ``label``) with each text's component of the round before; those that are as they were have nothing new."""
    if before is None:
        return parts.withColumn("before", F.col("name"))
    now = parts.join(before.withColumnRenamed("label", "before"), "name", "left").withColumn("before", F.coalesce("before", "name"))
    grown = now.groupBy("label").agg((F.min("before") < F.max("before")).alias("grown")).where("grown").select("label")
    return now.join(grown, "label", "left_semi")


def classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, size: int = SHINGLE, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES, report: dict | None = None) -> DataFrame:
    """``doc_id``, ``rep_id`` (smallest id with the same text), ``class_id``, ``n_links`` (other texts it is linked to).

    ``report`` gets the prefixes used (``depths``), how many texts went to exact verification at each (``verified``), the links by
    similarity (``links``) and the estimated ``recall``.
    """
    return _classes(docs, threshold, trees, recall, size, block_texts, block_shingles, report).drop("tkey")


def _classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, size: int = SHINGLE, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES, report: dict | None = None) -> DataFrame:
    """``classes`` with the text's key; (``doc_id``, ``tkey``) is a row's identity."""
    rows = cut(signed(docs, trees, size))
    # materialised, so that the join below has an exchange on both sides and a text with very many copies can be split over tasks
    reps = cut(rows.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "labels"), "doc_id").alias("of")))
    texts_ = reps.where("of.labels is not null").select(F.xxhash64("tkey").alias("name"), "rep", "tkey", "of.n", "of.labels")
    least = least_depth(threshold, trees)
    ties = forest(texts_, trees, least)
    met = ties.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    sets = cut(_sets(docs, texts_.select("name", "rep", "tkey", "n").join(met, "name", "left_semi"), size))
    signatures = texts_.select("name", F.col("labels").alias("sh"))
    coarse_before, before, edges, links, found, depths, verified = None, None, None, np.zeros(BINS, dtype=np.int64), [], [], []
    depth: int | None = DEPTH
    while depth is not None:
        depths.append(depth)
        coarse = components(ties.where(F.col("depth") >= depth).select("a", "b")).withColumnRenamed("id", "name")
        now = cut(_met(coarse, coarse_before).join(sets.select("name", "n"), "name"))
        close = cut(_pieces(signatures, now, threshold, BLOCK_SIGNED, 2**62).mapInArrow(_close(least_equal(threshold, trees * DEPTH)), "a long, b long"))
        edges = close if edges is None else edges.union(close)
        parts = components(edges).withColumnRenamed("id", "name")
        now = cut(_met(parts, before).join(sets.select("name", "n"), "name"))
        if report is not None:
            verified.append(now.count())
        links_now = cut(_pieces(sets.select("name", "sh"), now, threshold, block_texts, block_shingles).mapInArrow(_verify(threshold), _PIECES))
        found.append(links_now.select("name", "links", "top"))
        for k, c in links_now.where("bins is not null").select(F.posexplode("bins").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect():
            links[k] += c
        coarse_before, before = coarse, parts
        depth = next_depth(links, depth, least, threshold, trees, recall)
    if report is not None:
        report |= {"depths": depths, "verified": verified, "links": links.tolist(), "recall": estimated_recall(links, depths[-1], threshold, trees)}
    all_ = found[0]
    for x in found[1:]:
        all_ = all_.union(x)
    tops = components(all_.where("name <> top").select(F.col("name").alias("a"), F.col("top").alias("b"))).select(F.col("id").alias("name"), F.col("label").alias("top"))
    linked = all_.groupBy("name").agg(F.sum("links").alias("n_links")).join(tops, "name").join(texts_.select("name", "rep", "tkey"), "name")
    linked = cut(linked.select("tkey", "rep", "n_links", "top"))  # as with ``reps``
    ids = cut(linked.groupBy("top").agg(F.min("rep").alias("class_id")))
    of = cut(reps.select("tkey", "rep").join(linked.join(ids, "top").select("tkey", "class_id", "n_links"), "tkey", "left"))
    return rows.select("doc_id", "tkey").join(of, "tkey").select("doc_id", "tkey", F.col("rep").alias("rep_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``name``, ``n`` and the shingle sets, as sorted 64-bit numbers, of the texts that met others in the forest."""
    rows = docs.select(F.col("doc_id").alias("rep"), text_key().alias("tkey"), "text").join(wanted.select("name", "rep", "tkey"), ["rep", "tkey"]).dropDuplicates(["name"])

    def run(batches):
        for batch in steps(batches, "text"):
            sh = [np.unique(shingles(t, size)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([len(x) for x in sh], pa.int64()), pa.array([x.tobytes() for x in sh], type=pa.binary())], names=["name", "n", "sh"])

    return rows.select("name", "text").mapInArrow(run, "name long, n long, sh binary")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that have a smaller id in their class; one row for equal id and text."""
    first = _classes(docs, threshold).where("doc_id = class_id").select("doc_id", "tkey").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = docs.where("doc_id is not null").select("doc_id", text_key().alias("tkey"), row).join(first, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).union(docs.where("doc_id is null"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


#: DuckDB SQL for ``op9``: all pairs that share a shingle, then the closure of the links.
OP9_SQL = r"""
WITH RECURSIVE
t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT text, min(doc_id) AS rep FROM t GROUP BY text),
s AS (SELECT DISTINCT doc_id AS rep, array_to_string(w[i : i + 4], ' ') AS g FROM t SEMI JOIN r ON doc_id = rep, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.rep JOIN n y ON b = y.rep WHERE 9 * c >= 4 * (x.n + y.n)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT x AS id, x AS top FROM e UNION SELECT e.y, reach.top FROM reach JOIN e ON e.x = reach.id),
top AS (SELECT id, min(top) AS top FROM reach GROUP BY id),
k AS (SELECT x AS id, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, rep AS rep_id, coalesce(top, rep) AS class_id, coalesce(n_links, 0) AS n_links FROM t JOIN r USING (text) LEFT JOIN top ON rep = top.id LEFT JOIN k ON rep = k.id
"""

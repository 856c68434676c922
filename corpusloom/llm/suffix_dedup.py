"""Removal of byte strings of ``LENGTH`` that an earlier document has, by anchored fingerprints of growing strings.

Prefix doubling over all byte positions shuffles every position in every round.
Here the rounds run over anchors: a position is an anchor if its ``GRAM`` bytes
have the smallest name (leftmost if equal) of some ``LENGTH``-byte string, so every such
string holds the anchor that its content chooses, at the same offset wherever the
string occurs.  Names are 64-bit hashes of strings, which equal strings share, so
a rank needs no sort of all positions; Spark brings equal names together.

1. Names of ``GRAM`` bytes at the anchors: those of one document only are done.
2. Names of the context, all bytes that strings with this anchor can hold: in each
   context the smallest document stays, the others' contexts are removed whole.
3. Names of twice the length: every string holds ``GRAM`` + ``HALF`` bytes to the right
   of its anchor or as many to the left.  Contexts that share a name of round 1 but
   neither of these are done (16 bits of each name travel; equal ones only cost work).
4. Contexts that share one are ranked once more by each of their strings of
   ``LENGTH`` bytes on that side; only the edges of repeated passages come this far.
   Here names have 128 bits.

A task settles what its own documents show before anything is shuffled (equal
contexts, equal strings, names with more than ``HOT`` contexts), so a passage in
very many documents brings a bounded number of rows of each task together.

A document's removed bytes follow from its marked contexts and strings, which
are found again in the whole document; the text itself is shuffled by id once.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing;
rows with the same id are one document (never removed for each other); rows with
a null id neither lose nor cause anything; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import inverses, mixed, powers, settled, steps, table

LENGTH = 50
GRAM = 16
HALF = (LENGTH - GRAM) // 2
#: What a mark asks for, in the lowest bits of a context's name.
REMOVE, RIGHT, LEFT = 1, 2, 4
_BITS = np.uint64(7)
_SEEDS = np.random.default_rng(5).integers(0, 2**63, (2, 256), dtype=np.uint64)


def sums(b: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which names of slices follow."""
    with np.errstate(over="ignore"):
        h = np.empty(len(b) + 1, np.uint64)
        h[0] = 0
        np.cumsum(_SEEDS[which][b] * powers(len(b)), out=h[1:])
    return h


def names(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((h[end] - h[start]) * inverses(len(h))[start])


def anchors(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors and the names of their ``gram`` bytes."""
    n = len(h) - 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = n - gram + 1
    with np.errstate(over="ignore"):
        g = mixed((h[gram:] - h[:m]) * inverses(len(h))[:m])
    # the name's upper half and the position: the smallest is the leftmost of the smallest
    x = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    at = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, g[at]


def contexts(h: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and name of what strings with these anchors can hold; the lowest bits of a name are clear."""
    n = len(h) - 1
    lo, hi = np.maximum(0, at - (length - gram)), np.minimum(n, at + length)
    with np.errstate(over="ignore"):
        c = mixed(names(h, lo, hi) + (at - lo).astype(np.uint64) * np.uint64(256) + (hi - at).astype(np.uint64))
    return lo, hi, c & ~_BITS


def sides(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of the names to the right of the anchors and, above them, to the left; 0 where the text ends before."""
    n = len(h) - 1
    out = np.zeros(len(at), dtype=np.uint32)
    for shift, lo, hi in ((0, at, at + LENGTH - HALF), (16, at - HALF, at + GRAM)):
        there = (lo >= 0) & (hi <= n)
        tag = (names(h, lo[there], hi[there]) >> np.uint64(16)).astype(np.uint32) & np.uint32(0xFFFF)
        out[there] |= np.maximum(tag, np.uint32(1)) << np.uint32(shift)
    return out


def strings(lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts of all strings of ``length`` bytes between the bounds, each once."""
    n = np.maximum(0, hi - lo - length + 1)
    first = np.repeat(lo, n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(first + step)


def _bytes_of(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid and value.as_buffer().size else np.zeros(0, np.uint8)


def _packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of (bucket, packed columns): numbers as they are, the last column (ids) as low and high halves."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    ids = columns[-1][order].view(np.uint64)
    columns = [*(c[order] for c in columns[:-1]), (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint32)]
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, type=pa.binary())], names=["bucket", "packed"])


def _unpacked(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The columns of several blobs: those of ``kinds`` and the ids."""
    kinds = (*kinds, np.uint32, np.uint32)
    widths = [np.dtype(k).itemsize for k in kinds]
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = len(b) // sum(widths), 0
        for k, (kind, w) in enumerate(zip(kinds, widths)):
            out[k].append(np.frombuffer(b, kind, n, at))
            at += n * w
    cols = [np.concatenate(x) for x in out]
    return [*cols[:-2], (cols[-2].astype(np.uint64) | (cols[-1].astype(np.uint64) << np.uint64(32))).view(np.int64)]


def _by_bucket(batches):
    """Each bucket and its blobs, from rows in the order of buckets."""
    at, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at:
                if blobs:
                    yield at, blobs
                at, blobs = bucket, []
            blobs.append(blob)
    if blobs:
        yield at, blobs


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin in sorted columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _grouped(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate([first, [n]]))


def _several(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether rows, sorted by the keys, are in a group with more than one document."""
    first = _starts(*keys)
    if not len(first):
        return np.zeros(0, dtype=bool)
    return np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), _grouped(first, len(doc)))


def ranked_contexts(name: np.ndarray, context: np.ndarray, tags: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounds 1 to 3 on a bucket: ids and contexts, with what is asked for each in the lowest bits."""
    order = np.argsort(name, kind="stable")
    first = _starts(name[order])
    if not len(first):
        return doc[:0], context[:0]
    told = np.repeat(np.minimum.reduceat(context[order], first) == 0, _grouped(first, len(order)))
    keep = _several(doc[order], name[order]) | told
    order, told = order[keep], told[keep]
    sort = np.lexsort((doc[order], context[order], name[order]))
    order, told = order[sort], told[sort]
    name, context, tags, doc = name[order], context[order], tags[order], doc[order]
    first = _starts(name, context)
    if not len(first):
        return doc[:0], context[:0]
    again = doc > np.repeat(doc[first], _grouped(first, len(doc)))
    ask = again.astype(np.uint64) * np.uint64(REMOVE)
    name_, tags_, doc_ = name[first], tags[first], doc[first]
    for shift, what in ((0, RIGHT), (16, LEFT)):
        tag = (tags_ >> np.uint32(shift)) & np.uint32(0xFFFF)
        there = np.flatnonzero(tag)
        there = there[np.lexsort((tag[there], name_[there]))]
        hit = there[_several(doc_[there], name_[there], tag[there])]
        ask[first[hit]] |= np.uint64(what)
    ask[first[told[first]]] |= np.uint64(RIGHT | LEFT)
    take = (ask > 0) & (context != 0)
    return doc[take], context[take] | ask[take]


def ranked_strings(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round 3 on a bucket: ids and names of the strings that a smaller id has too."""
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    first = _starts(one, two)
    if not len(first):
        return doc[:0], one[:0]
    size = np.diff(np.concatenate([first, [len(one)]]))
    again = doc > np.repeat(doc[first], size)
    return doc[again], one[again]


def _ranking(packed: DataFrame, kinds: tuple, rank) -> DataFrame:
    """Brings each bucket together, ranks it, and gives ``doc_id`` and the list of its marks."""

    def run(batches):
        for bucket, blobs in _by_bucket(batches):
            if bucket < 0:
                marks, ids = _unpacked(blobs, (np.uint64,))
            else:
                ids, marks = rank(*_unpacked(blobs, kinds))
            for at in range(0, len(ids), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 200_000]), pa.array(marks[at : at + 200_000].view(np.int64))], names=["doc_id", "mark"])

    rows = packed.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "doc_id long, mark long").groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def _buckets(spark: SparkSession) -> int:
    """Two a shuffle partition: a task then writes about as many packed rows as Spark writes shuffle blocks."""
    return 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Names that a task gathers before it packs them.
GATHERED = 500_000


#: Contexts of one name in a gathering beyond which the task settles them itself.
HOT = 32


def _direct(marks: np.ndarray, ids: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Marks that a task has settled: spread by document over the negative buckets, which are only passed on."""
    return _packed(-1 - (mixed(ids.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), [marks, ids])


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], n_buckets: int, settle) -> Iterator[pa.RecordBatch]:
    """Packs columns (the first names the bucket, the last are ids) whenever ``GATHERED`` rows have come together.

    ``settle`` takes the columns and returns those that others must see and (marks, ids) of what is settled here.
    """
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def packed():
        cols, marks, ids = settle(*(np.concatenate(c) for c in zip(*held)))
        if len(cols[0]):
            yield _packed(_bucket_of(cols[0], n_buckets), cols)
        if len(ids):
            yield _direct(marks, ids, n_buckets)

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= GATHERED:
            yield from packed()
            held, n = [], 0
    if n:
        yield from packed()


def settled_contexts(name: np.ndarray, context: np.ndarray, tags: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A task's part of the ranking, so that no name brings more than ``HOT`` rows from a gathering into one task.

    Of equal contexts the smallest document stays, the others are marked here.
    If a name still has more than ``HOT`` contexts, all their strings are to be
    ranked (which needs no other context), and one row with context 0 tells the
    others under this name to have theirs ranked too.
    """
    order = np.lexsort((doc, context, name))
    name, context, tags, doc = name[order], context[order], tags[order], doc[order]
    first = _starts(name, context)
    again = doc > np.repeat(doc[first], _grouped(first, len(doc)))
    marks, ids = [context[again] | np.uint64(REMOVE)], [doc[again]]
    name, context, tags, doc = name[first], context[first], tags[first], doc[first]
    top = _starts(name)
    size = _grouped(top, len(name))
    many = np.repeat(size > HOT, size)
    marks.append(context[many] | np.uint64(RIGHT | LEFT))
    ids.append(doc[many])
    tell = top[size > HOT]
    cols = [np.concatenate([x[~many], y]) for x, y in ((name, name[tell]), (context, np.zeros(len(tell), np.uint64)), (tags, np.zeros(len(tell), np.uint32)), (doc, doc[tell]))]
    return cols, np.concatenate(marks), np.concatenate(ids)


def settled_strings(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of equal strings in a gathering the smallest document goes on, the others are marked here."""
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    first = _starts(one, two)
    again = doc > np.repeat(doc[first], _grouped(first, len(doc)))
    return [one[first], two[first], doc[first]], one[again], doc[again]


def _bucket_of(name: np.ndarray, n: int) -> np.ndarray:
    """Anchors have small names (each is a minimum), so names are mixed once more before they are dealt out."""
    name = mixed(name ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return ((name >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _marks(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).view(np.uint64) if value.is_valid else np.zeros(0, np.uint64)


def _ranked_bounds(h: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the contexts to remove, then of the stretches whose strings are ranked."""
    at, _ = anchors(h)
    lo, hi, c = contexts(h, at)
    marks = np.sort(marks)
    bare = marks & ~_BITS
    k = np.searchsorted(bare, c)
    k[k == len(bare)] = 0
    ask = np.where(bare[k] == c, marks[k] & _BITS, np.uint64(0)) if len(bare) else np.zeros(len(c), np.uint64)
    gone, right, left = ((ask & np.uint64(bit)) > 0 for bit in (REMOVE, RIGHT, LEFT))
    start = np.concatenate([np.maximum(lo, at - HALF)[right], lo[left]])
    end = np.concatenate([hi[right], np.minimum(hi, at - HALF + LENGTH)[left]])
    return lo[gone], hi[gone], start, end


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in some interval."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, end, 1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary: the bytes that stay)."""
    return _finished(docs, id_col, text_col, digest=False)


def _finished(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    n_buckets = _buckets(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def named(batches):
        for batch in steps(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = _bytes_of(text)
                if doc is None or len(b) < LENGTH:
                    continue
                h = sums(b)
                at, name = anchors(h)
                _, _, c = contexts(h, at)
                tags = sides(h, at)
                c, once = np.unique(c, return_index=True)
                yield name[once], c, tags[once], np.full(len(c), doc, np.int64)

    def name_all(batches):
        return _gathered(named(batches), n_buckets, settled_contexts)

    marked = settled(_ranking(rows.mapInArrow(name_all, "bucket int, packed binary"), (np.uint64, np.uint64, np.uint32), ranked_contexts), "contexts")

    def stretches(batches):
        for batch in steps(batches, "text"):
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                h = sums(b := _bytes_of(text))
                _, _, lo, hi = _ranked_bounds(h, _marks(marks))
                at = strings(lo, hi)
                if len(at):
                    yield names(h, at, at + LENGTH), names(sums(b, 1), at, at + LENGTH), np.full(len(at), doc, np.int64)

    def name_strings(batches):
        return _gathered(stretches(batches), n_buckets, settled_strings)

    both = rows.join(marked, "doc_id", "left")
    some = rows.join(marked.where(F.exists("marks", lambda m: m.bitwiseAND(F.lit(RIGHT | LEFT)) != 0)), "doc_id")
    again = settled(_ranking(some.mapInArrow(name_strings, "bucket int, packed binary"), (np.uint64, np.uint64), ranked_strings), "strings")
    joined = both.join(again.withColumnRenamed("marks", "strings"), "doc_id", "left").select("doc_id", "text", "marks", "strings")

    def finish(batches):
        for batch in steps(batches, "text"):
            out = []
            for text, marks, found in zip(*(batch.column(i) for i in (1, 2, 3))):
                b = _bytes_of(text)
                gone = n_spans = 0
                if marks.is_valid and len(b) >= LENGTH:
                    h = sums(b)
                    start, end, lo, hi = _ranked_bounds(h, _marks(marks))
                    if found.is_valid:
                        at = strings(lo, hi)
                        at = at[np.isin(names(h, at, at + LENGTH), _marks(found))]
                        start, end = np.concatenate([start, at]), np.concatenate([end, at + LENGTH])
                    hit = covered(len(b), start, end)
                    gone = int(hit.sum())
                    n_spans = int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum())
                    kept = b[~hit].tobytes()
                else:
                    kept = b.tobytes()
                out.append((len(b), gone, n_spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(table(spark, sf_dir, "documents"), "doc_id", "text", digest=True)


#: DuckDB SQL for ``op7``: every 50-byte string with the smallest document it starts in; runs of removed bytes from gaps between starts.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::bigint AS n FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS g FROM d, LATERAL (SELECT unnest(range(1, n - 48)) AS i) WHERE n >= 50),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
hit AS (SELECT doc_id, i FROM p JOIN f USING (g) WHERE first < doc_id),
run AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS b
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit))
  GROUP BY doc_id, k),
piece AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
k AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a + 1)::bigint AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

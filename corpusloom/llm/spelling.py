"""Spelling variants: words one edit apart, found by rolling hashes of deletions.

Words are counted in Arrow batches, each task keeping a bounded table of counts
that it passes on when full.  The vocabulary's words give integer keys: with the
polynomial hash of a word's first i code points and that of those after the next,
the hash of the word without code point i takes a few NumPy operations for all
positions of all words of a batch, and no string is built.

Two words differ by a replacement at i when what is left without i is equal, and
by an insertion when one without a code point (the first of equal neighbours) is
the other.  So a key is either (rest, i) or (rest), rows are dealt by the leading
bits of the key and sorted by it, and only keys that two rows share go on: these
few get their strings by the words' ids, and are compared as strings, so that a
collision of hashes or ids joins nothing and parts nothing.  A group gives each
of its words a count and its best neighbour, never pairs: at most one row a key
and word.

Forms point to words of at least ``ratio`` times the count, so chains are short
(``ratio`` 5: 17 steps for a count of 1e12), and doubling follows them in a
logarithm of that many joins.

Defined results: null and empty texts have no words; a null id is written as
nothing before the colon; very long texts are read in pieces that end between
runs, very long words get keys that grow with their length, not its square;
repeated rows count again; a word whose near words all have smaller counts than
asked has no form and is its own root; ties go to the smaller word in code-point
order; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes_of, inverses, mixed, powers, removed, steps, table, written

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO, DAMAGED = 6, 5, 5, 199
#: Characters of a text read at once, and words in a task's table of counts.
PIECE, HELD = 1 << 20, 200_000
#: Bytes of words whose keys are made at once, and the bits of a key that deal it out.
STEP, RADIX_BITS = 1 << 18, 16
#: The kinds of keys, mixed into them: what is left of a word, and what is left with the place.
LEFT, PLACED = 0, 1


def damaged(run: str, crc: int) -> str:
    """The run without one code point, where ``DAMAGED`` divides its hash."""
    if crc % DAMAGED:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str, piece: int = PIECE) -> Iterator[list[str]]:
    """The runs of letters of a text, A-Z in lower case, in pieces."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z change
    at = 0
    while at < len(low):
        end = min(at + piece, len(low))
        if over := RUN.match(low, end - 1):
            end = over.end()
        yield RUN.findall(low, at, end)
        at = end


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change: Callable[[str, int], str] | None = None) -> DataFrame:
    """``word, n``: runs of at least ``min_length`` code points that occur ``min_count`` times.  ``change`` gets a run and the CRC-32 of ``id:run``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in steps(batches, "t"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                begin = zlib.crc32(f"{doc or ''}:".encode())
                for found in runs_of(text or ""):
                    for word, n in Counter(found).items():
                        if len(word) >= min_length:
                            if change:
                                word = change(word, zlib.crc32(word.encode(), begin))
                                if len(word) < min_length:
                                    continue
                            held[word] += n
                    if len(held) >= HELD:
                        yield passed()
        if held:
            yield passed()

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, kinds, places (-1: nothing is deleted) and ids of all rows of ``words``, from prefix and suffix hashes."""
    length = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(length)])
    codes = codes_of("".join(words))
    of = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes)) - first[of]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place])])
        whole = sums[first[1:]] - sums[first[:-1]]
        prefix = sums[:-1] - sums[first[of]]
        suffix = sums[first[of + 1]] - sums[1:]
        rest = prefix + suffix * inverses(2)[1]  # as if what follows the gap stood one place earlier
        again = np.concatenate([[False], codes[1:] == codes[:-1]]) & (place > 0)  # gives the same rest as the place before
        placed = mixed(rest ^ mixed(place.astype(np.uint64) + np.uint64(2)))
        keys = np.concatenate([mixed(whole), mixed(rest[~again]), placed])
    kinds = np.concatenate([np.full(len(keys) - len(codes), LEFT), np.full(len(codes), PLACED)])
    return keys.view(np.int64), kinds, np.concatenate([np.full(len(words), -1), place[~again], place]), np.concatenate([ids, ids[of[~again]], ids[of]])


def keyed(vocabulary: DataFrame) -> DataFrame:
    """``key, kind, place, id``: what a word (``word, id``) is found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "word", STEP):
            key, kind, place, ids = deletion_keys(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind, pa.int8()), pa.array(place, pa.int32()), pa.array(ids)], names=["key", "kind", "place", "id"])

    return vocabulary.select("word", "id").mapInArrow(run, "key long, kind byte, place int, id long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows partitioned by the leading bits of their keys, and sorted by key."""
    return rows.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "kind", "place")


def shared(keys: DataFrame) -> DataFrame:
    """The rows whose key another row has: with a word as it is among them, or with one place."""

    def chosen(b: pa.RecordBatch) -> pa.RecordBatch:
        key, kind, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        useful = np.logical_or.reduceat((kind == PLACED) | (place < 0), start) & (size > 1)
        return b.filter(pa.array(np.repeat(useful, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # rows of the last key, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(key, key[-1]))
            if last or (open_ and open_[-1].column(0)[-1].as_py() != key[0]):
                yield chosen(_joined([*open_, b.slice(0, last)]))
                open_ = []
            open_.append(b.slice(last))
        if open_:
            yield chosen(_joined(open_))

    return _dealt(keys).mapInArrow(run, keys.schema)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


Found = tuple[str, int, int, str]


def neighbours(members: list[tuple[int, int, str, int]]) -> Iterator[Found]:
    """``(word, near words, the best one's count, the best one)`` for rows ``(kind, place, word, n)`` of a key, compared as strings."""
    groups: dict[tuple, dict[str, tuple[int, bool]]] = {}
    for kind, place, word, n in members:
        if place >= len(word):
            continue  # another word under the same id
        rest = word if place < 0 else word[:place] + word[place + 1 :]
        groups.setdefault((kind, place if kind == PLACED else 0, rest), {})[word] = (n, place < 0)
    for (kind, _, rest), words in groups.items():
        if len(words) < 2:
            continue
        if kind == PLACED:
            best, second = sorted((-n, w) for w, (n, _) in words.items())[:2]
            for w in words:
                n, b = second if w == best[1] else best
                yield w, len(words) - 1, -n, b
        elif rest in words and words[rest][1]:
            n = words.pop(rest)[0]
            most, best = min((-m, w) for w, (m, _) in words.items())
            yield rest, len(words), -most, best
            for w in words:
                yield w, 1, n, rest


def near(vocabulary: DataFrame) -> DataFrame:
    """``word, n_near, best`` (``less``: the negative count, and ``word``) for the words (``word, n, id``) that have a near word."""
    rows = shared(keyed(vocabulary)).join(vocabulary, "id").select("key", "kind", "place", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, at = [], None

        def packed(found: list[Found]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

        for b in batches:
            found: list[Found] = []
            for key, *member in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != at:
                    found += neighbours(members)
                    members, at = [], key
                members.append(member)
            if found:
                yield packed(found)
        if found := list(neighbours(members)):
            yield packed(found)

    told = _dealt(rows).mapInArrow(run, "word string, near long, best_n long, best string")
    return told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: chains followed to their ends, each round twice as far."""
    spark = forms.sparkSession
    hops, folder = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        going = hops.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        farther, next_ = written(going, "spelling-roots")
        moved = not farther.where("moved").isEmpty()
        removed(spark, folder)
        hops, folder = farther.drop("moved"), next_
        if not moved:
            return hops


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for counted words (``word, n``)."""
    vocabulary, _ = written(words.select("word", "n", F.xxhash64("word").alias("id")), "spelling-words")
    best = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    found, _ = written(vocabulary.drop("id").join(near(vocabulary), "word", "left").withColumn("best", best), "spelling-near")
    ends = roots(found.where("best IS NOT NULL").select("word", F.col("best.word").alias("form")))
    out = found.join(ends, "word", "left")
    return out.select("word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counts(table(spark, sf_dir, "documents"), change=damaged))


#: DuckDB SQL for ``op12``: the CRC byte by byte through a table made by its rule, then deletions as strings.
OP12_SQL = r"""
WITH RECURSIVE
bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT i, c AS x FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
named AS (SELECT row_number() OVER () AS r, run, m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM runs),
stepped AS (
  SELECT r, 0 AS k, 4294967295::BIGINT AS c FROM named
  UNION ALL SELECT s.r, s.k + 1, xor(t.x, s.c >> 8) FROM stepped s JOIN named d ON d.r = s.r AND 2 * s.k < length(d.b) JOIN crc t ON t.i = xor(s.c & 255, CAST('0x' || substr(d.b, 2 * s.k + 1, 2) AS BIGINT))),
hashed AS (SELECT r, xor(arg_max(c, k), 4294967295) AS h FROM stepped GROUP BY r),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, m FROM named JOIN hashed USING (r)),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, e.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) e USING (word)
"""

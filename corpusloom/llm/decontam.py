"""Benchmark decontamination with a generalised suffix automaton.

The items' word sequences go into one automaton (Blumer's online construction,
restarted at the root for each item).  A document's words stream through it; at
each word the state gives the longest suffix that is in some item.  Where that
length reaches ``window``, the last ``window`` words are an item's window and are
hit; items of fewer words are one window each and are found through marked
states on the suffix links.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only.

The automaton is kept in flat sorted arrays of numbers (about 80 bytes a word of
an item), and so is a filter of hashed word grams: a stretch of a document without
``gram`` words of an item at every ``stride``-th word can't hold a window and isn't streamed.

The items are read to the driver in blocks of at most ``BLOCK_WORDS`` words; each
block has an automaton of its own (at most two states a word) that is broadcast,
and a task holds one of them at a time, so a larger benchmark takes more passes
over a task's rows, not more memory.

Defined results: items without an id hit words and count as one, without a name in
the digest; null texts and items have no words; an item without words is
never found; repeated items count by their own ids; an empty benchmark or
document table gives no hits or no rows; extra columns are ignored by ``scan``
and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import changed, map_texts, mixed, picked, steps, table, texts

WINDOW = 10
#: Bounds an automaton to some 40 MB in a Python worker, and what the driver holds while it builds one.
BLOCK_WORDS = 500_000
#: ``clean`` drops a document when more than this share of its words is hit.
MAX_COVERAGE = 0.5
#: By byte of UTF-8: A-Z lower-cased, what is in no word a space.  Bytes from 0x80 belong to characters of words.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^\x20]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_BYTES).split()


class _Growing:
    """The automaton while it is built: a dictionary of transitions a state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        cur = self._new(length[last] + 1, {})
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _new(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        c = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c


def _lists(rows: dict[int, list], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists by state as sorted states, where each one's entries begin, and all entries."""
    keys = sorted(rows)
    at = np.cumsum([0, *(len(rows[k]) for k in keys)])
    return np.array(keys, np.int32), at.astype(np.int64), np.array([x for k in keys for x in rows[k]], kind)


class Automaton:
    """A suffix automaton of several word sequences in flat arrays, with the items of each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.names: list[object] = []
        #: numbers of the items' words, from 1; all other words are 0
        self.words: dict[bytes, int] = {}
        growing, sequences = _Growing(), []
        for name, words in items:
            if not words:
                continue
            self.names.append(name)
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            sequences.append(np.array(ids, np.int32))
            last = 0
            for w in ids:
                last = growing.extend(last, w)
        edges = sum(map(len, growing.next))
        key = np.fromiter((s << 32 | w for s, d in enumerate(growing.next) for w in d), np.int64, edges)
        to = np.fromiter((t for d in growing.next for t in d.values()), np.int32, edges)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        self.link, self.length = np.array(growing.link, np.int32), np.array(growing.length, np.int32)
        del growing, key, to, order
        step, link, length = self._stepper(), self.link.tolist(), self.length.tolist()
        whole: dict[int, list[int]] = {}
        short: dict[int, list[int]] = {}
        for k, ids in enumerate(sequences):
            state = size = 0
            for w in ids.tolist():
                state, size = step(state, w), size + 1
                if size >= window:
                    while length[link[state]] >= window:
                        state = link[state]
                    size = min(size, length[state])
                    found = whole.setdefault(state, [])
                    if not found or found[-1] != k:
                        found.append(k)
            if len(ids) < window:
                short.setdefault(state, []).append(k)
        #: by state: items whose window of ``window`` words ends there; shorter items that end there
        self.items, self.short = _lists(whole, np.int32), _lists(short, np.int32)
        self.sizes = np.array([len(x) for x in sequences], np.int32)
        #: by state: the nearest state up its suffix links, itself included, where a shorter item ends
        self.above = np.zeros(len(self.link) if short else 0, np.int32)
        if short:
            for s in np.argsort(self.length, kind="stable")[1:].tolist():
                self.above[s] = s if s in short else self.above[link[s]]
        # a stretch that holds a window holds, at some multiple of ``stride``, ``gram`` words of an item
        self.least = min([window, *map(len, sequences)])
        self.gram = min(4, self.least)
        self.stride = self.least - self.gram + 1
        self.grams = np.unique(np.concatenate([self._grams(x, np.arange(len(x) - self.gram + 1)) for x in sequences])) if sequences else np.zeros(0, np.uint64)

    def _grams(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``gram`` words at each place."""
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.gram):
                out = mixed(out * np.uint64(0x100000001B3) + ids[at + k].astype(np.uint64))
        return out

    def _stepper(self):
        """The transition of (state, word), -1 where there is none."""
        key, to = memoryview(self.key), memoryview(self.to)
        n = len(key)

        def step(state: int, word: int) -> int:
            x = state << 32 | word
            at = bisect_left(key, x)
            return to[at] if at < n and key[at] == x else -1

        return step

    @staticmethod
    def _entries(lists: tuple[np.ndarray, np.ndarray, np.ndarray], state: int) -> list[int]:
        keys, at, values = lists
        k = int(np.searchsorted(keys, state))
        return values[at[k] : at[k + 1]].tolist() if k < len(keys) and keys[k] == state else []

    def near(self, texts_: list[list[bytes]]) -> list[list[int]]:
        """For each text the multiples of ``stride`` at which ``gram`` words of an item stand."""
        out: list[list[int]] = [[] for _ in texts_]
        sizes = np.array([len(w) for w in texts_], np.int64)
        if not self.names or not sizes.sum():
            return out
        ids = np.fromiter(map(self.words.get, chain.from_iterable(texts_), repeat(0)), np.int32, int(sizes.sum()))
        n = np.maximum(0, (sizes - self.gram) // self.stride + 1)
        owner = np.repeat(np.arange(len(texts_)), n)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * self.stride
        place = at + (np.cumsum(sizes) - sizes)[owner]
        for k in range(self.gram):
            known = ids[place + k] > 0
            owner, at, place = owner[known], at[known], place[known]
        h = self._grams(ids, place)
        k = np.searchsorted(self.grams, h)
        k[k == len(self.grams)] = 0
        hit = self.grams[k] == h
        for i, p in zip(owner[hit].tolist(), at[hit].tolist()):
            out[i].append(p)
        return out

    def match(self, words: list[bytes], near: list[int] | None = None) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word intervals (start, end) in order, merged, and the indices of the items found; ``near`` as the method gives it."""
        spans: list[list[int]] = []
        found: set[int] = set()
        near = self.near([words])[0] if near is None else near
        known = self.words
        done = k = 0
        while k < len(near):
            a = max(done, near[k] + self.gram - self.least, 0)
            b = near[k] + self.least
            while k + 1 < len(near) and near[k + 1] + self.gram - self.least <= b:
                k += 1
                b = near[k] + self.least
            b = min(b, len(words))
            self._stream([known.get(w, 0) for w in words[a:b]], a, spans, found)
            done = b
            k += 1
        return [(a, b) for a, b in spans], found

    def _stream(self, ids: list[int], begin: int, spans: list[list[int]], found: set[int]) -> None:
        """The words from ``begin`` on through the automaton, with the longest matching length at each."""
        step, link, length, window = self._stepper(), memoryview(self.link), memoryview(self.length), self.window
        state = size = 0
        for i, w in enumerate(ids, begin):
            to = step(state, w)
            while to < 0 and state:
                state = link[state]
                size = length[state]
                to = step(state, w)
            if to < 0:
                continue
            state, size = to, size + 1
            if size >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                # a state's strings of ``window`` words end where those of its longest do
                found.update(self._entries(self.items, s))
                self._add(spans, i + 1 - window, i + 1)
            s = int(self.above[state]) if len(self.above) else 0
            while s:
                for k in self._entries(self.short, s):
                    n = int(self.sizes[k])
                    if n <= size:
                        found.add(k)
                        self._add(spans, i + 1 - n, i + 1)
                s = int(self.above[link[s]])

    @staticmethod
    def _add(spans: list[list[int]], a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:
            a = min(a, spans.pop()[0])
        spans.append([a, b])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list:
    """Broadcasts of the items' automata, one a block of ``block_words`` words."""
    sc = benchmark.sparkSession.sparkContext
    out, block, n = [], [], 0

    def close():
        nonlocal block, n
        if block:
            out.append(sc.broadcast(Automaton(block, window)))
        block, n = [], 0

    for row in benchmark.select(id_col, text_col).toLocalIterator():
        words = words_of(row[1] or "")
        if n and n + len(words) > block_words:
            close()
        block.append((row[0], words))
        n += len(words)
    close()
    return out


def _forget(b) -> None:
    """In a worker: one block's automaton in memory at a time.  A broadcast keeps what it has loaded, and only loads again (from the executor's disk) without it."""
    if getattr(b, "_path", None):
        vars(b).pop("_value", None)


def find(values: list[str], given: list) -> list[tuple[int, list[tuple[int, int]], list[object]]]:
    """For each text: its number of words, the hit intervals of words, the ids of the items found."""
    out = [(0, [], []) for _ in values]
    for k, b in enumerate(given or [None]):
        a = b.value if b is not None else None
        split = [words_of(text) for text in values]
        near = a.near(split) if a else [[]] * len(split)
        for i, words in enumerate(split):
            spans, found = a.match(words, near[i]) if near[i] else ([], ())
            names = [a.names[j] for j in found] if a else []
            out[i] = (len(words), merged(out[i][1] + spans) if out[i][1] else spans, out[i][2] + names)
        if len(given) > 1:
            del a
            _forget(b)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, hit words, items found and a digest of their ids, and the share of hit words."""
    given = automata(benchmark, window)

    def make():
        def run(values):
            out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "coverage")}
            for n, spans, found in find(values, given):
                hit = sum(b - a for a, b in spans)
                out["n_words"].append(n)
                out["n_hit"].append(hit)
                items = set(found)
                ids = sorted(str(x) for x in items if x is not None)
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                out["contaminated"].append(hit > 0)
                out["coverage"].append(hit / n if n else 0.0)
            return out

        return run

    return map_texts(docs, id_col, text_col, make, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, coverage double")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    if not spans:
        return text
    raw = text.encode("utf-8")
    places = [m.span() for m in _WORD.finditer(raw.translate(_BYTES))]
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return (b"".join(parts) + raw[at:]).decode("utf-8")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All columns of the documents, hit spans taken out; documents hit beyond ``max_coverage`` are dropped.

    ``length_col``, where there is one, is set to the new length of a text that changed.
    """
    given = automata(benchmark, window)

    def run(batches):
        for batch in steps(batches, text_col):
            values = texts(batch, text_col)
            got = find(values, given)
            new = [without(v, spans) if spans else None for v, (_, spans, _) in zip(values, got)]
            yield picked(changed(batch, text_col, new, length_col), [i for i, (n, spans, _) in enumerate(got) if sum(b - a for a, b in spans) <= max_coverage * n])

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB SQL for ``op4``: windows of ten words (or whole shorter items) joined with the documents' windows.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM items),
hits AS (
  SELECT doc_id, i, x.k, item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)) x
  JOIN items USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE coalesce(n_hit, 0)::DOUBLE / len(w) END AS coverage
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

"""Two-level chunks of documents: parents up to 1024 tokens, children up to 256.

Chunking is sequential within a document, so a document is one unit of work: rows
stream through Arrow batches and no shuffle is needed if pages are nested.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ABBREVIATIONS, MIN_CHUNK_CHARS, PARAGRAPH, SENTENCE_END

PARENT_TOKENS, CHILD_TOKENS, OVERLAP_TOKENS = 1024, 256, 32
CHUNKS = "id string, source_file_id string, passage_index int, level string, parent_id string, text string, language_detected string, page_number int, token_count int"

# Where a text may break, and what a break that closes no sentence follows.
_BREAKS = re.compile(f"{PARAGRAPH}|{SENTENCE_END}")
_OPEN = re.compile(r"\b(?:" + "|".join((*ABBREVIATIONS, "[A-Z]")) + r")\n?\.*$")


def tokens(text: str) -> int:
    return len(text.split()) * 4 // 3


def sentences(text: str) -> list[str]:
    """As ``functions.text.sentences``."""
    closed: list[str] = []
    begun: list[str] = []
    for piece in filter(None, map(str.strip, _BREAKS.split(text))):
        begun.append(piece)
        if not _OPEN.search(piece):
            closed.append(" ".join(begun))
            begun = []
    return closed + [" ".join(begun)] if begun else closed


def packed(items: Iterable[tuple[object, str]], limit: int, keep) -> Iterator[list[tuple[object, str]]]:
    """Runs of (mark, sentence) of at most ``limit`` tokens; ``keep(run)`` says what the next run repeats, or None to go on with the run."""
    run: list[tuple[object, str]] = []
    used = 0
    for mark, s in items:
        n = tokens(s)
        if run and used + n > limit:
            yield run
            rest = keep(run)
            if rest is not None:
                run, used = rest, sum(tokens(x) for _, x in rest)
        run = [*run, (mark, s)]
        used += n
    if run:
        yield run


def _long_enough(run: list[tuple[object, str]]) -> bool:
    return len(" ".join(s for _, s in run)) >= MIN_CHUNK_CHARS


def _overlap(run: list[tuple[object, str]]) -> list[tuple[object, str]] | None:
    """Last sentences of at most ``OVERLAP_TOKENS`` together; a run that is too short to be a chunk goes on instead."""
    if not _long_enough(run):
        return None
    n = used = 0
    for _, s in reversed(run):
        if used + tokens(s) > OVERLAP_TOKENS:
            break
        used += tokens(s)
        n += 1
    return run[len(run) - n :]


def _id(*parts: object) -> str:
    return hashlib.sha256("\x01".join(map(str, parts)).encode()).hexdigest()[:32]


def chunks_of(pages: Iterable[tuple[int, str]], source: str, lang: str) -> list[tuple]:
    """A document's chunks, each parent before its children.  Ids are hashes of (source, level, index), so that a rerun gives the same."""
    marked = [(page, s) for page, text in pages if text and text.strip() for s in sentences(text)]
    out: list[tuple] = []
    for index, run in enumerate(packed(marked, PARENT_TOKENS, _overlap)):
        if not _long_enough(run):
            continue
        text, page = " ".join(s for _, s in run), run[0][0]
        parent = _id(source, "parent", index)
        out.append((parent, source, index, "parent", None, text, lang, page, tokens(text)))
        child = 0
        for part in packed(((None, s) for s in sentences(text)), CHILD_TOKENS, lambda r: r[-1:]):
            if _long_enough(part):
                body = " ".join(s for _, s in part)
                at = index * 1000 + child
                out.append((_id(source, "child", at), source, at, "child", parent, body, lang, page, tokens(body)))
                child += 1
    return out


def _indexed(rows: list[tuple]) -> list[tuple]:
    """As ``indexed_chunks``, of one document."""
    return [c for c in rows if c[3] == "child"] or rows


def chunk(documents: DataFrame, indexed: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """``source_file_id``, ``pages`` (array of ``page, text``), ``lang`` → chunks.

    ``indexed`` leaves the children only (all chunks of a document that has none), where a row is a whole
    document; ``carried`` names text columns of the document that its chunks get: both without a shuffle.
    """
    full = ", ".join([CHUNKS, *(f"{c} string" for c in carried)])
    names = [f.split()[0] for f in full.split(", ")]
    kinds = [pa.int32() if f.endswith(" int") else pa.string() for f in full.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for s, p, lang, *more in zip(*(part.column(i).to_pylist() for i in range(3 + len(carried)))):
                    found = chunks_of([(x["page"], x["text"]) for x in p or ()], s, lang)
                    rows += [(*c, *more) for c in (_indexed(found) if indexed else found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    return documents.select("source_file_id", "pages", "lang", *carried).mapInArrow(run, full)


def indexed_chunks(chunks: DataFrame) -> DataFrame:
    """The children, or all chunks of a document that has none."""
    has = F.max(F.col("level") == "child").over(Window.partitionBy("source_file_id"))
    return chunks.withColumn("__has", has).where(~F.col("__has") | (F.col("level") == "child")).drop("__has")

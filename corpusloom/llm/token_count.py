"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text; at each
end position the dynamic programme keeps the best score and the number of tokens
on the best path, nothing else.  Tie rule, as in unigram tokenizers that relax
forward over start positions: a path replaces another only if it scores more, so
of equal paths the one whose last piece starts first stays.  A character that no
single-character piece covers may be an unknown of score ``min - 10``; it counts
its UTF-8 bytes if the vocabulary has byte pieces, else a run of unknowns counts
one.  White space: a space is ``▁`` and a text that isn't empty starts with one.

No piece has ``▁`` after another character in the vocabularies at hand, and their
scores are whole numbers, whose sums are exact; then a best path is one best path
for each stretch from ``▁`` to the next, and counts of short stretches are kept
in a bounded table.  For other vocabularies the text is one stretch.

Defined results: null and empty texts have 0 tokens; repeated rows count alike;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Stretches whose counts a task keeps at most, and the longest that it keeps.
KEPT, KEPT_CHARS = 400_000, 40
_STRETCH = re.compile("▁+[^▁]*")
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


@dataclass
class Vocabulary:
    """Pieces and their scores; ``bytes`` whether unknown characters fall back to byte pieces."""

    scores: dict[str, float]
    least: float
    bytes: bool
    _machine: object = field(default=None, repr=False, compare=False)
    _kept: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.stretches = "▁" in self.scores and all(float(s).is_integer() for s in self.scores.values()) and not any("▁" in p.lstrip("▁") for p in self.scores)

    def __getstate__(self):
        return self.scores, self.least, self.bytes

    def __setstate__(self, state):
        self.scores, self.least, self.bytes = state
        self._machine, self._kept = None, {}
        self.__post_init__()

    def machine(self):
        if self._machine is None:
            a = ahocorasick.Automaton()
            for p, s in self.scores.items():
                a.add_word(p, (len(p), s))
            a.make_automaton()
            self._machine = a
        return self._machine

    def best(self, line: str) -> int:
        """Tokens on the best path over ``line``."""
        n = len(line)
        if not n:
            return 0
        low = self.least - UNKNOWN_PENALTY
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        unknown = bytearray(n + 1)
        score[0] = 0.0
        done = 0  # ends up to here are settled

        def settle(end: int, single: bool) -> None:
            """The unknown character as the last candidate of an end."""
            if single:
                return
            s = score[end - 1] + low
            if score[end] is None or s > score[end]:
                score[end] = s
                unknown[end] = 1
                if self.bytes:
                    count[end] = count[end - 1] + len(line[end - 1].encode("utf-8"))
                else:
                    count[end] = count[end - 1] + (not unknown[end - 1])

        single = False
        for last, (size, piece) in self.machine().iter(line):
            end = last + 1
            while done + 1 < end:
                done += 1
                settle(done, single)
                single = False
            at = end - size
            s = score[at] + piece
            # longer pieces come first, so an equal path that starts later doesn't replace
            if score[end] is None or s > score[end]:
                score[end] = s
                count[end] = count[at] + 1
                unknown[end] = 0
            if size == 1:
                single = True
        while done < n:
            done += 1
            settle(done, single)
            single = False
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        line = "▁" + text.replace(" ", "▁")
        if not self.stretches:
            return self.best(line)
        kept, total = self._kept, 0
        for part in _STRETCH.findall(line):
            n = kept.get(part)
            if n is None:
                n = self.best(part)
                if len(part) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[part] = n
            total += n
        return total


def load(path: str = VOCABULARY) -> Vocabulary:
    """The pieces of a SentencePiece file.  Control, unknown and byte pieces match no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    scores = {m.id_to_piece(i): float(m.get_score(i)) for i in plain}
    return Vocabulary(scores, min(scores.values()), any(m.is_byte(i) for i in range(m.get_piece_size())))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``n_tokens`` and ``n_chars``."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a tokenizer's vocabulary: tens of thousands of pieces, whatever the corpus

    def make():
        v = given.value
        return lambda values: {"n_tokens": [v.count(t) for t in values], "n_chars": [len(t) for t in values]}

    return map_texts(docs, id_col, text_col, make, "n_tokens long, n_chars long")


def op8_token_count(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary``: the file of pieces, else what the session names in ``spark.corpusloom.vocabulary``, else ``VOCABULARY``.  Only the driver reads it."""
    path = vocabulary or spark.conf.get("spark.corpusloom.vocabulary", VOCABULARY)
    return count_tokens(table(spark, sf_dir, "documents"), load(path))

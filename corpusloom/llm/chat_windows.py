"""Chat formatting: turn-aligned windows under a token budget, with loss masks.

A conversation's turns, in the order of (turn, role, text), are counted in
tokens (``TOKEN`` matches, at least 1 a turn).  Prefix sums of these counts cut
the conversation into windows: a window takes new turns while its system turn,
its history and its new turns stay within ``budget``; a turn that is longer than
the budget has a window of its own, whole.  Each window after the first repeats
the system turn and the last turns before it that fit ``history`` tokens, as far
as the first new turn leaves room: the oldest history goes first, the system turn
last.  A system turn may stand anywhere; the latest one leads the windows after it,
in place of any before.  The repeated assistant turns carry no loss, so each assistant text is under
the loss mask once, in order.

Window bounds and history come from prefix sums of the turns' tokens: a span of
turns is the difference of two sums, and the oldest turn that a history of so
many tokens may begin with is found by bisection.

Template: ``<s>[INST] text [/INST]`` for a user, `` text</s>`` for an assistant,
``<<SYS>>text<</SYS>>`` for a system turn and ``<<ROLE name>>text<</ROLE>>`` for
any other role.  In texts and names ``\\``, ``<`` and ``[`` (in names ``>`` too) are preceded by
``\\``, so no text can open a control string and ``unescape`` gives the text back.

Defined results: a null text or role is empty; a null turn sorts first; repeated
rows are turns of their own; null conversation ids form one conversation; an
empty table gives no rows; extra columns are ignored.  Rows are sorted by
(conversation, turn) and streamed, so that memory holds one window and its
history, whatever a conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUDGET = 512
HISTORY = 128
TOKEN = re.compile(r"\w+|[^\w\s]")
_CONTROL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def rendered(role: str, text: str) -> tuple[str, str, str]:
    """What opens the turn, its escaped text, what closes it."""
    if role == "user":
        return "<s>[INST] ", escape(text), " [/INST]"
    if role == "assistant":
        return " ", escape(text), "</s>"
    if role == "system":
        return "<<SYS>>", escape(text), "<</SYS>>"
    name = escape(role).replace(">", "\\>")
    return f"<<ROLE {name}>>", escape(text), "<</ROLE>>"


_BODY = r"((?:[^\\<\[]+|\\.)*)"
_NAME = r"((?:[^\\<\[>]+|\\.)*)"
_PARTS = re.compile(rf"(<s>\[INST\] ){_BODY} \[/INST\]|(<<SYS>>){_BODY}<</SYS>>|<<ROLE {_NAME}>>{_BODY}<</ROLE>>|( ){_BODY}</s>", re.S)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window: the inverse of the template."""
    out, at = [], 0
    while at < len(formatted):
        m = _PARTS.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1]:
            out.append(("user", unescape(m[2])))
        elif m[3]:
            out.append(("system", unescape(m[4])))
        elif m[7]:
            out.append(("assistant", unescape(m[8])))
        else:
            out.append((unescape(m[5]), unescape(m[6])))
        at = m.end()
    return out


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Window:
    """A formatted window; ``loss`` holds (start, end) in ``text``, ``fresh`` the index of its first new turn."""

    text: str
    loss: list[tuple[int, int]]
    fresh: int
    tokens: int
    turns: int


@dataclass
class Packer:
    """Takes a conversation's turns one by one and gives windows as they fill."""

    budget: int = BUDGET
    history: int = HISTORY
    system: Turn | None = None
    #: the turns that the open window may repeat, then its new ones from ``fresh`` on; ``sums[k]``: tokens of the turns before the k-th
    turns: list[Turn] = field(default_factory=list)
    sums: list[int] = field(default_factory=lambda: [0])
    fresh: int = 0
    #: where the open window begins in ``turns``, and whether the system turn leads it
    begin: int = 0
    led: bool = False

    def add(self, role: str, text: str) -> Window | None:
        turn = Turn(role, text, max(1, sum(1 for _ in TOKEN.finditer(text))))
        out = self.close() if self.fresh < len(self.turns) and self.used() + turn.tokens > self.budget else None
        if self.fresh == len(self.turns):
            self.open(turn.tokens)
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        return out

    def used(self) -> int:
        return self.sums[-1] - self.sums[self.begin] + (self.system.tokens if self.led else 0)

    def open(self, tokens: int) -> None:
        """Choose what the window that begins with a turn of ``tokens`` repeats: the system turn, and the longest run of last turns that leaves room."""
        room = self.budget - tokens
        self.led = self.system is not None and self.system.tokens <= room
        room -= self.system.tokens if self.led else 0
        self.begin = bisect_left(self.sums, self.sums[-1] - max(0, room))

    def close(self) -> Window | None:
        """The window of the turns so far; the last of them stay as history."""
        if self.fresh == len(self.turns):
            return None
        repeated = ([self.system] if self.led else []) + self.turns[self.begin : self.fresh]
        new = self.turns[self.fresh :]
        text, loss = [], []
        at = 0
        for i, turn in enumerate(repeated + new):
            opening, body, closing = rendered(turn.role, turn.text)
            text += [opening, body, closing]
            if turn.role == "assistant" and i >= len(repeated):
                loss.append((at + len(opening), at + len(opening) + len(body)))
            at += len(opening) + len(body) + len(closing)
        out = Window("".join(text), loss, len(repeated), self.used(), len(repeated) + len(new))
        latest = next((turn for turn in reversed(new) if turn.role == "system"), None)
        if latest:
            # it leads the windows to come; as history it would stand there twice
            self.system = latest
            self.turns = [turn for turn in self.turns if turn.role != "system"]
            self.sums = [0]
            for turn in self.turns:
                self.sums.append(self.sums[-1] + turn.tokens)
        keep = bisect_left(self.sums, self.sums[-1] - self.history)
        self.turns, first = self.turns[keep:], self.sums[keep]
        self.sums = [x - first for x in self.sums[keep:]]
        self.fresh = len(self.turns)
        return out


def _sorted(turns: DataFrame) -> DataFrame:
    """A conversation's rows together and in order; one conversation's rows stream through one task."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())


WINDOWS = "conv_id long, window int, text string, loss array<array<int>>, fresh int, n_tokens int, n_turns int"


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: the formatted text, the loss spans in it, the index of the first new turn."""
    schema = turns.sparkSession.createDataFrame([], WINDOWS).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        rows, size = [], 0
        conv, packer, n = None, None, 0

        def emit(w):
            nonlocal n
            if w:
                rows.append((conv, n, w.text, [list(x) for x in w.loss], w.fresh, w.tokens, w.turns))
                n += 1
                return len(w.text)
            return 0

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return got

        for key, role, text in _conversations(batches):
            if packer is None or key != conv:
                size += emit(packer.close()) if packer else 0
                conv, packer, n = key, Packer(budget, history), 0
            size += emit(packer.add(role, text))
            if size > 2_000_000:
                yield flush()
                size = 0
        if packer:
            emit(packer.close())
        if rows:
            yield flush()

    return _sorted(turns).mapInArrow(run, schema)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a conversation, read back from its formatted windows: digests of all turns and of the text under the loss mask."""

    def run(batches):
        rows = []
        conv, packer, state = None, None, None

        def read(w):
            if w:
                for role, text in parsed(w.text)[w.fresh :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in w.loss:
                    text = unescape(w.text[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(w.text)
                state[5] += 1

        def done():
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for key, role, text in _conversations(batches):
            if packer is None or key != conv:
                if packer:
                    read(packer.close())
                    done()
                conv, packer, state = key, Packer(budget, history), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            read(packer.add(role, text))
            if len(rows) >= 5000:
                yield _batch(rows)
                rows = []
        if packer:
            read(packer.close())
            done()
        if rows:
            yield _batch(rows)

    return _sorted(turns).mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts are made of control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(given.unionByName(tricky))

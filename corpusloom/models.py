"""Calls of remote models as operators: batched, retried, in order, with fallbacks.

A ``Call`` is what speaks to a service: any picklable function of a model's name and
its input.  Errors are tried again after a growing wait, but for ``Refused``, which a
later try can't mend.  Rows stream through Arrow
batches, so a task holds a batch of prompts, and how many calls run at a time
follows from the number of tasks; ``Policy.spacing`` keeps a task under a rate.
Outcomes are columns, so a call that never succeeds is a row, not a failed job.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_BATCH = 128

Call = Callable[[str, object], object]


class Refused(Exception):
    """The service won't take this input, now or later."""


@dataclass(frozen=True)
class Policy:
    """How often a call is tried and how long it waits: ``base`` seconds, doubled each time, and up to ``jitter`` more; ``spacing`` seconds between calls."""

    tries: int = 4
    base: float = 15.0
    jitter: float = 0.0
    spacing: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def wait(self, attempt: int) -> float:
        return self.base * 2**attempt + (random.random() * self.jitter if self.jitter else 0.0)


# What the services behind the operators are asked with.
EMBEDDING = Policy(tries=6, base=1.0, jitter=1.0)
EXTRACTION = Policy(tries=4, base=15.0)
TAGGING = Policy(tries=5, base=5.0, spacing=5.0)
ANSWERING = Policy(tries=1)


def tried(call: Call, model: str, given: object, policy: Policy) -> tuple[object | None, int]:
    """What the model gave (None: nothing) and the number of calls."""
    for attempt in range(policy.tries):
        if policy.spacing:
            policy.sleep(policy.spacing)
        try:
            return call(model, given), attempt + 1
        except Refused:
            return None, attempt + 1
        except Exception:  # noqa: BLE001 - a service can fail in any way; the row says so
            if attempt + 1 < policy.tries:
                policy.sleep(policy.wait(attempt))
    return None, policy.tries


def chain(first: str, *others: str) -> list[str]:
    """Models in the order they are asked, each once."""
    return list(dict.fromkeys((first, *others)))


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def embedded(rows: DataFrame, text: str, call: Call, model: str, batch: int = EMBED_BATCH, policy: Policy = EMBEDDING, vector: str = "vector") -> DataFrame:
    """Adds ``vector``.  ``call(model, texts)`` gives (index, vector) pairs of a batch in any order; the index puts them back.

    A batch that never succeeds ends the job, as rows without vectors would be missing from every search.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = rows.limit(0).withColumn(vector, F.lit(None).cast("array<float>")).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for part in _batches(batches, batch):
            got, _ = tried(call, model, [x or "" for x in part.column(text).to_pylist()], policy)
            if got is None or sorted(i for i, _ in got) != list(range(part.num_rows)):
                raise RuntimeError(f"{model} gave no vectors for a batch of {part.num_rows} texts")
            vectors = [v for _, v in sorted(got, key=lambda x: x[0])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], schema=arrow)

    return rows.mapInArrow(run, out)


def answered(rows: DataFrame, prompt: str, call: Call, models: list[str], policy: Policy = EXTRACTION, raw: str = "raw") -> DataFrame:
    """Adds ``raw`` (the first answer of the chain of models, null if none gives one), ``model`` (whose it is) and ``n_calls``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = rows.limit(0).withColumns({raw: F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "n_calls": F.lit(0)}).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for part in _batches(batches, 64):
            got = []
            for given in part.column(prompt).to_pylist():
                answer, whose, calls = None, None, 0
                for model in models:
                    answer, n = tried(call, model, given, policy)
                    calls += n
                    if answer is not None:
                        whose = model
                        break
                got.append((answer, whose, calls))
            cols = [pa.array(c, type=arrow.field(f).type) for c, f in zip(zip(*got), (raw, "model", "n_calls"))] if got else []
            if got:
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], schema=arrow)

    return rows.mapInArrow(run, out)


#: What a model is asked to make of several models' answers: their number, the question, the answers.
SYNTHESIS_PROMPT = (
    "%d models have answered this question, each on its own:\n%s\n\nTheir answers:\n\n%s\n\nWrite one answer out of these. Say plainly what they all say; where one contradicts another, give both views and name the models. "
    "Keep every [Source N] mark beside the statement that it supports, and add nothing that no answer has."
)
# Fixed value: how an answer begins that no model has written.
NO_ANSWER = "All models failed or timed out. Top retrieved passage:\n\n"


def ensemble(questions: DataFrame, call: Call, models: list[str], synthesis: list[str], policy: Policy = ANSWERING, key: str = "query_id", short: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key``, ``question``, ``prompt``, ``best`` (the best passage) → ``answer`` and ``n_answers``.

    Each question is asked of each model, one row a pair, so that the calls of one
    question run side by side.  No answer: the best passage; one: that one; several:
    the first of ``synthesis`` that merges them, or all of them one after another.
    ``short`` shortens a model's name where answers are shown.
    """
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(m).alias("asked")) for i, m in enumerate(models)))).alias("m")
    shown = short(F.col("m.asked")) if short else F.col("m.asked")
    pairs = questions.select(key, "prompt", names).select(key, "prompt", "m.no", "m.asked", shown.alias("shown")).repartition(key, "no")
    each = _asked(pairs, call, policy).where("raw <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "shown", "raw"))).alias("given"))
    rows = questions.select(key, "question", "best").join(each, key, "left")
    kind = questions.schema[key].dataType.simpleString()

    def run(batches):
        for part in _batches(batches, 64):
            out, counts = [], []
            for question, best, given in zip(*(part.column(c).to_pylist() for c in ("question", "best", "given"))):
                counts.append(len(given or ()))
                out.append(_merged(question, best, [(g["shown"], g["raw"]) for g in given or ()], call, synthesis, policy))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[key, "answer", "n_answers"])

    return rows.mapInArrow(run, f"{key} {kind}, answer string, n_answers int")


def _merged(question: str, best: str | None, given: list[tuple[str, str]], call: Call, synthesis: list[str], policy: Policy) -> str:
    if not given:
        return NO_ANSWER + (best or "(none)")
    if len(given) == 1:
        return given[0][1]
    asked = SYNTHESIS_PROMPT % (len(given), question, "\n\n".join(f"[{name}]:\n{text}" for name, text in given))
    for model in synthesis:
        if merged := tried(call, model, asked, policy)[0]:
            return merged
    return "\n\n---\n\n".join(f"**{name}:**\n{text}" for name, text in given)


def _asked(pairs: DataFrame, call: Call, policy: Policy) -> DataFrame:
    """Adds ``raw``: the answer of each row's own model."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = pairs.limit(0).withColumn("raw", F.lit(None).cast("string")).schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for part in _batches(batches, 64):
            got = [tried(call, m, p, policy)[0] for m, p in zip(part.column("asked").to_pylist(), part.column("prompt").to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], schema=arrow)

    return pairs.mapInArrow(run, out)

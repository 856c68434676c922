"""Model calls with stand-ins for the services: what they answer, and how often they fail first, follows from the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import models as M
from corpusloom.functions.text import short_model

from .registry import query


def _no_wait(seconds: float) -> None:
    pass


class Embedder:
    """Busy at each batch's first call; then lengths and numbers of spaces, in the wrong order."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, model, texts):
        if hash(tuple(texts)) not in self.seen:
            self.seen.add(hash(tuple(texts)))
            raise ConnectionError("429")
        return [(i, [float(len(t)), float(t.count(" "))]) for i, t in reversed(list(enumerate(texts)))]


class Extractor:
    """``a`` is busy for every third, refuses the next and answers the rest at the second call; ``b`` answers even numbers; ``c`` all but every fifth."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def __call__(self, model, prompt):
        n = int(prompt)
        if model == "a" and n % 3 == 1 or model == "b" and n % 2 or model == "c" and n % 5 == 0:
            raise M.Refused
        if model == "a" and (n % 3 == 0 or prompt not in self.seen):
            self.seen.add(prompt)
            raise ConnectionError("503")
        return f"{model}:{prompt}"


def speaker(model, prompt):
    """``one`` answers even numbers, ``two`` every third, ``three`` every fifth; ``three`` merges even numbers, ``two`` every ninth."""
    if not prompt.isdigit():  # several answers to merge; the question stands on a line of its own
        n = int(prompt.split("\n")[1])
        if n % {"x/three": 2, "x/two": 9}[model]:
            raise M.Refused
        return f"{model} merged {prompt.count(']:')}"
    if int(prompt) % {"x/one:free": 2, "x/two": 3, "x/three": 5}[model]:
        raise M.Refused
    return f"{model} says {prompt}"


@query("model_embedding", "SELECT doc_id, length(text)::FLOAT AS chars, (length(text) - length(replace(text, ' ', '')))::FLOAT AS spaces FROM documents")
def model_embedding(t):
    out = M.embedded(t("documents").select("doc_id", "text"), "text", Embedder(), "e", policy=M.Policy(6, 1.0, 1.0, sleep=_no_wait))
    return out.select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("spaces"))


@query("model_extraction", """SELECT doc_id, model, CASE WHEN model IS NOT NULL THEN model || ':' || doc_id END AS raw, (CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END + CASE WHEN doc_id % 3 < 2 THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END ELSE 0 END)::INT AS n_calls
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'a' WHEN doc_id % 2 = 0 THEN 'b' WHEN doc_id % 5 > 0 THEN 'c' END AS model FROM documents)""")
def model_extraction(t):
    prompts = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("prompt"))
    return M.answered(prompts, "prompt", Extractor(), M.chain("a", "b", "a", "c"), M.Policy(4, 15.0, sleep=_no_wait)).select("doc_id", "model", "raw", "n_calls")


@query("model_ensemble", """SELECT item_id, n_answers, CASE n_answers WHEN 0 THEN 'All models failed or timed out. Top retrieved passage:' || chr(10) || chr(10) || coalesce(text, '(none)') WHEN 1 THEN g[1][2]
    ELSE CASE WHEN item_id % 2 = 0 THEN 'x/three merged ' || n_answers WHEN item_id % 9 = 0 THEN 'x/two merged ' || n_answers ELSE array_to_string(list_transform(g, lambda x: '**' || x[1] || ':**' || chr(10) || x[2]), chr(10) || chr(10) || '---' || chr(10) || chr(10)) END END AS answer
  FROM (SELECT item_id, text, g, len(g)::INT AS n_answers FROM (SELECT item_id, text, list_filter([CASE WHEN item_id % 2 = 0 THEN ['one', 'x/one:free says ' || item_id] END, CASE WHEN item_id % 3 = 0 THEN ['two', 'x/two says ' || item_id] END, CASE WHEN item_id % 5 = 0 THEN ['three', 'x/three says ' || item_id] END], lambda x: x IS NOT NULL) AS g FROM benchmark))""")
def model_ensemble(t):
    n = F.col("item_id").cast("string")
    q = t("benchmark").select("item_id", n.alias("question"), n.alias("prompt"), F.col("text").alias("best"))
    return M.ensemble(q, speaker, ["x/one:free", "x/two", "x/three"], M.chain("x/three", "x/two"), key="item_id", short=short_model)

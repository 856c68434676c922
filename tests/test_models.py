"""Calls of models: retries, order, fallbacks, merging."""

import pytest

from corpusloom import models as M


class Flaky:
    def __init__(self, fails, error=ConnectionError):
        self.fails, self.error, self.calls = fails, error, 0

    def __call__(self, model, given):
        self.calls += 1
        if self.calls <= self.fails:
            raise self.error("no")
        return f"{model}:{given}"


def test_tries_and_waits():
    waited = []
    policy = M.Policy(tries=4, base=15.0, sleep=waited.append)
    assert M.tried(Flaky(3), "m", 1, policy) == ("m:1", 4) and waited == [15.0, 30.0, 60.0]
    waited.clear()
    assert M.tried(Flaky(4), "m", 1, policy) == (None, 4) and waited == [15.0, 30.0, 60.0]
    waited.clear()
    assert M.tried(Flaky(1, M.Refused), "m", 1, policy) == (None, 1) and waited == []
    spaced = M.Policy(tries=1, spacing=5.0, sleep=waited.append)
    assert M.tried(Flaky(0), "m", 1, spaced) == ("m:1", 1) and waited == [5.0]
    assert all(2.0 <= M.Policy(base=1.0, jitter=1.0).wait(1) < 3.0 for _ in range(50))
    assert M.chain("b", "a", "b", "c", "a") == ["b", "a", "c"]


def _vectors(model, texts):
    return [(i, [float(len(texts)), float(len(t))]) for i, t in sorted(enumerate(texts), reverse=True)]


def _too_few(model, texts):
    return [(0, [1.0])]


def test_embedding_batches(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(300)], "id long, text string").coalesce(1)
    got = {r.id: r.vector for r in M.embedded(rows, "text", _vectors, "m", batch=128).collect()}
    assert {i: v[1] for i, v in got.items()} == {i: float(i) for i in range(300)} and {v[0] for v in got.values()} == {128.0, 44.0}
    with pytest.raises(Exception, match="gave no vectors"):
        M.embedded(rows, "text", _too_few, "m").collect()
    assert M.embedded(rows.limit(0), "text", _vectors, "m").collect() == []


def _by_length(model, prompt):
    if len(prompt) % 2 != (model == "odd"):
        raise M.Refused
    return "" if prompt == "yy" else model


def test_chain_of_models(spark):
    rows = spark.createDataFrame([("x",), ("yy",), ("zzzz",)], "p string")
    got = {r.p: (r.raw, r.model, r.n_calls) for r in M.answered(rows, "p", _by_length, ["odd", "even"]).collect()}
    assert got == {"x": ("odd", "odd", 1), "yy": ("", "even", 2), "zzzz": ("even", "even", 2)}
    got = {r.p: (r.raw, r.n_calls) for r in M.answered(rows, "p", _by_length, ["odd"]).collect()}
    assert got == {"x": ("odd", 1), "yy": (None, 1), "zzzz": (None, 1)}

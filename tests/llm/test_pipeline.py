"""The pipeline's stages against plain Python, each on its own input."""

import pytest

import corpus_pipeline as P
from corpusloom.llm import decontam, mixing, secrets_crf, toxicity
from corpusloom.llm.common import reread

from ..oracle import DATA
from . import plain


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, f in P.STAGES:
        docs = reread(f(spark, docs, DATA), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    want = stages["documents"].columns
    assert all(df.columns == want for n, df in stages.items() if n != "mixing") and stages["mixing"].columns == [*want, "mix_copy"]


def test_toxicity(spark, stages):
    docs = stages["documents"]
    lex = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out()))
    keep = {i for i, r in rows(docs).items() if lex.score(lex.features(r.text or "")) < 0.7}
    assert set(rows(stages["toxicity"])) == keep


def test_join(stages):
    want = plain.similar([(i, r.text) for i, r in rows(stages["toxicity"]).items()])
    assert set(rows(stages["ngram_join"])) == {i for i, (c, _) in want.items() if i == c}


def test_decontaminate(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = rows(stages["ngram_join"]), rows(stages["decontaminate"])
    found = plain.leaks([(i, r.text) for i, r in before.items()], items)
    assert set(after) == {i for i, (n, hit, *_) in found.items() if hit <= 0.5 * n}
    for i, r in after.items():
        assert len(plain.bench_words(r.text)) >= found[i][0] - found[i][1] - 2 and r.n_chars == len(r.text)
        if not found[i][1]:
            assert r.text == before[i].text


def test_secrets(stages):
    before, after = rows(stages["decontaminate"]), rows(stages["secrets"])
    chain = secrets_crf.trained()
    assert before.keys() == after.keys()
    for i, r in after.items():
        spans = secrets_crf.base_spans(before[i].text) + secrets_crf.crf_spans(before[i].text, chain)
        assert (r.text == before[i].text) == (not spans) and r.n_chars == len(r.text)
        assert all(before[i].text[a:b] not in r.text for _, a, b in spans if b - a > 20)


def test_mixing(stages):
    plan = {r.doc_id: r.copies for r in mixing.plan(stages["secrets"]).collect()}
    got = {}
    for r in stages["mixing"].collect():
        got.setdefault(r.doc_id, []).append(r.mix_copy)
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(c)) for i, c in plan.items() if c}


def test_run(spark, stages):
    assert sorted(map(str, P.run(spark, DATA).collect())) == sorted(map(str, stages["mixing"].collect()))


def test_odd_inputs(spark, tmp_path):
    """Nulls, empty and repeated rows, unlike texts under one id, a very long text, clashing columns, and an empty table."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("a", 60)), (1, words("b", 60)), (2, words("a", 60)), (3, None), (4, ""), (None, words("c", 60)), (5, words("d", 60)), (5, words("d", 60)), (6, words("e", 30_000))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else "web", len(t or ""), 7, 8, f"note {i}") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_copy int, tkey int, label string")
    for kind, df in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{kind}"
        df.write.parquet(f"{folder}/documents.parquet")
        for t in ("benchmark", "labels"):
            spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        out = P.run(spark, folder)
        assert out.columns == [*docs.columns, "mix_mix_copy"]
        if kind == "none":
            assert not out.collect()
            continue
        stage = df
        for name, f in P.STAGES[:-1]:
            stage = reread(f(spark, stage, folder), name)
        kept = sorted((x.doc_id or 0, x.text or "") for x in stage.collect())
        assert kept == sorted([(1, words("a", 60)), (1, words("b", 60)), (3, ""), (0, words("c", 60)), (5, words("d", 60)), (6, words("e", 30_000))])
        assert {(x.doc_id or 0, x.text) for x in out.collect()} <= set(kept) and all(x.mix_copy == 7 and x.tkey == 8 for x in out.collect())
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, empty).count() == docs.count()

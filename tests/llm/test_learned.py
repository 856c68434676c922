"""Trained operators: held-out accuracy, and defined results for every kind of row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality, queries, toxicity

from . import plain

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    out = queries.QUERIES["op3_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit > 0.8 * (out.toxic == 1).sum() and hit > 0.9 * (out.predicted == 1).sum()
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_toxicity_folds_and_exceptions():
    lex = toxicity.Lexicon({" idiot": 3.0, " clown ": 3.0}, exceptions=(" clown fish ",))
    n = lambda t: lex.features(t)[2]
    assert toxicity.folded("ІD10T, ｉｄｉｏｔ! Ｃafé") == " idiot idiot cafe "
    assert [n(t) for t in ("1d10ts", "іԁіоt", "id​iot", "a clown.", "the clown fish", "clowns", "", "idiotic clown")] == [1, 1, 1, 1, 0, 0, 0, 2]
    assert lex.score(lex.features("idiot")) > lex.score(lex.features("idiot " + "word " * 500)) > lex.score(lex.features(""))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron"), (2, None), (3, "")], "doc_id long, text string").withColumn("score", F.lit(9))
    lex = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, lex).collect()}
    assert got[1] > got[2] == got[3]
    assert {r.doc_id for r in toxicity.accepted(docs, lex).collect()} >= {2, 3}
    assert toxicity.score(docs.limit(0), lex).count() == 0


def test_quality_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "a b c a b c"), (-4, "x\ny\nx\n\n\n x\n"), (-5, "# * é b\x0bc " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r.doc_id: r for r in quality.judge(df, quality.Model({})).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(t or "")
        assert r.kept == (not r.base_failed)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels.where("doc_id % 2 = 0").select("doc_id", "quality"), bound=900)
    out = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.97 and bad.kept.mean() < 0.1
    # calibrated: of the rows given about p, about p are good
    for low in np.arange(0, 1, 0.25):
        part = out[(out.probability >= low) & (out.probability < low + 0.25)]
        if len(part) > 100:
            assert abs(part.quality.mean() - part.probability.mean()) < 0.25


def test_quality_with_over_long_texts(spark):
    good, bad = "a calm line about the river and its old bridge ", "zzq buy buy $$$ now "
    rows = [(i, (good if i % 2 else bad) * 4, i % 2) for i in range(60)]
    long = [(100 + i, good * 1000, 1) for i in range(30)]  # 47,000 characters each, against a bound of 40,000
    df = spark.createDataFrame(rows + long, "doc_id long, text string, quality int")
    m = quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"), char_bound=40_000)
    assert m.weights
    assert quality.judged([good * 8, bad * 8], m)["probability"][0] > 0.5 > quality.judged([bad * 8], m)["probability"][0]
    same = quality.learn(df.where("doc_id < 100").select("doc_id", "text"), df.select("doc_id", "quality"), char_bound=40_000)
    assert m.bias == same.bias and all((m.weights[k] == same.weights[k]).all() for k in m.weights)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id long, text string")
    m = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.judge(docs, m).first().probability == 0.5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name in ("op2_chat_format", "chat_digests") else 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, name, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "s", 0), (901, "", None, "s", 0), (902, "ab é " * 60000, "en", "src0", 300000), (903, "x" * 100000, "en", "src0", 100000)], d.schema)
    d.union(odd).selectExpr("*", "1 AS score", "'a' AS kept", "2 AS size", "3 AS bucket", "4 AS label", "5 AS rep", "6 AS key", "7 AS page", "8 AS marks", "9 AS toxic", "10 AS quality").write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    lab.union(spark.createDataFrame([(None, None, None), (900, 1, 1), (900, 0, 0)], lab.schema)).selectExpr("*", "'t' AS text").write.parquet(f"{tmp_path}/labels.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    b.union(spark.createDataFrame([(None, None), (1, ""), (2, "two words")], b.schema)).selectExpr("*", "1 AS doc_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(5)
    p.union(spark.createDataFrame([(None, None, None), (7, "u", ""), (8, "u", "<p>" * 20000 + "x")], p.schema)).selectExpr("*", "1 AS text", "2 AS page").write.parquet(f"{tmp_path}/pages.parquet")
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(20)
    c.union(spark.createDataFrame([(None, None, None, None), (1, None, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie")], c.schema)).selectExpr("*", "1 AS window").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    rows = out.collect()
    chats = len({r.conv_id for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect()}) + 1
    words = plain.spelled([(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()])
    n = {"op2_chat_format": chats, "chat_digests": chats, "op6_html_extract": 8, "op9_ngram_join": 45, "op12_spelling_variants": len(words)}.get(name, 46)
    assert len(rows) == n
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    nothing = [*of.get(900, []), *of.get(901, [])]
    if name == "op1_secret_scan":
        assert len(nothing) == 3 and all((r.n_assign, r.n_access, r.n_hex, r.spans, r.n_crf) == (0, 0, 0, "", 0) for r in [*nothing, *of[None], *of[902]])
    elif name == "op3_toxicity":
        assert len({r.score for r in [*nothing, *of[None], *of[902]]}) == 1 and {r.predicted for r in nothing} == {0}
    elif name == "op4_decontaminate":
        assert all((r.n_words, r.n_hit, r.contaminated) == (0, 0, False) for r in nothing) and of[902][0].n_words == 120000
    elif name == "op5_quality":
        assert all((r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False) for r in nothing) and of[902][0].n_repeat_words == 120000
    elif name == "op6_html_extract":
        assert [(r.text, r.n_chars) for i in (None, 7, 8) for r in of[i]] == [("", 0)] * 3
    elif name == "op7_suffix_dedup":
        assert all((r.n_bytes, r.n_removed, r.n_spans) == (0, 0, 0) for r in nothing) and (of[903][0].n_bytes, of[903][0].n_removed) == (100000, 0)
    elif name == "op8_token_count":
        assert [r.n_tokens for r in [*nothing, *of[None]]] == [0] * 4 and of[903][0].n_tokens > 1000
    elif name == "op9_ngram_join":
        assert {(r.rep_id, r.class_id, r.n_links) for r in nothing} == {(900, 900, 0)}
    elif name == "op10_mix":
        assert all((r.size, r.taken) == (0, 0) for r in [*nothing, *of[None]]) and of[902][0].size == 120000
    elif name == "op11_exact_dedup":
        assert {(r.keep_id, r.group_size) for r in [*nothing, *of[None]]} == {(901, 4)} and sum(r.kept for r in [*nothing, *of[None]]) == 1 and (of[903][0].keep_id, of[903][0].kept) == (903, True)
    elif name == "op12_spelling_variants":
        assert {r.word: r.n for r in rows} == words
    elif name == "op2_chat_format":
        assert of[-7][0].n_turns == 2 and of[None][0].loss_chars == 0


def test_scores_against_plain_matching(spark):
    """Every entry looked for at every place of the folded text, against the automaton's score."""
    r = random.Random(2)
    lexicon = toxicity.Lexicon({**toxicity.BUILT_IN, " zorp": 1.7, " zorpal ": 2.2, " bl": 0.4}, curve=(-2.0, 1.1, 0.7))
    parts = ["You ", "IDIOT", "1d1ot", "іdiоt", "ｓｔｕｐｉｄ", "st\u200bupid", " not stupid ", "trash can", "trash", "zorpal", "zorpaling", "blue", "shut  up!", "sh|t", "héllo", ", ", " ", "\n", "kill yourself", "ZORP!!", "日本", "$cum", "\u0301"]
    for _ in range(600):
        text = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 14)))
        assert lexicon.score(lexicon.features(text)) == pytest.approx(plain.toxic_score(text, lexicon.weights, lexicon.exceptions, lexicon.curve))

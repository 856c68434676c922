"""Literal cases of each operator."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import eras
from corpusloom.functions import text as T
from corpusloom.functions.unicode import graph_person_id, match_key, nfc, uuid5_url
from corpusloom.operators import chunking, entities, graph, layers, people, retrieval, state, views, vocabulary
from corpusloom.providers import get


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name, key", [("Auguste Comte", "auguste comte"), ("Évariste Galois", "evariste galois"), ("Augustin-Louis Cauchy", "augustin-louis cauchy"), ("  Poincaré  ", "poincare"), ("EULER", "euler"), ("Łukasz", "ukasz"), ("a \t b", "a b")])
def test_match_key(spark, name, key):
    assert one(spark, name, match_key) == key


@pytest.mark.parametrize("birth, era, want", [(1942, 4, 6), (1930, 5, 6), (1929, 5, 5), (1880, 3, 5), (1850, 4, 5), (1849, 4, 4), (1810, 2, 4), (1780, 3, 4), (1779, 3, 3), (1789, 3, 4), (None, 4, 4), (1600, 1, 1), (1950, None, None)])
def test_era_floor(spark, birth, era, want):
    df = spark.createDataFrame([(birth, era)], "b int, e int")
    assert df.select(eras.raised(F.col("e"), F.col("b")).alias("y")).first().y == want


@pytest.mark.parametrize("a, b, want", [("word-\nedge", "wordedge", True), ("a b", "a b", False), ("a \n b", " a b", False)])
def test_differs(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.differs(F.col("a"), F.col("b")).alias("y")).first().y is want


def test_text(spark):
    assert one(spark, "50% & 100$", T.tex) == r"50\% \& 100\$"
    assert one(spark, "a\\b~{", T.tex) == r"a\textbackslash{}b\textasciitilde{}\{"
    assert one(spark, "a\x01\\^{", T.tex) == "a\x01" + r"\textbackslash{}\textasciicircum{}\{"
    assert one(spark, "é-\né a\nb\n\n\nc  d \n", T.page_text) == "éé a b\n\nc d"
    assert one(spark, "one two three", T.token_count) == 4
    assert one(spark, "deepseek/r1:free", T.short_model) == "r1"
    assert one(spark, 1536, T.file_size, "long") == "1.0 KB"
    assert one(spark, None, T.file_size, "long") == "—"
    assert one(spark, "Mathematics and Logic", lambda c: F.array_join(T.domains(c), ",")) == "domain_history,domain_science,domain_philosophy"
    assert one(spark, "http://x", uuid5_url) == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://x"))
    assert one(spark, "é", nfc) == "é"
    assert one(spark, "Henri Poincaré", lambda c: graph_person_id(F.lit(""), c, F.lit(1854))) == "henri_poincare_1854"


SENTENCES = "Dr. Who met J. Smith. He left! See Vol. 3 now? Yes.\n\nNew para, cf.\n\nNext one. 12 apples.  \n\n\n"


def test_sentences_agree(spark):
    want = ["Dr. Who met J. Smith.", "He left!", "See Vol. 3 now?", "Yes.", "New para, cf. Next one.", "12 apples."]
    assert chunking.sentences(SENTENCES) == want
    assert one(spark, SENTENCES, T.sentences) == want
    assert one(spark, "", T.sentences) == []


def test_suffix_matches(spark):
    roster = spark.createDataFrame([(1, "John von Neumann"), (2, "Ada Lovelace"), (3, "John Adams"), (4, "Samuel Adams"), (5, "Henri Poincare"), (6, "Leonarda Vinci")], "pid long, name string").withColumn("ord", F.col("pid"))
    names = spark.createDataFrame([("von Neumann",), ("Neumann",), ("Adams",), ("Euler Lagrange",), ("Poincare",), ("da Vinci",)], "name string")
    assert {r.name: r.pid for r in entities.suffix_matches(names, roster).collect()} == {"von Neumann": 1, "da Vinci": 6}


def _clean(spark, raw):
    return one(spark, raw, entities.cleaned)


def test_response(spark):
    body = {"persons": [{"name": "Alan Turing", "birth_year": 1942, "calculus_number": 4, "evidence": "bogus_kind"}, {"name": " alan turing "}, {"name": ""}, {"name": None}], "relationships": [{"subject": "A", "predicate": "taught", "object": "ALAN TURING", "evidence": "in_source_text_direct"}, {"subject": "A", "object": "Logic"}]}
    for raw in (json.dumps(body), f"```json\n{json.dumps(body)}\n```", f"Sure: {json.dumps(body)} done"):
        c = _clean(spark, raw)
        assert [(p.name, p.calculus_number, p.evidence) for p in c.persons] == [("Alan Turing", 6, "llm_training_knowledge")]
        assert [r.object for r in c.relationships] == ["ALAN TURING"]
    assert _clean(spark, "just prose") is None and _clean(spark, "") is None and _clean(spark, "{broken") is None
    assert _clean(spark, '{"persons": []}').relationships == []


def test_pending(spark):
    index = spark.createDataFrame([(p, "indexed") for p in "abc"] + [("d", "pending"), ("e", "embedded_no_qdrant")], "path string, status string")
    graph_state = spark.createDataFrame([("a", "complete", 0), ("b", "error", 4), ("c", "error", 5)], "path string, status string, retry_count int")
    assert {r.path for r in state.pending(index, graph_state).collect()} == {"b", "e"}
    assert {r.path for r in state.pending(index, graph_state.limit(0)).collect()} == set("abce")


def test_merge_in_order(spark):
    """Against the plain loop: new people and aliases are matched from the moment they are known."""
    roster = [(1, "John von Neumann", 0), (2, "Ada Lovelace", 1)]
    files = [("f1", "von Neumann"), ("f1", "Alan M Turing"), ("f2", "M Turing"), ("f2", "Neumann"), ("f3", "von neumann"), ("f3", "Lovelace")]
    people_ = spark.createDataFrame(roster, "pid long, name string, ord long")
    ex = spark.createDataFrame([(f, n, i, int(f[1:])) for i, (f, n) in enumerate(files)], "file_name string, name string, ord long, file_ord long")
    rel = spark.createDataFrame([("f1", 1, 0, "von Neumann", "formalized", "X", None), ("f2", 2, 1, "VON NEUMANN", "formalized", "X", None), ("f2", 2, 2, "Nobody", "met", "X", None)], "file_name string, file_ord long, ord long, subject string, predicate string, object string, evidence string")
    rows = entities.resolve_all(people_, ex, rel).collect()
    assert {(r.name, r.person, r.kind) for r in rows if r.kind != "edge"} == {("von Neumann", "1", "match"), ("Alan M Turing", "new:alan m turing", "new"), ("M Turing", "new:alan m turing", "match"), ("Neumann", "new:neumann", "new"), ("von neumann", "1", "match"), ("Lovelace", "new:lovelace", "new")}
    assert sorted((r.person, r.source) for r in rows if r.kind == "edge") == [("1", "VON NEUMANN"), ("1", "von Neumann")]


def test_dedup_keeps_first_fields(spark):
    rows = [("ada", 1815, 1852, "nan", None, None, 4, None, None, 1), ("Ada", 1815, 1853, "1815-52", "UK", "x", 4, "Picture", "n", 2), ("Bob", None, 1, "", None, None, None, "u", None, 3)]
    df = spark.createDataFrame(rows, "name string, birth_year int, death_year int, lifespan_raw string, country string, field string, calculus_number int, portrait_url string, date_note string, ord long")
    a, b = people.dedup(df).orderBy("ord").collect()
    assert (a.name, a.death_year, a.lifespan_raw, a.country, a.portrait_url, a.date_note, a.n_records, a.conflict) == ("Ada", 1852, "1815-52", None, "Picture", "n", 2, True)
    assert (b.name, b.lifespan_raw, b.portrait_url, b.conflict) == ("Bob", "", "u", False)


def test_flags_and_tones(spark):
    df = spark.createDataFrame([(1, True, 2), (None, False, 0), (1, False, 1)], "e int, t boolean, n int")
    got = [r.f for r in df.select(people.pipeline_flags(F.col("e"), F.col("t"), F.col("n")).alias("f")).collect()]
    assert got == [["Era-Assigned", "Auto-Tagged", "Edges-Linked", "Graph-Ready"], ["Relationship-Incomplete"], ["Era-Assigned", "Edges-Linked", "Graph-Partial"]]
    assert one(spark, "Source-Identified", lambda c: people.flag_tone(c, people.CHIP_TONES, "grey")) == "grey"
    assert one(spark, "OCR-Failed", people.flag_tone) == "red"
    assert one(spark, 12, views.passages_stars, "int") == 10


def test_order_of_passages(spark):
    assert one(spark, list("abcde"), retrieval.context_order, "array<string>") == list("abcde")
    assert one(spark, list("abcde"), lambda c: retrieval.context_order(c, True), "array<string>") == list("acdeb")


def test_latex(spark):
    rows = [(1, 0, "heading", "H&", "H&", ""), (1, 1, "footnote", "f_1", "f_1", ""), (1, 2, "paragraph", "d-\nx", "dx", ""), (1, 3, "running_title", "r", "r", ""), (1, 4, "footnote", "late%", "late%", ""), (1, 5, "caption", "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, seq long, region_type string, diplomatic string, normalized string, translation string")
    want = "\\section{H\\&}\ndx\\footnote{Diplomatic: d-\nx}\\footnote{[Author's note] f\\_1}\n\n\\footnote{[Author's note] late\\textbackslash{}\\%}"
    assert layers.latex_body(df).first().body == want
    assert layers.latex_body(df, escape_twice=False).first().body.endswith("late\\%}")
    docs = spark.createDataFrame([(1, "T_1", None, "reledpar")], "doc_id long, title string, author string, template string")
    assert "\\title{T\\_1}" in layers.rendered(docs, layers.latex_body(df)).first().latex


def test_page_regions(spark):
    span = lambda text, size=10.0, flags=0: [([(text, size, flags)],)]
    rows = [(1, 2, 0, 0, 80, 300, 500, 320, span("body")), (1, 1, 3, 0, 80, 300, 500, 320, span("Big", 15.0)), (1, 1, 1, 1, 80, 100, 500, 120, span("image")), (1, 1, 2, 0, 80, 100, 500, 120, span("  ")), (1, 1, 4, 0, 80, 790, 500, 799, span("7")), (1, 1, 5, 0, 80, 600, 500, 620, span("note", 8.0)), (1, 1, 6, 0, 10, 300, 90, 320, span("side")), (1, 1, 7, 0, 80, 300, 500, 320, span("Fig. 1", 9.0)), (1, 1, 8, 0, 80, 300, 500, 320, span("Sub", 12.0, 16))]
    df = spark.createDataFrame(rows, "doc_id int, page int, number int, kind int, x0 int, y0 int, x1 int, y1 int, lines array<struct<spans: array<struct<text: string, size: double, flags: int>>>>")
    out = layers.page_regions(df.withColumn("width", F.lit(600)).withColumn("height", F.lit(800))).orderBy("seq").collect()
    assert [(r.seq, r.region_type) for r in out] == list(enumerate(["heading", "running_title", "footnote", "margin_note", "caption", "subheading", "paragraph"]))


def test_views(spark):
    p = spark.createDataFrame([(1, "émile", 1), (2, "Zoe", None), (3, "Emil", 1), (4, "emma", 2)], "pid int, name string, calculus_number int")
    assert [r.pid for r in views.by_name(p).collect()] == [3, 1, 4, 2]
    assert [r.pid for r in views.by_name(p, " EM ", "1").collect()] == [3]
    assert one(spark, [("A",), (None,)], views.is_roster, "array<struct<name: string>>") is False
    assert one(spark, ["a"], lambda c: people.all_flags(c, F.lit(None).cast("array<string>")), "array<string>") == ["a"]


def test_vocabulary(spark):
    lines = ["intro", "TAGS A — CLOSED", "", "one", "two", "", "three", "TAGS B", "four", "one"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    out = vocabulary.sections(df, {"TAGS A": "a", "TAGS B": "b"})
    assert [(r.section, r.group_no, r.pos, r.tag) for r in out.orderBy("n").collect()] == [("a", 1, 1, "one"), ("a", 1, 2, "two"), ("a", 2, 3, "three"), ("b", 1, 1, "four"), ("b", 1, 2, "one")]
    assert {r.tag: r.section for r in vocabulary.tag_sections(out).collect()}["one"] == "b"
    used = spark.createDataFrame([("one",), ("six",)], "tag string")
    assert [r.tag for r in vocabulary.unknown_tags(used, out).collect()] == ["six"]


def test_graph_quirks(spark):
    p = spark.createDataFrame([("1", "A", 0), ("2", "B", 1), ("3", "A", 2)], "id string, name string, ord int")
    r = spark.createDataFrame([("1", "A", 0, "A", "B", "taught", None, None), ("3", "A", 0, "A", "B", "taught", 0.9, "canonical"), ("1", "A", 1, "A", "A", "taught", 0.9, None), ("2", "B", 0, "?", "A", "cited", 0.2, "ai_hypothesis")], "owner string, owner_name string, position int, source string, target string, relation_type string, weight double, assertion_layer string")
    e = graph.build_edges(p, r).collect()
    assert [(x.source, x.target, x.weight, x.color) for x in e] == [("3", "2", 0.5, "#c9a96e")]  # the last A; the first of the repeats
    assert graph.build_edges(p, r, True).count() == 2
    n = p.withColumns({"calculus_number": F.lit(1), "schools": F.array(), "suggested_schools": F.array()})
    assert graph.visible_nodes(n, []).count() == 0 and graph.visible_nodes(n, [1]).count() == 3
    assert one(spark, "#c9a96e", graph.dimmed) == "#c9a96e33"


def test_language_guess_reads_whole_texts(spark, tmp_path):
    from corpusloom.catalogue import QUERIES

    text = "the cat and the dog " * 30 + "le chat et les chiens des villes " * 100
    spark.createDataFrame([(1, text, "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.guess for r in QUERIES["language_guess"](spark, str(tmp_path)).collect()] == ["fr"]
    assert one(spark, text, get("language")) == "en"  # the provider's first 500 characters


def test_language_guess(spark):
    for text, lang in (("the cat and the dog", "en"), ("le chat et les chiens", "fr"), ("der Hund und die Katze", "de"), ("", "en")):
        assert one(spark, text, get("language")) == lang
    with pytest.raises(ValueError):
        get("embed", "none such")
    assert len(one(spark, "a b", get("embed"))) == 64 and one(spark, "a b a", get("sparse")) == {"a": 2.0, "b": 1.0}

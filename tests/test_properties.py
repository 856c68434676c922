"""Properties that hold for any input."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import chunking as C

words = st.lists(st.sampled_from("Alpha beta. Gamma! delta Vol. X. 12 é, end? So".split()), max_size=400)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=4))
def test_sentences_are_in_chunks(pages):
    texts = [(i + 1, " ".join(w)) for i, w in enumerate(pages)]
    out = C.chunks_of(texts, "s", "en")
    parents = [c for c in out if c[3] == "parent"]
    whole = "".join(re.sub(r"\s", "", t) for _, t in texts)
    assert all(len(c[5]) >= C.MIN_CHUNK_CHARS for c in out)
    assert all(re.sub(r"\s", "", s) in whole for c in parents for s in C.sentences(c[5])[:1])
    assert len({c[0] for c in out}) == len(out)
    assert {c[4] for c in out if c[3] == "child"} <= {c[0] for c in parents}
    if sum(len(" ".join(w)) for w in pages) > 4000:
        last = [s for _, t in texts for s in C.sentences(t)][-1]
        assert last in parents[-1][5] or len(last) < C.MIN_CHUNK_CHARS


def test_chunk_table(spark):
    from corpusloom.operators.chunking import chunk, indexed_chunks

    rows = [("a", [(1, "Word one two. " * 300), (2, None)], "en"), ("b", [(1, "short")], "en"), ("c", None, "fr")]
    df = spark.createDataFrame(rows, "source_file_id string, pages array<struct<page: int, text: string>>, lang string")
    out = indexed_chunks(chunk(df)).collect()
    assert {r.source_file_id for r in out} == {"a"} and {r.level for r in out} == {"child"}
    assert all(r.token_count <= C.CHILD_TOKENS + C.OVERLAP_TOKENS for r in out)

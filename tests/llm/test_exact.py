"""Operators against the plain versions of their contracts, over generated rows and the small tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat_windows, decontam, html_extract, mixing, ngram_join, queries, secrets_crf, suffix_dedup, token_count

from ..oracle import DATA, same
from . import plain


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_secrets_query(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op1_secret_scan"](spark, DATA).collect()}
    for i, text in documents:
        base = plain.secrets(text)
        names = [f"{k}:{a}:{b}" for a, _, b, k in base]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == plain.sha(",".join(names)) and set(names) <= set(r.spans.split(","))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", ' = "', ":", "'", " ", "ſecret", "passwd", "AKIA", "ABCDEFGH01234567", "deadbeef0123", "x9", "é", "=", "\n", "\t"]), max_size=24).map("".join))
def test_secret_spans(text):
    base = secrets_crf.base_spans(text)
    assert secrets_crf.ordered(base) == ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain.secrets(text))


def test_crf_finds_what_patterns_miss():
    chain = secrets_crf.trained()
    hit = lambda t: [t[a:b] for _, a, b in secrets_crf.crf_spans(t, chain)]
    assert hit("db pass: Zk39dlQpW81mmA0x ok") == ["Zk39dlQpW81mmA0x"]
    assert hit('auth = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"') == ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"]
    assert hit("on 2024-10-11 at 555-1234-222, version 1.2.33333, www.example1.com") == []
    held = secrets_crf.generated(400, seed=99)
    right = wrong = total = 0
    for text, spans in held:
        found = [s for s in secrets_crf.crf_spans(text, chain)]
        total += len(spans)
        right += sum(any(a < e and s < b for _, a, b in found) for s, e in spans)
        wrong += sum(not any(a < e and s < b for s, e in spans) for _, a, b in found)
    assert right > 0.9 * total and wrong < 0.05 * total
    assert secrets_crf.redact("a token=abcdef1 b", "assign:2:15,crf:8:15") == "a [SECRET] b"


def test_crf_precision_and_recall():
    """Secrets put into the small table's clean texts, none of a kind that a pattern finds."""
    import duckdb

    chain, r = secrets_crf.trained(), random.Random(12)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' WHERE length(text) BETWEEN 200 AND 3000 ORDER BY doc_id").fetchall()]
    texts = [t for t in texts if not secrets_crf.base_spans(t) and not secrets_crf.crf_spans(t, chain)]
    assert len(texts) > 50
    right = found = 0
    for t in texts:
        secret = "".join(r.choice(alnum) for _ in range(r.randint(18, 40))) + "7"
        lead = r.choice(("auth = '", "credential: ", "private_key = ", "bearer ", "signature: "))
        at = t.index(" ") + 1
        planted = f"{t[:at]}{lead}{secret} {t[at:]}"
        a = at + len(lead)
        assert not secrets_crf.base_spans(planted)
        got = secrets_crf.crf_spans(planted, chain)
        found += len(got)
        right += ("crf", a, a + len(secret)) in got
    assert right >= 0.95 * len(texts) and right >= 0.95 * found
    for plain_text in ("see https://example.com/2023/10/11/post-1 now", "fixed in commit 3f2a9c1b7d yesterday", "room abc123 is free"):
        assert secrets_crf.crf_spans(plain_text, chain) == [], plain_text


def test_viterbi_and_gradient():
    from itertools import product

    r = np.random.default_rng(2)
    margin = secrets_crf.BEGIN_MARGIN
    for n in (1, 2, 3, 5):
        c = secrets_crf.Chain()
        c.emit, c.move = r.normal(size=(7, 3)), r.normal(size=(3, 3))
        scores = r.normal(size=(n, 3))

        def value(path):
            whole = (0, *path, 0)
            ok = all(not (b == 2 and a == 0) for a, b in zip(whole, whole[1:]))
            return sum(c.move[a, b] - margin * (b == 1) for a, b in zip(whole, whole[1:])) + sum(scores[t, k] for t, k in enumerate(path)) if ok else -1e18

        assert tuple(c.viterbi(scores)) == max(product(range(3), repeat=n), key=value)
        x, y = r.integers(0, 6, (4, n, 2)), r.integers(0, 3, (4, n))
        plain_ll = 0.0
        for xi, yi in zip(x, y):
            of = lambda p: sum(c.move[a, b] for a, b in zip((0, *p), (*p, 0))) + sum(c.emit[xi[t]].sum(axis=0)[k] for t, k in enumerate(p))
            plain_ll += of(tuple(yi)) - np.log(sum(np.exp(of(p)) for p in product(range(3), repeat=n)))
        ll, de, dm = c.likelihood(x, y)
        assert abs(ll - plain_ll) < 1e-9
        for weights, d in ((c.emit, de), (c.move, dm)):
            for at in [(int(r.integers(0, len(weights))), int(r.integers(0, 3))) for _ in range(6)]:
                weights[at] += 1e-6
                up = c.likelihood(x, y)[0]
                weights[at] -= 2e-6
                down = c.likelihood(x, y)[0]
                weights[at] += 1e-6
                assert abs((up - down) / 2e-6 - d[at]) < 1e-4


def test_crf_goes_on_over_separators():
    for gap in (" ", ", ", ": ", "\n    "):
        text = f"secret: Abc1Defg2Hij{gap}Klm3Nopq4Rst"
        assert secrets_crf.candidate_runs(text) == [[(8, 20), (len(text) - 12, len(text))]]
        assert secrets_crf.crf_spans(text, secrets_crf.trained()) == [("crf", 8, len(text))], gap
    assert len(secrets_crf.candidate_runs("Abc1Defg2Hij, or Klm3Nopq4Rst")) == 2
    text = "12345678 token"
    assert "next=key" in secrets_crf.token_features(text, 0, 8, ())


turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a>b[<"]), st.lists(st.sampled_from(["<", "[", "\\", "</s>", "[INST]", " ", "a b", "é", "\n", "<<SYS>>", ">", "]", "word " * 9]), max_size=8).map("".join)), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(turns, st.integers(1, 40), st.integers(0, 20))
def test_chat_round_trip(rows, budget, history):
    p = chat_windows.Packer(budget, history)
    windows = [w for w in [*(p.add(*t) for t in rows), p.close()] if w]
    assert [t for w in windows for t in chat_windows.parsed(w.text)[w.fresh :]] == rows
    assert [chat_windows.unescape(w.text[a:b]) for w in windows for a, b in w.loss] == [t for role, t in rows if role == "assistant"]
    size = lambda t: max(1, len(chat_windows.TOKEN.findall(t)))
    for w in windows:
        shown = chat_windows.parsed(w.text)
        assert w.tokens == sum(size(t) for _, t in shown)
        assert w.tokens <= budget or (w.turns, w.fresh) == (1, 0)


def test_chat_budget():
    words = lambda w, n: " ".join([w] * n)
    turns = [("system", words("s", 40)), ("user", words("a", 300)), ("assistant", words("b", 100)), ("user", words("c", 20)), ("assistant", words("d", 450)), ("user", words("e", 490)), ("assistant", words("f", 600)), ("user", words("g", 60))]
    p = chat_windows.Packer(512, 128)
    windows = [w for w in [p.add(*t) for t in turns] + [p.close()] if w]
    got = [(w.tokens, [text[0] for _, text in chat_windows.parsed(w.text)], w.fresh) for w in windows]
    # history gives way to d, the system turn to e; f is alone; g has the system turn again
    assert got == [(460, ["s", "a", "b", "c"], 0), (510, ["s", "c", "d"], 2), (490, ["e"], 0), (600, ["f"], 0), (100, ["s", "g"], 1)]


def test_chat_system_turn_anywhere():
    """A system turn that comes later leads the windows after it, and the latest one takes the place of those before, never twice."""
    words = lambda w, n: " ".join([w] * n)
    turns = [("user", words("a", 10)), ("system", words("s", 5)), ("assistant", words("b", 30)), ("user", words("c", 40)), ("system", words("t", 4)), ("user", words("d", 45)), ("assistant", words("e", 40))]
    p = chat_windows.Packer(50, 20)
    windows = [w for w in [p.add(*t) for t in turns] + [p.close()] if w]
    got = [([text[0] for _, text in chat_windows.parsed(w.text)], w.fresh) for w in windows]
    assert got == [(["a", "s", "b"], 0), (["s", "c", "t"], 1), (["t", "d"], 1), (["t", "e"], 1)]


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, _, role, text in sorted(rows):
        n, all_, loss = want.get(c, (0, "", ""))
        want[c] = n + 1, all_ + f"{role}\n{text}\n", loss + (text if role == "assistant" else "")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.QUERIES["op2_chat_format"](spark, DATA).collect()}
    assert got == {c: (n, plain.sha(a), len(x), plain.sha(x)) for c, (n, a, x) in want.items()}
    w = chat_windows.windows(spark.read.parquet(f"{DATA}/conversations.parquet")).collect()
    assert len(w) >= len(want) - 1 and all(r.text[a:b] in r.text for r in w for a, b in r.loss)


def test_leaks(spark):
    r = random.Random(3)
    for window in (10, 3):
        words = "Aa b C dé 1".split()
        items = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 2 * window)))) for k in range(12)] + [(99, None)]
        docs = [(i, " ".join([*(r.choice(words) for _ in range(r.randint(0, 30))), *items[r.randrange(12)][1].split()])) for i in range(60)] + [(60, None), (61, "")]
        want = plain.leaks(docs, items, window)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.scan(d, b, window).collect()}
        assert got == want
        # blocks of a larger benchmark give the same
        given_ = decontam.automata(b, window, block_words=20)
        assert len(given_) > 1
        for (i, t), (n, spans, found) in zip(docs, decontam.find([t or "" for _, t in docs], given_)):
            assert (n, sum(q - p for p, q in spans), len({str(x) for x in found})) == want[i][:3]


def test_automaton_against_plain_windows():
    r = random.Random(5)
    for _ in range(60):
        words = [b"a", b"b", b"c"][: r.randint(1, 3)]
        window = r.randint(2, 5)
        items = [(k, [r.choice(words) for _ in range(r.randint(0, 9))]) for k in range(r.randint(0, 6))]
        a = decontam.Automaton(items, window)
        doc = [r.choice([*words, b"z"]) for _ in range(r.randint(0, 30))]
        hit, found = set(), set()
        for k, w in items:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                for j in range(len(doc) - n + 1):
                    if n and doc[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(k)
        spans, got = a.match(doc)
        assert {p for x, y in spans for p in range(x, y)} == hit and {a.names[k] for k in got} == found


def test_leaks_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before it, {item}! after " + "x " * 40, "a", 0), (2, item, "b", 0), (3, "clean", "c", 5)], "doc_id long, text string, window string, n_chars long")
    out = {r.doc_id: r for r in decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3} and out[1].text.startswith("Before it, ! after x") and out[1].n_chars == len(out[1].text) and out[3].n_chars == 5 and out[1].window == "a"


def test_minimum_cut():
    from itertools import product

    r = random.Random(4)
    for _ in range(500):
        n = r.randint(1, 7)
        pull = [r.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, r.randint(0, 4)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda x: sum(abs(p) for p, k in zip(pull, x) if (p > 0) != k and p) + sum(w for i, j, w in edges if x[i] != x[j])
        assert cost(html_extract.minimum_cut(pull, edges)) == min(map(cost, product((False, True), repeat=n)))


def test_minimum_cut_of_pages():
    """Pages' graphs are nested, so they are cut without augmenting paths, in time that grows with their blocks only."""
    import time

    r = random.Random(9)

    def blocks(n):
        scopes, out, last = [0], [], 0
        for i in range(n):
            if r.random() < 0.3:
                last += 1
                scopes.append(last)
            elif r.random() < 0.3 and len(scopes) > 1:
                scopes.pop()
            out.append(html_extract.Block("w " * r.randint(1, 9), 0, r.choice(("p", "div", "li")), r.choice(scopes), scopes[-1], 0))
        return out

    with pytest.MonkeyPatch.context() as m:
        def none(*_):
            raise AssertionError("not reduced")

        flow = html_extract._flow
        for n in (1, 2, 30, 200):
            b = blocks(n)
            pull, edges = [r.randint(-900, 900) for _ in b], html_extract.edges_of(b)
            near = {i: {} for i in range(n)}
            for i, j, w in edges:
                near[i][j] = near[j][i] = w
            m.setattr(html_extract, "_flow", none)
            got = html_extract.minimum_cut(pull, edges)
            m.setattr(html_extract, "_flow", flow)
            assert {i for i, k in enumerate(got) if k} == html_extract._flow(dict(enumerate(pull)), near)  # also the same of several least cuts
        m.setattr(html_extract, "_flow", none)
        b = blocks(100_000)
        began = time.perf_counter()
        html_extract.minimum_cut([r.randint(-900, 900) for _ in b], html_extract.edges_of(b))
        assert time.perf_counter() - began < 20


def test_cut_overrules_the_scorer():
    """A short line amid an article's text is kept for its neighbours' sake, though it scores as boilerplate; a heading goes with them."""
    p = "<p>The committee met on Tuesday and agreed on a plan for the bridge over the river.</p>"
    for page, below in ((f"<div>{p}<p>Plan</p>{p}</div>", True), (f"<div>{p}<h3>Plan</h3>{p}</div>", False)):
        scores = [html_extract.log_odds(b) for b in html_extract.read(page)]
        assert (scores[1] < 0) == below and scores[1] <= 0 < min(scores[0], scores[2])
        assert html_extract.extract(page).count("\n\n") == 2
    assert html_extract.extract("<div><h3>Plan</h3></div>") == ""


def test_page_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site<nav><a href="/x">Home</a></nav></header><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies.</div><main><h1>Ti &amp; tle</h1><p>Hello   <b>wor</b>ld<br>again &lt;3. Nice text here</p><form><input><label>Mail</label></form><ul><li>One point.</li></ul>
    <div class="comments"><p>A reader's comment that is long enough. Yes.</p></div></main><aside>More</aside><footer>&copy; X</footer><script>var unclosed = 1;"""
    assert html_extract.extract(page) == "Ti & tle\n\nHello world again <3. Nice text here\n\nOne point."
    assert html_extract.extract("") == html_extract.extract("<nav><a>x</a></nav>") == ""
    rows = queries.QUERIES["op6_html_extract"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)
    import html
    import re

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|div|article)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_page_text_in_wrappers():
    p = "<p>" + "The committee met on Tuesday and agreed on a plan for the bridge over the river. " * 6 + "</p>"
    text = html_extract.extract(f"<article>{p}</article>")
    assert text.count("bridge") == 6
    pages = (
        "<body class='single-post has-sidebar'><article>%s</article></body>", "<div class='layout no-sidebar'><main>%s</main></div>", "<div class='page-with-header'><div>%s</div></div>",
        "<form><div>%s</div></form>", "<form><article>%s</article></form>", "<div class='sidebar-page'><article>%s</article></div>", "<article class='post tag-social'>%s</article>",
    )
    for page in pages:
        assert html_extract.extract(page % p) == text, page
    card = "<div class=related><article><h3>Card</h3><p>A short teaser of another story that you may want to read. Enjoy it.</p></article></div>"
    assert html_extract.extract(f"<main>{p}</main>{card}<section class=comments><article class=comment>{p}</article></section>") == text


def test_repeated_bytes(spark, documents):
    r = random.Random(6)
    base = ["".join(r.choice("abcdé ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(r.randint(0, 5)):
            b, a = r.choice(base), r.randint(0, 290)
            t += b[a : a + r.randint(1, 160)] + r.choice(["", "a" * r.randint(0, 120), "".join(r.choice("xyz") for _ in range(r.randint(0, 60)))])
        rows.append((i * 3 - 50, t))
    rows += [(None, rows[5][1]), (1000, rows[5][1]), (1000, rows[5][1]), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS marks")
    got = sorted((tuple(r) for r in suffix_dedup._finished(df, "doc_id", "text", True).collect()), key=str)
    assert got == sorted(plain.repeats(rows), key=str)
    with pytest.MonkeyPatch.context() as m:  # names that a task settles itself
        m.setattr(suffix_dedup, "HOT", 2)
        h = lambda f, t: [np.concatenate(x) for x in zip(*(f(i, s) for i, s in t))]

        def named(i, t):
            sums = suffix_dedup.sums(np.frombuffer(t.encode(), np.uint8))
            at, name = suffix_dedup.anchors(sums)
            c = suffix_dedup.contexts(sums, at)[2]
            return name, c, suffix_dedup.sides(sums, at), np.full(len(at), i, np.int64)

        parts = [h(named, rows[:40]), h(named, rows[40:80])]
        settled = [suffix_dedup.settled_contexts(*x) for x in parts]
        ids, marks = suffix_dedup.ranked_contexts(*(np.concatenate(c) for c in zip(*(x[0] for x in settled))))
        told = {(i, int(m) & ~7) for i, m in zip([*ids, *settled[0][2], *settled[1][2]], [*marks, *settled[0][1], *settled[1][1]])}
        m.setattr(suffix_dedup, "HOT", 10**9)
        ids, marks = suffix_dedup.ranked_contexts(*(np.concatenate(x) for x in zip(*parts)))
        assert {(i, int(m) & ~7) for i, m in zip(ids, marks)} <= told  # nothing that must be looked at is lost
    rows = [tuple(r) for r in queries.QUERIES["op7_suffix_dedup"](spark, DATA).collect()]
    assert sorted(rows) == sorted(plain.repeats(documents))


def test_token_counts(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    import sentencepiece

    v = token_count.load()
    m = sentencepiece.SentencePieceProcessor(model_file=token_count.VOCABULARY)
    pieces = [(m.id_to_piece(i), v.scores.get(m.id_to_piece(i), 0.0)) for i in range(m.get_piece_size())]
    pieces = [(p if p in v.scores or m.is_byte(i) else "\0" + p, s) for i, (p, s) in enumerate(pieces)]
    theirs = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, True))
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "the", "é", "日", "😀", " ", "  ", "\n", "ion", "Ł", "\t", "q"]) for _ in range(r.randint(0, 30))) for _ in range(500)]
    for t in texts + [t for _, t in documents[:60]]:
        assert v.count(t) == (len(theirs.encode("▁" + t.replace(" ", "▁")).ids) if t else 0)
    for _ in range(1000):  # ties, unknown characters
        scores = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 3))): float(-r.randint(1, 3)) for _ in range(r.randint(1, 8))}
        small = token_count.Vocabulary(scores, min(*scores.values(), 0.0), False)
        theirs = tokenizers.Tokenizer(tokenizers.models.Unigram([("\0", 0.0), *scores.items()], 0, False))
        t = "".join(r.choice("abc ") for _ in range(r.randint(1, 9)))
        assert small.count(t) == len(theirs.encode("▁" + t.replace(" ", "▁")).ids)
    got = {x.doc_id: x.n_tokens for x in queries.QUERIES["op8_token_count"](spark, DATA).collect()}
    assert got == {i: v.count(t) for i, t in documents}


def test_similar_documents(spark, documents):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.QUERIES["op9_ngram_join"](spark, DATA).collect()}
    assert got == plain.similar(documents)


def test_forest_and_recall():
    assert ngram_join.least_depth() == 3
    none = np.zeros(ngram_join.BINS, dtype=np.int64)
    high, low = none.copy(), none.copy()
    high[-1], low[0] = 10**6, 10**6
    assert ngram_join.next_depth(none, 8, 3) == 3  # nothing found: the one link at the threshold decides
    assert ngram_join.next_depth(high, 8, 3, recall=0.999) is None and ngram_join.next_depth(low, 8, 3, recall=0.999) == 6
    assert ngram_join.next_depth(low, 3, 3) is None
    assert ngram_join.estimated_recall(low, 8) < ngram_join.estimated_recall(low, 5) < ngram_join.estimated_recall(high, 5)


def test_forest_ties(spark):
    """Neighbours in the sorted tries tie all texts below a node, wherever partitions end."""
    r = random.Random(3)
    trees, n = 3, 120
    names = list(range(n))
    labels = {i: [tuple(r.choice((1, 2)) for _ in range(ngram_join.DEPTH)) for _ in range(trees)] for i in names}
    rows = [(i, bytearray(np.array(labels[i], dtype=">u2").tobytes())) for i in names]
    for parts in ("3", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        ties = [(x.a, x.b, x.depth) for x in ngram_join.forest(spark.createDataFrame(rows, "name long, labels binary"), trees, 1).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for depth in (1, 4, 8):
            def top(edges):
                tops = {i: i for i in names}
                def find(i):
                    while tops[i] != i:
                        i = tops[i]
                    return i
                for a, b in edges:
                    x, y = sorted((find(a), find(b)))
                    tops[y] = x
                return [find(i) for i in names]

            met = [(i, j) for i in names for j in range(i) if any(labels[i][t][:depth] == labels[j][t][:depth] for t in range(trees))]
            assert top([(a, b) for a, b, d in ties if d >= depth]) == top(met)


def test_similar_group_in_blocks(spark):
    r = random.Random(8)
    base = [f"w{r.randint(0, 30)}" for _ in range(60)]
    rows = [(i, " ".join([*base[: (k := r.randint(0, 60))], f"n{i}", *base[k:]])) for i in range(40)] + [(100 + i, " ".join(base)) for i in range(5)] + [(200, "a b"), (201, "a b"), (202, "a b c"), (203, ""), (204, None), (205, "x y  z u v"), (206, "x y z\nu v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS rep", "1 AS label")
    want = plain.similar(rows)
    for options in ({}, {"block_texts": 7}, {"block_shingles": 500}):
        report = {}
        got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.classes(df, **options, report=report).collect()}
        assert got == want and report["depths"][0] == ngram_join.DEPTH and report["recall"] > 0.999 and 2 * sum(report["links"]) == sum({t or "": want[i][1] for i, t in rows}.values())
    kept = ngram_join.keep_first(df.union(spark.createDataFrame([(None, "a b", 0, 1)], df.schema)))
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(["None", *(str(i) for i, (c, _) in want.items() if i == c)])


def test_unlike_texts_under_one_id(spark):
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    one, near = words("d"), words("d", 41)
    rows = [(1, words("a")), (5, words("b")), (5, words("a")), (5, words("c")), (5, words("c")), (6, words("e")), (6, one), (7, near), (4, words("f")), (8, words("f"))]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)
    got = sorted((x.doc_id, x.rep_id, x.class_id, x.n_links) for x in ngram_join.classes(df).distinct().collect())
    assert got == [(1, 1, 1, 0), (4, 4, 4, 0), (5, 1, 1, 0), (5, 5, 5, 0), (6, 6, 6, 0), (6, 6, 6, 1), (7, 7, 6, 1), (8, 4, 4, 0)]
    kept = sorted((x.doc_id, x.text) for x in ngram_join.keep_first(df).collect())
    assert kept == sorted([(1, words("a")), (4, words("f")), (5, words("b")), (5, words("c")), (6, words("e")), (6, one)])


def test_mix(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "w " * (1 + i % 5), i) for i in range(300)] + [(900, "s0", None, 0), (901, "s0", "", 0), (902, "big", "x " * 500, 0), (5, "s2", "w", 9), (5, "s2", "w", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, bin long")
    out = mixing.plan(df).selectExpr("doc_id", "source", "size", "source_size", "target", "copies * size AS taken").collect()
    assert len(out) == len(rows)
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    targets = {s: v[0].target for s, v in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    order = sorted((s for s in targets if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free = [s for s in targets if targets[s] < 2 * by[s][0].source_size - 1e-9]
    assert len({round(targets[s] / weight[s], 6) for s in free}) == 1
    for s, v in by.items():
        assert v[0].source_size == sum(r.size for r in v)
        assert abs(sum(r.taken for r in v) - targets[s]) <= max(r.size for r in v) / 2 + 1e-6
        assert all(r.taken <= 2 * r.size for r in v)
    again = {(r.doc_id, r.taken) for r in mixing.plan(df.repartition(7)).selectExpr("doc_id", "copies * size AS taken").collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    clash = mixing.mix(df.selectExpr("*", "bin AS mix_copy", "bin AS Mix_Mix_copy"))
    assert clash.columns == [*df.columns, "mix_copy", "Mix_Mix_copy", "mix_mix_mix_copy"] and all(x.mix_copy == x.bin for x in clash.collect())
    # equal in key, id and size, unlike in the rest: reruns agree on which goes
    twins = spark.createDataFrame([(1, "a", "w w", f"row {i}") for i in range(9)], "doc_id long, source string, text string, note string")
    taken = [sorted(x.note for x in mixing.mix(twins.repartition(n)).collect()) for n in (1, 4, 7)]
    assert taken[0] == taken[1] == taken[2] and 9 <= len(taken[0]) < 18
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "source", "text", "bin", "mix_copy"] and mixed.count() == sum(r.taken // r.size for r in out if r.size)


def test_page_text_without_names():
    """Pages of plain <div>: titles, lists and tables stay with the text around them; lists of links, notices and the footer go."""
    p = "The committee met on Tuesday and agreed on a plan for the bridge over the river. " * 4
    links = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
    page = f"<body>{links}<div><h1>T</h1><p>{p}</p><h2>Steps</h2><ul><li>One</li><li>Two</li></ul><p>{p}</p><table><tr><th>Year</th><td>1900</td></tr><tr><td>x<td>y</table><p>{p}</p><ol><li>End</li></ol></div>{links}<p>&copy; 2020 Corp</p></body>"
    assert html_extract.extract(page).split("\n\n") == ["T", p.strip(), "Steps", "One", "Two", p.strip(), "Year", "1900", "x", "y", p.strip(), "End"]


def test_page_text_without_spaces():
    for p in ("\u79c1\u305f\u3061\u306f\u6628\u65e5\u3001\u6771\u4eac\u306e\u516c\u5712\u3067\u9577\u3044\u6642\u9593\u3092\u904e\u3054\u3057\u307e\u3057\u305f\u3002" * 3, "\u59d4\u5458\u4f1a\u661f\u671f\u4e8c\u5f00\u4f1a\uff0c\u540c\u610f\u4e86\u8fc7\u6cb3\u7684\u5927\u6865\u8ba1\u5212\u3002" * 3, "\u0e04\u0e13\u0e30\u0e01\u0e23\u0e23\u0e21\u0e01\u0e32\u0e23\u0e1b\u0e23\u0e30\u0e0a\u0e38\u0e21" * 4):
        assert html_extract.extract(f"<body><div><p>{p}</p></div></body>") == p


def test_page_text_without_readers():
    """What readers say, and alerts, go wherever names tell; a discussion inside an article is a section of it."""
    p = "The committee met on Tuesday and agreed on a plan for the bridge over the river. " * 4
    for other in ("<section id='discussion'>%s</section>", "<div role='alert'>%s</div>", "<div id=userComments>%s</div>", "<div class='reactions'>%s</div>"):
        assert html_extract.extract(f"<body><article><p>{p}</p></article>{other % f'<p>{p}</p>'}</body>") == p.strip(), other
    assert html_extract.extract(f"<article><p>{p}</p><section id=discussion><p>{p}</p></section></article>").count("bridge") == 8


def test_page_of_broken_tags():
    """A megabyte of end tags of nothing, or of items that look for one to close, takes time in proportion."""
    from time import process_time

    n = 100_000
    at = process_time()
    assert html_extract.extract("<div>" * n + "</x>" * n) == html_extract.extract("<li><div>" + "<x-a>" * n + "<li></li>" * n) == ""
    assert process_time() - at < 20


def test_secrets_bare_keys_and_version_names():
    import random

    r = random.Random(5)
    chain = secrets_crf.trained()
    text = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    found = lambda t: [t[a:b] for _, a, b in secrets_crf.crf_spans(t, chain)]
    keys = ["ghp_abcdefghij0123456789ABCDEFGHIJ0123"] + [k + text(alnum, n) + "7" for k in ("ghp_", "sk_live_", "xoxb-", "glpat-", "npm_") for n in range(20, 40)]
    assert found(keys[0]) == [keys[0]]
    assert sum(found(f"we left {k} in it") == [k] for k in keys) >= 0.95 * len(keys)
    assert found("auth: hunter2abc") == ["hunter2abc"]
    assert found("commit 3f2a9bc of v1.2.3") == []
    names = [f"{w} {text('0123456789abcdef', n)}1" for w in ("commit", "revision", "in build", "merged as", "see") for n in range(6, 12) for _ in range(5)]
    assert sum(not found(f"it was {x} of v1.2.3 on 2020-01-02") for x in names) >= 0.95 * len(names)


def test_join_boilerplate(spark):
    """Texts that share a long block meet in the tries at short prefixes, but only what is nearly alike is verified, and no link is lost."""
    import random

    r = random.Random(3)
    block = " ".join(f"b{i}" for i in range(120))
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(400)]
    rows = [(i, f"{block} {x}") for i, x in enumerate(own)] + [(1000 + i, f"{block} {own[i]} end{i}") for i in range(0, 400, 40)]
    report: dict = {}
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=1.0, report=report).collect()}
    want = {i: (i, int(i % 40 == 0)) for i in range(400)} | {1000 + i: (i, 1) for i in range(0, 400, 40)}
    assert got == want and report["depths"][-1] == 3 and sum(report["verified"]) <= 2 * 10 * len(report["depths"])


def test_close_pairs():
    r = np.random.default_rng(4)
    for m, width in ((2, 24), (33, 192), (1100, 48), (40, 300)):
        s = r.integers(0, 3, (m, width)).astype(np.uint8)
        s[m // 2] = s[0]
        want = np.array([(s == x).sum(axis=1) >= width // 2 for x in s])
        assert (ngram_join.close_pairs(s, width // 2) == want).all()
        ids = r.permutation(10 * m)[:m]
        i, j = np.nonzero(want)
        nodes, tops = ngram_join.roots(ids[i], ids[j])
        assert sorted(ngram_join.stars_of(ids, want)) == sorted((int(a), int(b)) for a, b in zip(nodes, tops) if a != b)


def test_items_without_ids(spark):
    """An item without an id hits words and counts as one; it has no name in the digest."""
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, words), (None, words + " more"), (7, words)], "item_id long, text string")
    (row,) = decontam.scan(spark.createDataFrame([(1, "a " + words)], "doc_id long, text string"), items).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (13, 12, 2, plain.sha("7"))


def test_components(spark):
    """By rounds and in one step: the smallest node of each component."""
    import random

    from corpusloom.llm import graphs

    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    nodes, tops = graphs.roots(*(np.array(x) for x in zip(*edges)))
    want = {int(a): int(b) for a, b in zip(nodes, tops) if any(a in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for small in (0, graphs.SMALL):
        assert {x.id: x.label for x in graphs.components(df, small).collect()} == want
        assert graphs.components(df.limit(0), small).count() == 0

"""Retrieval queries: the vectors whose id is divisible by 100 ask, all vectors are the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import compression, feedback, late, latent, postings, vectors
from corpusloom.operators import retrieval as R

from corpusloom.sources.scratch import stored

from .registry import oracle, query

_EVERY = 100


def _asked(t):
    return t("embeddings").where(F.col("vec_id") % _EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _terms(t):
    """Questions are benchmark items by number, against the terms of all documents."""
    asked = R.term_weights(t("benchmark").where(F.col("item_id") % _EVERY == 0), "item_id", "text", "query_id")
    return asked, R.term_weights(t("documents"), "doc_id", "text")


def _fused(t):
    """All three legs.  All vectors stand for the people's too, so the people leg is the beginning of the dense one."""
    asked, index = _terms(t)
    dense = stored(R.dense_leg(_asked(t), _vectors(t)), "dense")  # read twice
    return R.fused(dense, R.sparse_leg(asked, index), dense.where(F.col("dense_rank") < R.K_PEOPLE))


_DENSE = """dense AS (
  SELECT query_id, id, score AS dense_score, rn - 1 AS dense_rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rn <= 30)"""
_PEOPLE = "people AS (SELECT query_id, id, dense_rank FROM dense WHERE dense_rank < 5)"
_SPARSE = """qt AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS qw FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark WHERE item_id % 100 = 0) WHERE term <> '' GROUP BY 1, 2),
dt AS (SELECT doc_id AS id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2),
sparse AS (
  SELECT query_id, id, score AS sparse_score, rn - 1 AS sparse_rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
      SELECT query_id, id, round(sum(qw * w), 6) AS score FROM qt JOIN dt USING (term) GROUP BY 1, 2)) WHERE rn <= 20)"""
_FUSED = """both_legs AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(CAST(d.id AS STRING), CAST(s.id AS STRING)) AS id, dense_rank, sparse_rank, CASE WHEN dense_rank IS NOT NULL THEN 0 ELSE 1 END AS source_no
  FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id
  UNION ALL SELECT query_id, 'tl:' || CAST(id AS STRING), dense_rank, NULL, 2 FROM people),
scored AS (SELECT *, round(0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + dense_rank + 1), 0.0) + coalesce(1.0::DOUBLE / (60 + sparse_rank + 1), 0.0), 6) AS rrf_score FROM both_legs),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, source_no, coalesce(dense_rank, sparse_rank), id) - 1 AS place FROM scored)"""


@query("hybrid_rrf_topk", oracle([], "SELECT query_id, id, rrf_score, place FROM fused WHERE place < 5", _DENSE, _PEOPLE, _SPARSE, _FUSED))
def hybrid_rrf_topk(t):
    """Dense, sparse and people legs fused; the five best a question."""
    return _fused(t).where("place < 5").select("query_id", "id", "rrf_score", "place")


@query("dense_topk", oracle([], "SELECT query_id, id, dense_rank, dense_score FROM dense", _DENSE))
def dense_topk(t):
    return R.dense_leg(_asked(t), _vectors(t))


@query("ann_topk")
def ann_topk(t):
    """The nearest vectors from the few cells that a question reads; tests measure its recall against ``dense_topk``."""
    return vectors.search(_asked(t), vectors.build(_vectors(t)))


@query("ann_exact_topk", oracle([], "SELECT query_id, id, dense_rank, dense_score FROM dense", _DENSE))
def ann_exact_topk(t):
    """The nearest vectors from the cells, and from all others that can hold nearer ones."""
    return vectors.search(_asked(t), vectors.build(_vectors(t)), exact=True)


@query("sparse_blocks_topk", oracle([], "SELECT query_id, id, sparse_rank, sparse_score FROM sparse", _SPARSE))
def sparse_blocks_topk(t):
    """As ``sparse_topk``, from an index that lets blocks be skipped."""
    asked = R.term_weights(t("benchmark").where(F.col("item_id") % _EVERY == 0), "item_id", "text", "query_id")
    return postings.search(asked, stored(postings.parted(postings.build(t("documents"), "doc_id", "text")), "postings", "part"))


@query("sparse_topk", oracle([], "SELECT query_id, id, sparse_rank, sparse_score FROM sparse", _SPARSE))
def sparse_topk(t):
    return R.sparse_leg(*_terms(t))


@query("multi_hypothesis_pool", oracle([], """SELECT question_id, id, rrf_score, row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, fq, fp, id) - 1 AS place FROM (
  SELECT query_id % 3 AS question_id, id, round(sum(rrf_score), 6) AS rrf_score, arg_min(query_id, query_id * 1000000 + place) AS fq, arg_min(place, query_id * 1000000 + place) AS fp FROM fused GROUP BY 1, 2)""", _DENSE, _PEOPLE, _SPARSE, _FUSED))
def multi_hypothesis_pool(t):
    """Three questions, each with several hypotheses."""
    return R.pooled(_fused(t).withColumn("question_id", F.col("query_id") % 3))


@query("rerank_fallback_cut", oracle([], "SELECT query_id, id, place FROM fused WHERE place < 10", _DENSE, _PEOPLE, _SPARSE, _FUSED))
def rerank_fallback_cut(t):
    return R.reranked(_fused(t)).select("query_id", "id", "place")


def _with_texts(t):
    docs = t("documents").select(F.col("doc_id").cast("string").alias("id"), "source", "text", "n_chars")
    return R.reranked(_fused(t), k=R.K_CONTEXT).join(docs, "id", "left")


@query("answer_sources", oracle([], "SELECT query_id, place, coalesce(source, '') AS title, coalesce(n_chars, 0) AS page, round(rrf_score, 4) AS rrf_score FROM fused f LEFT JOIN documents d ON f.id = CAST(d.doc_id AS STRING) WHERE place < 5", _DENSE, _PEOPLE, _SPARSE, _FUSED))
def answer_sources(t):
    return _with_texts(t).select("query_id", "place", F.coalesce("source", F.lit("")).alias("title"), F.coalesce("n_chars", F.lit(0)).alias("page"), F.round("rrf_score", 4).alias("rrf_score"))


@query("format_passage", """SELECT doc_id, '[Source ' || CAST(doc_id % 5 + 1 AS STRING) || ': ' || CASE WHEN lang <> 'en' THEN lang || ', ' ELSE '' END || source || CASE WHEN doc_id % 3 > 0 THEN ', ' || CAST(1900 + doc_id % 3 AS STRING) ELSE '' END
  || CASE WHEN n_chars % 50 > 0 THEN ', p. ' || CAST(n_chars % 50 AS STRING) ELSE '' END || ']' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '<context>' || source || '</context>' || chr(10) ELSE '' END || text AS passage FROM documents""")
def format_passage(t):
    d = t("documents")
    opt = lambda cond, c: F.when(cond, c)
    p = R.passage(F.col("doc_id") % 5 + 1, F.col("source"), F.lit("x.pdf"), opt(F.col("lang") != "en", F.col("lang")), opt(F.col("doc_id") % 3 > 0, 1900 + F.col("doc_id") % 3), F.col("n_chars") % 50, opt(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text"))
    return d.select("doc_id", p.alias("passage"))


@query("person_passage", oracle(["v_people"], """SELECT pid, '[Source 1: People timeline — ' || name || ' (' || CAST(birth_year AS STRING) || '–' || CAST(death_year AS STRING) || ')' || coalesce(' [Era ' || CAST(calculus_number AS STRING) || ']', '') || ']' || chr(10) || country AS passage FROM v_people"""))
def person_passage(t):
    return t("v_people").select("pid", R.person_passage(F.lit(1), F.col("name"), F.col("birth_year"), F.col("death_year"), F.col("calculus_number"), F.col("country")).alias("passage"))


@query("answer_fallback_text", oracle([], """SELECT query_id, 'LLM API unavailable. Top retrieved passages:' || chr(10) || chr(10) || string_agg('[' || CAST(place + 1 AS STRING) || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY place) AS answer
  FROM fused f LEFT JOIN documents d ON f.id = CAST(d.doc_id AS STRING) WHERE place < 3 GROUP BY query_id""", _DENSE, _PEOPLE, _SPARSE, _FUSED))
def answer_fallback_text(t):
    return R.fallback_answer(_with_texts(t).withColumn("text", F.coalesce("text", F.lit(""))))


_RM3 = """top AS (SELECT query_id, id, sparse_score AS s FROM sparse WHERE sparse_rank < 10),
topterms AS (SELECT query_id, id, s, term, w FROM top JOIN dt USING (id)),
rel AS (SELECT query_id, term, round(sum((s / all_s) * (w / size)), 9) AS p FROM topterms JOIN (SELECT query_id, id, sum(w) AS size FROM topterms GROUP BY 1, 2) USING (query_id, id) JOIN (SELECT query_id, sum(s) AS all_s FROM top GROUP BY 1) USING (query_id) GROUP BY 1, 2),
likely AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p DESC, term) <= 20),
mixed AS (SELECT query_id, term, 0.5::DOUBLE * qw / sum(qw) OVER (PARTITION BY query_id) AS w FROM qt UNION ALL SELECT query_id, term, 0.5::DOUBLE * p / sum(p) OVER (PARTITION BY query_id) FROM likely),
rm3 AS (SELECT query_id, term, round(sum(w), 9) AS weight FROM mixed GROUP BY 1, 2)"""


@query("rm3_expansion", oracle([], "SELECT query_id, term, weight FROM rm3", _SPARSE, _RM3))
def rm3_expansion(t):
    """The benchmark's questions with the terms that their first passages add."""
    asked, index = _terms(t)
    return feedback.rm3(asked, stored(R.sparse_leg(asked, index), "first-hits"), index)


@query("rm3_pool", oracle([], """SELECT query_id AS question_id, CAST(id AS STRING) AS id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, no, place, CAST(id AS STRING)) - 1 AS place FROM (
  SELECT query_id, id, round(sum(r), 6) AS rrf_score, arg_min(no, no * 1000000 + rn) AS no, arg_min(rn, no * 1000000 + rn) AS place FROM (
    SELECT query_id, id, no, rn, round(1.0::DOUBLE / (60 + rn + 1), 6) AS r FROM (
      SELECT query_id, id, 0 AS no, sparse_rank AS rn FROM sparse
      UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 FROM (SELECT query_id, id, round(sum(weight * w), 6) AS score FROM rm3 JOIN dt USING (term) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20))
  GROUP BY 1, 2)""", _SPARSE, _RM3))
def rm3_pool(t):
    """Each question as asked and as expanded, pooled."""
    return R.pooled(feedback.hypotheses(*_terms(t)))


@query("latent_vectors")
def latent_vectors(t):
    """Vectors of all documents in the space of their own words; tests hold it against the whole matrix's SVD."""
    docs = t("documents").select("doc_id", "text")
    return latent.learned(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


#: Vectors of the words of questions and of their candidates, from trigrams' hashes.
_LATE = """cand AS (SELECT query_id, id, sparse_rank, q.text AS question, d.text AS body FROM sparse JOIN benchmark q ON item_id = query_id JOIN documents d ON doc_id = id),
ws AS (SELECT DISTINCT unnest(string_split_regex(lower(question || ' ' || body), '[^a-z0-9]+')) AS w FROM cand),
grams AS (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('<' || w || '>', i, 3))) AS g FROM ws WHERE w <> ''),
signed AS (SELECT w, CAST('0x' || substr(md5(g), 1, 2) AS INT) % 64 AS i, CASE WHEN CAST('0x' || substr(md5(g), 3, 2) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM grams),
dims AS (SELECT w, i, sum(s)::DOUBLE AS x FROM signed GROUP BY 1, 2),
unit AS (SELECT w, i, x / sqrt(sum(x * x) OVER (PARTITION BY w)) AS x FROM dims QUALIFY sum(x * x) OVER (PARTITION BY w) > 0),
asked AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(question), '[^a-z0-9]+')) AS qw FROM cand),
there AS (SELECT DISTINCT query_id, id, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS dw FROM cand),
words AS (SELECT DISTINCT qw, dw FROM asked JOIN there USING (query_id) WHERE qw <> '' AND dw <> ''),
cos AS (SELECT qw, dw, sum(a.x * b.x) AS c FROM words JOIN unit a ON a.w = qw JOIN unit b ON b.w = dw AND b.i = a.i GROUP BY 1, 2),
best AS (SELECT query_id, id, qw, max(coalesce(c, 0)) AS c FROM asked JOIN there USING (query_id) LEFT JOIN cos USING (qw, dw) WHERE qw <> '' AND dw <> '' GROUP BY 1, 2, 3),
late AS (SELECT query_id, id, sparse_rank, coalesce(round(s, 6), 0.0) AS rerank_score FROM cand LEFT JOIN (SELECT query_id, id, avg(c) AS s FROM best GROUP BY 1, 2) USING (query_id, id))"""


@query("rerank_topk", oracle([], "SELECT query_id, id, sparse_rank AS fused_place, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, sparse_rank) - 1 AS place FROM late QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, sparse_rank) <= 10", _SPARSE, _LATE))
def rerank_topk(t):
    """What the sparse leg finds for the benchmark's questions, put in order by late interaction."""
    found = R.sparse_leg(*_terms(t)).select("query_id", "id", F.col("sparse_rank").alias("place"))
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return late.reranked(found, questions, t("documents").select(F.col("doc_id").alias("id"), "text"))


_COMPRESSED = """toks AS (SELECT doc_id, w AS token, lower(w) AS w, i - 1 AS pos, CASE WHEN i > 1 THEN lower(l[i - 1]) ELSE '' END AS v FROM (SELECT doc_id, l, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents))),
model AS (SELECT v, w, count(*) AS n FROM toks GROUP BY 1, 2),
after AS (SELECT v, sum(n) AS after, count(*) AS kinds FROM model GROUP BY 1),
befor AS (SELECT w, count(*) AS follows FROM model GROUP BY 1),
info AS (SELECT v, w, round(-log2(greatest(n - 0.75::DOUBLE, 0.0) / after + 0.75::DOUBLE * kinds / after * (follows::DOUBLE / (SELECT count(*) FROM model))), 6) AS info FROM model JOIN after USING (v) JOIN befor USING (w)),
passage AS (SELECT query_id, doc_id, text FROM sparse JOIN documents ON doc_id = id WHERE sparse_rank < 5),
ranked AS (SELECT query_id, doc_id, pos, token, count(*) OVER (PARTITION BY query_id, doc_id) AS n, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY info DESC, pos) AS r FROM passage JOIN toks USING (doc_id) JOIN info USING (v, w) WHERE length(text) >= 200)"""


@query("compressed_passages", oracle([], """SELECT query_id, doc_id AS id, CAST(max(n) AS INT) AS n_words, CAST(count(*) AS INT) AS kept, string_agg(token, ' ' ORDER BY pos) AS compressed FROM ranked WHERE r <= ceil(n * 0.25::DOUBLE) GROUP BY 1, 2
  UNION ALL SELECT query_id, doc_id, CAST(c AS INT), CAST(c AS INT), text FROM (SELECT *, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS c FROM passage) WHERE length(text) < 200 OR c = 0""", _SPARSE, _COMPRESSED))
def compressed_passages(t):
    """The passages that an answer is made from, cut to a quarter of their words by a model of all documents."""
    found = stored(R.sparse_leg(*_terms(t)).where(F.col("sparse_rank") < R.K_CONTEXT).select("query_id", "id"), "found")
    passages = found.join(t("documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return compression.compressed(passages, ["query_id", "id"], "text", stored(compression.counts(t("documents"), "text"), "pairs"))


#: Vectors of the people's texts and of the questions, as sums of their words' vectors.
_PEOPLE_VECTORS = """said AS (SELECT 'p' AS side, pid AS k, name || ' ' || coalesce(field, '') || ' ' || coalesce(country, '') AS t FROM v_people UNION ALL SELECT 'q', vec_id, label || ' ' || coalesce(n, '') FROM (SELECT c_custkey AS vec_id, c_mktsegment AS label, 'person ' || CAST(c_custkey % 700 AS STRING) AS n FROM customer WHERE c_custkey % 100 = 0)),
tok AS (SELECT side, k, w, count(*) AS c FROM (SELECT side, k, unnest(string_split_regex(lower(t), '[^a-z0-9]+')) AS w FROM said) WHERE w <> '' GROUP BY ALL),
gram AS (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('<' || w || '>', i, 3))) AS g FROM (SELECT DISTINCT w FROM tok)),
wdim AS (SELECT w, CAST('0x' || substr(md5(g), 1, 2) AS INT) % 64 AS i, sum(CASE WHEN CAST('0x' || substr(md5(g), 3, 2) AS INT) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM gram GROUP BY 1, 2),
wunit AS (SELECT w, i, x / sqrt(sum(x * x) OVER (PARTITION BY w)) AS x FROM wdim QUALIFY sum(x * x) OVER (PARTITION BY w) > 0),
tdim AS (SELECT side, k, i, sum(c * x) AS x FROM tok JOIN wunit USING (w) GROUP BY 1, 2, 3),
tunit AS (SELECT side, k, i, x / sqrt(sum(x * x) OVER (PARTITION BY side, k)) AS x FROM tdim)"""


@query("people_leg_topk", oracle(["v_people"], """SELECT query_id, id, dense_rank, dense_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, id) - 1 AS INT) AS dense_rank FROM (
  SELECT q.k AS query_id, p.k AS id, round(sum(q.x * p.x), 6) + 0.0 AS dense_score FROM tunit q JOIN tunit p ON q.side = 'q' AND p.side = 'p' AND q.i = p.i GROUP BY 1, 2)) WHERE dense_rank < 5""", _PEOPLE_VECTORS))
def people_leg_topk(t):
    """The people nearest to questions about them: vectors of their own texts, searched as documents' are."""
    p = t("v_people").select("pid", F.concat_ws(" ", "name", "field", "country").alias("t"))
    q = t("customer").where("c_custkey % 100 = 0").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit(" person "), (F.col("c_custkey") % 700).cast("string")).alias("t"))
    return R.dense_leg(late.text_vectors(q, "c_custkey", "t").withColumnRenamed("id", "query_id"), late.text_vectors(p, "pid", "t"), R.K_PEOPLE)

"""Text queries: normalising, sentences, tokens, chunks, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import providers
from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import language
from corpusloom.operators import vocabulary as V

from .registry import oracle, query

_PAGE = """regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '\\n{{2,}}', chr(1), 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\n', ' ', 'g'), chr(1), chr(10) || chr(10)), '  +', ' ', 'g'), '^\\s+', ''), '\\s+$', '')"""


def _broken(t):
    """Documents with hyphen breaks and blank lines put in."""
    x = F.regexp_replace(F.regexp_replace("text", r"th(\p{L})", "th-\n$1"), r"\. ", ".\n\n")
    return t("documents").select("doc_id", x.alias("text"))


_BROKEN = r"broken AS (SELECT doc_id, regexp_replace(regexp_replace(text, 'th(\p{L})', 'th-' || chr(10) || '\1', 'g'), '\. ', '.' || chr(10) || chr(10), 'g') AS text FROM documents)"


@query("page_normalise", oracle([], f"SELECT doc_id, {_PAGE.format('text')} AS text FROM broken", _BROKEN))
def page_normalise(t):
    return _broken(t).select("doc_id", T.page_text(F.col("text")).alias("text"))


@query("text_differs", oracle([], "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', '  ') ELSE text || 'x' END, '\\s+', ' ', 'g')) AS differs FROM documents"))
def text_differs(t):
    other = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.concat("text", F.lit("x")))
    return t("documents").select("doc_id", T.differs(F.col("text"), other).alias("differs"))


def _sentences_sql(text: str) -> str:
    """A list of sentences: breaks are marked by a private character, and those after abbreviations taken back, twice as matches that touch leave every other one."""
    marked = f"""regexp_replace(regexp_replace({text}, '\\n{{2,}}', chr(57344), 'g'), '([.!?])\\s+([A-ZÀ-ɏ\\d"‘“])', '\\1' || chr(57344) || '\\2', 'g')"""
    pieces = f"array_to_string(list_filter(list_transform(string_split({marked}, chr(57344)), lambda p: regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', '')), lambda p: p <> ''), chr(57344))"
    back = lambda x: f"regexp_replace({x}, '(^|[^0-9A-Za-z_À-ɏ])((?:{'|'.join(T.ABBREVIATIONS)}|[A-Z])\\n?\\.*)' || chr(57344), '\\1\\2 ', 'g')"
    return f"list_filter(string_split({back(back(pieces))}, chr(57344)), lambda p: p <> '')"


@query("split_sentences", f"SELECT doc_id, unnest(generate_series(1, len(l))) - 1 AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {_sentences_sql('text')} AS l FROM documents)")
def split_sentences(t):
    """Sentences of whole documents."""
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("sentence_breaks", """SELECT doc_id, len(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '([.!?])\\s+([A-ZÀ-ɏ\\d"‘“])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS parts FROM documents""")
def sentence_breaks(t):
    """Places where a sentence may end, before abbreviations are looked at."""
    parts = F.split(T.strip(F.col("text")), "(?U)(?<=[.!?])\\s+(?=[A-ZÀ-ɏ\\d\"‘“])")
    return t("documents").select("doc_id", F.size(parts).cast("long").alias("parts"))


@query("token_count", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 4 // 3 AS INT) AS n_tokens FROM documents")
def token_count(t):
    return t("documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("short_chunk_filter", "SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 80")
def short_chunk_filter(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length("line") >= T.MIN_CHUNK_CHARS).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def _paged(t):
    pages = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("page"), x.alias("text")))
    return t("documents").select(F.col("doc_id").cast("string").alias("source_file_id"), pages.alias("pages"), "lang")


def _numbered(name: str, of: str, key: str, *more: str) -> str:
    """CTE of sentences (``key``, ``s``, order ``o``) with numbers, tokens ``n`` and the tokens ``p`` and characters ``c`` before them."""
    return f"""{name} AS (SELECT *, CAST(coalesce(sum(n) OVER w, 0) AS INT) AS p, CAST(coalesce(sum(length(s)) OVER w, 0) AS INT) AS c, CAST(row_number() OVER (PARTITION BY {key} ORDER BY o) - 1 AS INT) AS i
  FROM (SELECT *, len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) * 4 // 3 AS n FROM {of}) WINDOW w AS (PARTITION BY {key} ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _runs(name: str, of: str, key: str, limit: int, start: str) -> str:
    """CTE of runs (``key``, ``a`` to ``b``, number ``y``): sentence by sentence, a run that would pass the limit ends and the next begins at ``start``."""
    keys = ", ".join(f"x.{k.strip()}" for k in key.split(","))
    on = " AND ".join(f"x.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    over = f"(x.i > r.a AND x.p + x.n - r.p > {limit})"
    return f"""{name}_at AS (
  SELECT {key}, 0 AS i, 0 AS a, 0 AS p, 0 AS c, 0 AS y, false AS done, 0 AS b FROM {of} WHERE i = 0
  UNION ALL
  SELECT {keys}, x.i + 1, CASE WHEN {over} THEN {start} ELSE r.a END, CASE WHEN {over} THEN f.p ELSE r.p END, CASE WHEN {over} THEN f.c ELSE r.c END, r.y + CASE WHEN {over} THEN 1 ELSE 0 END, {over}, r.a
  FROM {name}_at r JOIN {of} x ON {on} AND x.i = r.i JOIN {of} f ON {on.replace('x.', 'f.')} AND f.i = CASE WHEN {over} THEN {start} ELSE r.a END),
{name} AS (
  SELECT {key}, b AS a, i - 2 AS b, y - 1 AS y FROM {name}_at WHERE done
  UNION ALL SELECT {key}, a, i - 1, y FROM {name}_at QUALIFY i = max(i) OVER (PARTITION BY {key})),
{name}_text AS (
  SELECT {key}, y, arg_min(page, i) AS page, arg_min(lang, i) AS lang, text, a FROM (
    SELECT {keys}, r.y, r.a, x.i, x.page, x.lang, string_agg(x.s, ' ') OVER (PARTITION BY {keys}, r.y ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text FROM {name} r JOIN {of} x ON {on} AND x.i BETWEEN r.a AND r.b)
  GROUP BY {key}, y, a, text HAVING length(text) >= 80)"""


CHUNKS_SQL = "WITH RECURSIVE " + ",\n".join((
    "lines AS (SELECT CAST(doc_id AS STRING) AS k, lang, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INT) AS page, unnest(string_split(text, chr(10))) AS line FROM documents)",
    f"split AS (SELECT k, lang, page, unnest(l) AS s, unnest(generate_series(1, len(l))) AS j FROM (SELECT k, lang, page, {_sentences_sql('line')} AS l FROM lines))",
    _numbered("first", "(SELECT *, page * 1000000 + j AS o FROM split)", "k"),
    # the sentences of at most 32 tokens together before each
    "whole AS (SELECT *, CAST(min(i) OVER (PARTITION BY k ORDER BY p RANGE BETWEEN 32 PRECEDING AND CURRENT ROW) AS INT) AS back FROM first)",
    _runs("parents", "whole", "k", C.PARENT_TOKENS, "CASE WHEN x.c - r.c + x.i - r.a - 1 >= 80 THEN greatest(x.back, r.a) ELSE r.a END"),
    f"again AS (SELECT k, y AS parent, page, lang, unnest(l) AS s, unnest(generate_series(1, len(l))) AS o FROM (SELECT k, y, page, lang, {_sentences_sql('text')} AS l FROM parents_text))",
    _numbered("second", "again", "k, parent"),
    _runs("children", "second", "k, parent", C.CHILD_TOKENS, "x.i - 1"),
    "numbered AS (SELECT *, parent * 1000 + row_number() OVER (PARTITION BY k, parent ORDER BY a, y) - 1 AS num FROM children_text)",
    """chunks AS (
  SELECT left(sha256(concat_ws(chr(1), k, 'parent', y)), 32) AS id, k AS source_file_id, CAST(y AS INT) AS passage_index, 'parent' AS level, CAST(NULL AS STRING) AS parent_id, text, lang AS language_detected, page AS page_number FROM parents_text
  UNION ALL SELECT left(sha256(concat_ws(chr(1), k, 'child', num)), 32), k, CAST(num AS INT), 'child', left(sha256(concat_ws(chr(1), k, 'parent', parent)), 32), text, lang, page FROM numbered)""",
    "counted AS (SELECT *, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 4 // 3 AS INT) AS token_count FROM chunks)",
))


@query("chunk_parents", CHUNKS_SQL + "\nSELECT * FROM counted WHERE level = 'parent'")
def chunk_parents(t):
    return C.chunk(_paged(t)).where("level = 'parent'")


@query("chunk_children", CHUNKS_SQL + "\nSELECT * FROM counted QUALIFY level = 'child' OR NOT bool_or(level = 'child') OVER (PARTITION BY source_file_id)")
def chunk_children(t):
    return C.indexed_chunks(C.chunk(_paged(t)))


@query("document_identity", oracle(["v_files"], "SELECT doc_id, concat_ws(' — ', CAST(doc_id AS STRING) || '.pdf', CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN lang <> 'en' THEN 'by ' || lang END, CASE WHEN doc_id % 3 > 0 THEN CAST(1900 + doc_id % 3 AS STRING) END) AS identity FROM v_files"))
def document_identity(t):
    d = t("v_files")
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string"))
    return d.select("doc_id", T.document_identity(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), title, F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), F.when(F.col("doc_id") % 3 > 0, 1900 + F.col("doc_id") % 3)).alias("identity"))


_CONTEXT = """ctx AS (SELECT doc_id, 'From: ' || concat_ws(', ', CASE WHEN lang <> 'en' THEN lang END, CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(doc_id AS STRING) END, CASE WHEN doc_id % 3 > 0 THEN '(' || CAST(1900 + doc_id % 3 AS STRING) || ')' END)
  || CASE WHEN doc_id % 4 > 0 THEN ', p. ' || CAST(doc_id % 4 AS STRING) || CASE WHEN n_chars % 9 > 0 THEN ' of ' || CAST(n_chars % 9 AS STRING) ELSE '' END ELSE '' END || '.' AS context, text FROM documents)"""


def _context(t):
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    ctx = providers.get("context", "metadata")(title=title, author=F.when(F.col("lang") != "en", F.col("lang")), year=F.when(F.col("doc_id") % 3 > 0, 1900 + F.col("doc_id") % 3), page=F.col("doc_id") % 4, pages=F.col("n_chars") % 9, file_name=F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
    return t("documents").select("doc_id", ctx.alias("context"), "text")


@query("chunk_context", oracle([], "SELECT doc_id, context FROM ctx", _CONTEXT))
def chunk_context(t):
    return _context(t).select("doc_id", "context")


@query("embed_text", oracle([], "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN context || chr(10) || chr(10) || text ELSE text END AS embedded FROM ctx", _CONTEXT))
def embed_text(t):
    return _context(t).select("doc_id", T.embedded_text(F.when(F.col("doc_id") % 5 > 0, F.col("context")), F.col("text")).alias("embedded"))


@query("scanned_test", "SELECT page_id, length(html) * 0.2::DOUBLE < page_id % 3 * 0.3::DOUBLE * length(html) OR page_id % 3 = 0 AS scanned FROM pages")
def scanned_test(t):
    n = F.length("html")
    return t("pages").select("page_id", T.is_scanned(n * 0.2, n * (F.col("page_id") % 3)).alias("scanned"))


@query("vocabulary_sections", oracle([], """SELECT doc_id, section, dense_rank() OVER (PARTITION BY doc_id, section ORDER BY island) AS group_no, row_number() OVER (PARTITION BY doc_id, section ORDER BY n) AS pos, tag FROM (
  SELECT doc_id, n, tag, opens, last_value(opens IGNORE NULLS) OVER w AS section, sum(CASE WHEN tag = '' OR opens IS NOT NULL THEN 1 ELSE 0 END) OVER w AS island FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING))
  WHERE section IS NOT NULL AND opens IS NULL AND tag <> ''""",
  """lines AS (SELECT doc_id, n, trim(line) AS tag, CASE WHEN starts_with(trim(line), 'Th') THEN 'th' WHEN starts_with(trim(line), 'On') THEN 'on' END AS opens FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 AS n, CASE WHEN length(l) % 3 = 0 THEN '' ELSE l END AS line FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS g FROM documents) WHERE false) WHERE false
  UNION ALL SELECT doc_id, g - 1, trim(CASE WHEN length(l) % 3 = 0 THEN '' ELSE l END), CASE WHEN length(l) % 3 = 0 THEN NULL WHEN starts_with(trim(l), 'Th') THEN 'th' WHEN starts_with(trim(l), 'On') THEN 'on' END FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS g FROM documents))"""))  # fmt: skip
def vocabulary_sections(t):
    """Lines of documents as a vocabulary file: headings by their beginning, every third length a blank line."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.when(F.length("line") % 3 == 0, "").otherwise(F.col("line")))
    return V.sections(lines, {"Th": "th", "On": "on"}, ["doc_id"]).select("doc_id", "section", F.col("group_no").cast("long").alias("group_no"), F.col("pos").cast("long").alias("pos"), "tag")


@query("tex_escape", """SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c IN ('&', '%', '$', '#', '_', '{', '}') THEN '\\' || c WHEN c = '~' THEN '\\textasciitilde{}' WHEN c = '^' THEN '\\textasciicircum{}' WHEN c = '\\' THEN '\\textbackslash{}' ELSE c END), '') AS tex FROM documents""")
def tex_escape(t):
    return t("documents").select("doc_id", T.tex(F.col("text")).alias("tex"))


@query("file_sizes", """SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.1f', s::DOUBLE) || ' B' WHEN s < 1048576 THEN printf('%.1f', floor(s / 1024)) || ' KB' WHEN s < 1073741824 THEN printf('%.1f', floor(s / 1048576)) || ' MB' ELSE printf('%.1f', floor(s / 1073741824)) || ' GB' END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 3 * 1000) * (1 + doc_id % 5 * 700) AS s FROM documents)""")
def file_sizes(t):
    return t("documents").select("doc_id", T.file_size(F.col("n_chars") * (1 + F.col("doc_id") % 3 * 1000) * (1 + F.col("doc_id") % 5 * 700)).alias("size"))


def _guess_sql() -> str:
    score = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS {lang}" for lang, words in providers.STOP_WORDS.items())
    others = " ".join(f"WHEN {x} = best AND en < best THEN '{x}'" for x in providers.STOP_WORDS if x != "en")
    return f"""SELECT doc_id, lang, CASE {others} ELSE 'en' END AS guess FROM (SELECT *, greatest({', '.join(providers.STOP_WORDS)}) AS best FROM (
  SELECT doc_id, lang, {score} FROM (SELECT doc_id, lang, string_split_regex(lower(text), '[^\\pL\\pM\\pN\\p{{Pc}}]+') AS w FROM documents)))"""


@query("language_guess", _guess_sql())
def language_guess(t):
    """The offline language scorer over whole tables and whole texts."""
    return t("documents").select("doc_id", "lang", providers.get("language")(F.col("text"), first=None).alias("guess"))


_LANGUAGE = """ch AS (SELECT doc_id, lang, doc_id % 3 = 1 AS held_out, string_split(regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[\\x20\\x09-\\x0D]+', ' ', 'g'), '') AS c FROM documents),
gr AS (SELECT doc_id, lang, held_out, ((unicode(c[i])::BIGINT * 4398046511104) + unicode(c[i + 1])::BIGINT * 2097152 + unicode(c[i + 2])::BIGINT) % 262139 AS b FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM ch)),
cnt AS (SELECT lang, b, count(*) AS n FROM gr WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT lang, sum(n) AS n FROM cnt GROUP BY 1),
pri AS (SELECT lang AS l, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS p FROM documents WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY 1),
per AS (SELECT doc_id, b, count(*) AS k FROM gr GROUP BY 1, 2),
sco AS (SELECT doc_id, tot.lang AS l, sum(k * ln((coalesce(cnt.n, 0) + 1)::DOUBLE / (tot.n + 262139)::DOUBLE)) AS s FROM per CROSS JOIN tot LEFT JOIN cnt ON cnt.b = per.b AND cnt.lang = tot.lang GROUP BY 1, 2),
whole AS (SELECT d.doc_id, d.lang, d.doc_id % 3 = 1 AS held_out, l, round(p + coalesce(s, 0), 4) AS score FROM documents d CROSS JOIN pri LEFT JOIN sco USING (doc_id, l))"""


@query("language_model", oracle([], "SELECT doc_id, lang, held_out, l AS guess, score FROM whole QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, l) = 1", _LANGUAGE))
def language_model(t):
    """Languages by trigrams, learned from two thirds of the documents and told of all."""
    docs = t("documents").select("doc_id", "lang", (F.col("doc_id") % 3 == 1).alias("held_out"), "text")
    return language.guessed(docs, language.learn(docs.where(~F.col("held_out"))))

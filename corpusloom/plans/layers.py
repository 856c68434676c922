"""Layered-document queries: each document is one, each of its lines a block of the page."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import TEX
from corpusloom.operators import layers as L

from .registry import query

_LINES = """WITH lines AS (SELECT doc_id, lang, unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 AS seq, unnest(string_split(text, chr(10))) AS text FROM documents),
geo AS (SELECT *, (seq * 7 + doc_id) % 100 * 8 AS y0, (seq * 7 + doc_id) % 100 * 8 + 20 AS y1, CASE WHEN seq % 9 = 4 THEN 10 ELSE 80 END AS x0, CASE WHEN seq % 9 = 4 THEN 90 ELSE 500 END AS x1, 7.0::DOUBLE + (length(text) + doc_id) % 9 AS size, CASE WHEN seq % 2 = 0 THEN 16 ELSE 0 END AS flags FROM lines),
regions AS (SELECT *, CASE WHEN y1 < 64 OR y0 > 736 THEN 'running_title' WHEN trim(text) = '' THEN 'paragraph' WHEN size <= 8.5 AND y0 > 560 THEN 'footnote' WHEN size <= 7.5 THEN 'footnote' WHEN size >= 14 THEN 'heading' WHEN size >= 11.5 AND flags = 16 THEN 'subheading'
  WHEN x1 - x0 < 132 AND (x0 < 42 OR x1 > 558) THEN 'margin_note' WHEN size <= 9.5 AND regexp_matches(lower(text), '^(fig\\.|table|plate|tableau)\\s') THEN 'caption' ELSE 'paragraph' END AS region_type FROM geo)
"""


def _regions(t):
    r = t("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    y0 = (F.col("seq") * 7 + F.col("doc_id")) % 100 * 8
    narrow = F.col("seq") % 9 == 4
    box = {"y0": y0, "y1": y0 + 20, "x0": F.when(narrow, 10).otherwise(80), "x1": F.when(narrow, 90).otherwise(500)}
    size = (F.lit(7.0) + (F.length("text") + F.col("doc_id")) % 9).cast("double")
    spans = F.array(F.struct(F.col("text").alias("text"), size.alias("size"), F.when(F.col("seq") % 2 == 0, 16).otherwise(0).alias("flags")))
    r = r.withColumn("region_type", L.region_type(box, F.lit(600), F.lit(800), spans))
    return r.select("doc_id", F.col("seq").cast("long").alias("seq"), F.concat_ws("-", "doc_id", "seq").alias("region_id"), "region_type", "text", "lang")


def _layers(t):
    return L.text_layers(_regions(t), F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang")))


@query("region_classify", _LINES + "SELECT doc_id, seq, region_type FROM regions")
def region_classify(t):
    return _regions(t).select("doc_id", "seq", "region_type")


@query("region_layers", _LINES + """SELECT doc_id, seq, diplomatic, normalized, CASE WHEN lang = 'en' THEN normalized ELSE '' END AS translation FROM (SELECT doc_id, lang, seq, text AS diplomatic, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS normalized FROM regions)""")
def region_layers(t):
    p = L.pivoted(_layers(t))
    return p.select(F.split("region_id", "-")[0].cast("long").alias("doc_id"), F.split("region_id", "-")[1].cast("long").alias("seq"), *L.LAYERS)


@query("layer_coverage", _LINES + "SELECT doc_id, count(*) AS diplomatic, count(*) AS normalized, count(*) AS translation FROM regions GROUP BY 1")
def layer_coverage(t):
    return L.layer_counts(_layers(t), "doc_id")


@query("uncovered_regions", _LINES + "SELECT CAST(doc_id AS STRING) || '-' || CAST(seq AS STRING) AS region_id, 2::BIGINT AS n FROM regions WHERE seq % 5 = 2")
def uncovered_regions(t):
    kept = _layers(t).where(~((F.col("seq") % 5 == 2) & (F.col("layer_type") == "translation")))
    return L.uncovered(kept)


@query("template_choice", _LINES + "SELECT doc_id, count(*) AS n_regions, CASE WHEN count(*) > 400 THEN 'memoir' WHEN bool_or(region_type IN ('footnote', 'margin_note')) THEN 'reledpar' ELSE 'article' END AS template FROM regions GROUP BY 1")
def template_choice(t):
    return L.template(_regions(t), "doc_id")


def _tex_sql(text: str) -> str:
    escapes = " ".join(f"WHEN '{c}' THEN '{e}'" for c, e in TEX.items())
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE c {escapes} ELSE c END), '')"


_LATEX = _LINES.rstrip() + f""",
r AS (
  SELECT *, {_tex_sql("b")} AS tb, CASE WHEN d <> '' AND n <> '' AND d2 <> n2 THEN '\\footnote{{Diplomatic: ' || {_tex_sql("d")} || '}}' ELSE '' END AS note FROM (
    SELECT *, CASE WHEN n <> '' THEN n ELSE d END AS b, regexp_replace(d, '\\s+', ' ', 'g') AS d2, regexp_replace(n, '\\s+', ' ', 'g') AS n2 FROM (
      SELECT doc_id, seq, region_type, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS d, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS n FROM regions))
  WHERE (n <> '' OR d <> '') AND region_type <> 'running_title'),
f AS (SELECT *, first_value(CASE WHEN region_type = 'paragraph' THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS goes FROM r),
inl AS (SELECT doc_id, goes AS seq, string_agg('\\footnote{{[Author''s note] ' || tb || '}}', '' ORDER BY seq) AS x FROM f WHERE region_type = 'footnote' AND goes IS NOT NULL GROUP BY ALL),
body AS (
  SELECT doc_id, 0 AS late, seq, CASE region_type WHEN 'heading' THEN '\\section{{' || tb || '}}' WHEN 'subheading' THEN '\\subsection{{' || tb || '}}' WHEN 'margin_note' THEN '\\marginnote{{' || tb || '}}' WHEN 'caption' THEN '\\caption{{' || tb || '}}' ELSE tb || note || coalesce(x, '') || chr(10) END AS line
  FROM f LEFT JOIN inl USING (doc_id, seq) WHERE region_type <> 'footnote'
  UNION ALL SELECT doc_id, 1, seq, '\\footnote{{[Author''s note] ' || {_tex_sql("tb")} || '}}' FROM f WHERE region_type = 'footnote' AND goes IS NULL)
SELECT doc_id, string_agg(line, chr(10) ORDER BY late, seq) AS body FROM body GROUP BY doc_id"""


@query("latex_body", _LATEX)
def latex_body(t):
    """LaTeX bodies of all documents."""
    r = _regions(t)
    return L.latex_body(r.join(L.pivoted(_layers(t)), "region_id"))

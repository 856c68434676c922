"""Readers and writers over the tables: what is written to a new folder and read back, and small shapes of documents and rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import unicode as U
from corpusloom.operators import entities as E
from corpusloom.operators import layers as L
from corpusloom.operators import people as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import views as W
from corpusloom.operators import vocabulary as V
from corpusloom.sources import files as SF
from corpusloom.sources import json as SJ
from corpusloom.sources import scratch, sinks

from .registry import oracle, query


def _spark(df):
    return df.sparkSession, scratch.folder(df.sparkSession, "roundtrip")


# --- files ---------------------------------------------------------------------------


def _contents(t):
    return t("v_files").select("path", F.encode("text", "UTF-8").alias("content"))


@query("file_hashes", oracle(["v_files"], "SELECT path, sha256(text) AS hash FROM v_files"))
def file_hashes(t):
    return SF.hashed(_contents(t)).select("path", "hash")


@query("text_beginnings", oracle(["v_files"], "SELECT path, CASE WHEN trim(substr(text, 1, 6000), chr(32) || chr(9) || chr(10) || chr(13)) <> '' THEN trim(substr(text, 1, 6000), chr(32) || chr(9) || chr(10) || chr(13)) END AS text FROM v_files"))
def text_beginnings(t):
    return SF.texts(_contents(t))


# --- writers --------------------------------------------------------------------------


@query("sink_replaced_chunks", "SELECT source AS source_file_id, CASE WHEN source IN (SELECT source FROM documents WHERE doc_id % 50 = 7) THEN 'new ' ELSE '' END || CAST(doc_id AS STRING) AS text FROM documents")
def sink_replaced_chunks(t):
    """Chunks by source; the sources that came again have theirs replaced, the others stay."""
    docs = t("documents")
    spark, path = _spark(docs)
    sinks.replace_files(docs.select(F.col("source").alias("source_file_id"), F.col("doc_id").cast("string").alias("text")), path)
    again = docs.join(docs.where("doc_id % 50 = 7").select("source").distinct(), "source", "left_semi")
    sinks.replace_files(again.select(F.col("source").alias("source_file_id"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("text")), path)
    return spark.read.schema("text string, source_file_id string").parquet(path)


@query("sink_routed_feeds", "SELECT event_type AS record_type, event_id, value FROM events UNION ALL SELECT event_type, event_id, value FROM events WHERE event_id % 10 = 3")
def sink_routed_feeds(t):
    """Records to a folder a kind, and a second batch appended."""
    rows = t("events").select(F.col("event_type").alias("record_type"), "event_id", "value")
    spark, path = _spark(rows)
    sinks.route_json(rows, path)
    sinks.route_json(rows.where("event_id % 10 = 3"), path)
    return spark.read.schema("event_id long, value double, record_type string").json(path)


@query("sink_appended_lines", "SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0")
def sink_appended_lines(t):
    rows = t("embeddings").select("vec_id", "label")
    spark, path = _spark(rows)
    sinks.append_json(rows, path)
    sinks.append_json(rows.where("vec_id % 3 = 0"), path)
    return spark.read.schema("vec_id long, label int").json(path)


@query("enriched_parts", oracle(["v_people"], """SELECT part, count(*) AS n, count(DISTINCT record) AS unlike FROM (
  SELECT 'people' AS part, CAST(pid AS STRING) AS record FROM v_people UNION ALL SELECT 'suggested_tags_registry', country FROM v_people GROUP BY ALL UNION ALL SELECT 'suggested_people_registry', name FROM v_people WHERE pid % 9 = 0 UNION ALL SELECT 'ai_relationships', CAST(pid AS STRING) FROM v_people WHERE pid % 4 = 0) GROUP BY part"""))
def enriched_parts(t):
    """The enriched roster's parts written as lines and read back."""
    p = t("v_people")
    spark, path = _spark(p)
    sinks.enriched(p.select("pid", "name", "birth_year"), p.select("country").distinct(), p.where("pid % 9 = 0").select("name"), p.where("pid % 4 = 0").select("pid")).write.partitionBy("part").text(path)
    lines = spark.read.schema("value string, part string").text(path)
    return lines.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("value").alias("unlike"))


@query("json_roster", oracle(["v_people"], "SELECT name, birth_year FROM v_people"))
def json_roster(t):
    """Rosters as JSON documents, one a country, a list or an object with a list, read back as rows."""
    p = t("v_people").select("country", F.struct("name", "birth_year").alias("p")).groupBy("country").agg(F.collect_list("p").alias("people"))
    spark, path = _spark(p)
    listed = F.to_json("people")
    body = F.when(F.length("country") % 2 == 0, listed).otherwise(F.concat(F.lit('﻿{"people": '), listed, F.lit("}")))
    p.select(F.regexp_replace("country", "[^A-Za-z0-9]", "_").alias("name"), body.alias("value")).repartition("name").write.partitionBy("name").text(path)
    return SJ.people(spark, f"{path}/*/*.txt", "name: string, birth_year: int")


@query("response_objects", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM events")
def response_objects(t):
    """Model answers as lines, fenced lists and no JSON at all."""
    v = F.to_json(F.struct("event_id", "value"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n["), v, F.lit(","), v, F.lit("]\n```"))).when(F.col("event_id") % 3 == 1, F.concat(v, F.lit("\nnot json\n"))).otherwise("no answer")
    return t("events").select("event_id", F.size(SJ.response_lines(raw)).alias("n"))


# --- shapes ---------------------------------------------------------------------------


@query("compact_names", oracle(["v_people"], """SELECT country, CASE WHEN count(*) <= 20 THEN CAST(to_json(list(name ORDER BY ord)) AS STRING) ELSE CAST(to_json(list(name ORDER BY ord)[1:20]) AS STRING) || chr(10) || '// ... and ' || CAST(count(*) - 20 AS STRING) || ' more' END AS names FROM v_people GROUP BY country"""))
def compact_names(t):
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return t("v_people").groupBy("country").agg(names.alias("l")).select("country", T.compact_names(F.col("l"), 20).alias("names"))


@query("short_models", "SELECT vec_id, 'm' || CAST(label AS STRING) AS model FROM embeddings")
def short_models(t):
    full = F.concat(F.lit("maker/part/m"), F.col("label").cast("string"), F.when(F.col("vec_id") % 2 == 0, ":free").otherwise(""))
    return t("embeddings").select("vec_id", T.short_model(full).alias("model"))


@query("graph_person_ids", oracle(["v_people"], "SELECT pid, CASE WHEN pid % 4 = 0 THEN 'own-' || CAST(pid AS STRING) ELSE regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || coalesce(CAST(CASE WHEN pid % 3 > 0 THEN birth_year END AS STRING), 'unknown') END AS id FROM v_people"))
def graph_person_ids(t):
    own = F.when(F.col("pid") % 4 == 0, F.concat(F.lit("own-"), F.col("pid").cast("string"))).otherwise("")
    return t("v_people").select("pid", U.graph_person_id(own, F.col("name"), F.when(F.col("pid") % 3 > 0, F.col("birth_year"))).alias("id"))


_BLOCKS = """lines AS (SELECT doc_id, unnest(generate_series(1, len(l))) - 1 AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
blocks AS (SELECT doc_id, n, n // 7 AS page, n % 7 AS number, CASE WHEN n % 5 = 2 THEN 1 ELSE 0 END AS kind, line FROM lines)"""


@query("reading_order", oracle([], "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, number) - 1 AS INT) AS seq, sha256(concat_ws(chr(1), doc_id, page, number)) AS region_id, line || chr(10) || line || '!' AS text FROM blocks WHERE kind <> 1 AND trim(line, chr(32) || chr(9) || chr(13)) <> ''", _BLOCKS))
def reading_order(t):
    """Lines as layout blocks of two lines of spans; images and blank blocks go."""
    b = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    span = lambda x: F.struct(x.alias("text"), F.lit(10.0).alias("size"), F.lit(0).alias("flags"))
    blank = F.trim("line") == ""
    row = lambda *xs: F.struct(F.array(*map(span, xs)).alias("spans"))
    lines = F.array(row(F.col("line")), row(F.col("line"), F.when(blank, "").otherwise("!")))
    b = b.select("doc_id", F.floor(F.col("n") / 7).alias("page"), (F.col("n") % 7).alias("number"), F.when(F.col("n") % 5 == 2, 1).otherwise(0).alias("kind"), *(F.lit(v).alias(k) for k, v in {"x0": 80, "y0": 100, "x1": 500, "y1": 120, "width": 600, "height": 800}.items()), lines.alias("lines"))
    return L.page_regions(b).select("doc_id", "page", "seq", "region_id", "text")


_ESCAPED = "array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN c IN ('&', '%', '$', '#', '_', '{', '}') THEN '\\' || c WHEN c = '~' THEN '\\textasciitilde{}' WHEN c = '^' THEN '\\textasciicircum{}' WHEN c = '\\' THEN '\\textbackslash{}' ELSE c END), '')"
_FONTS = "'\\usepackage[T1]{fontenc}', '\\usepackage[utf8]{inputenc}', '\\usepackage{lmodern}'"


@query("latex_files", f"""SELECT page_id, array_to_string(CASE page_id % 3
  WHEN 0 THEN ['\\documentclass[12pt]{{article}}', {_FONTS}, '\\usepackage{{microtype}}', '\\usepackage{{csquotes}}', '\\usepackage[margin=1in]{{geometry}}', '\\usepackage{{setspace}}', '\\onehalfspacing', '\\usepackage{{marginnote}}']
  WHEN 1 THEN ['\\documentclass[12pt,oneside]{{memoir}}', {_FONTS}, '\\usepackage{{microtype}}', '\\usepackage{{csquotes}}', '\\usepackage{{marginnote}}']
  ELSE ['\\documentclass[12pt]{{article}}', {_FONTS}, '\\usepackage{{reledpar}}', '\\usepackage{{reledmac}}', '\\usepackage{{csquotes}}', '\\usepackage[margin=1in]{{geometry}}'] END
  || ['', '\\title{{' || CASE WHEN page_id % 5 = 0 THEN 'Untitled' ELSE {_ESCAPED} END || '}}', '\\author{{' || CASE WHEN page_id % 2 = 0 THEN 'A and B' ELSE '' END || '}}', '\\date{{' || CASE WHEN page_id % 4 > 0 THEN CAST(1700 + page_id % 300 AS STRING) ELSE '' END || '}}', '\\begin{{document}}']
  || CASE WHEN page_id % 3 = 1 THEN ['\\frontmatter', '\\maketitle', '\\mainmatter'] ELSE ['\\maketitle'] END || ['text', '\\end{{document}}', ''], chr(10)) AS latex FROM pages""")
def latex_files(t):
    """Pages' addresses as titles of documents of the three templates."""
    n = F.col("page_id")
    docs = t("pages").select("page_id", F.when(n % 5 > 0, F.col("url")).alias("title"), F.when(n % 2 == 0, F.array(F.lit("A"), F.lit("B"))).alias("author"), F.when(n % 4 > 0, 1700 + n % 300).alias("year"), F.element_at(F.array(F.lit("article"), F.lit("memoir"), F.lit("reledpar")), (n % 3 + 1).cast("int")).alias("template"))
    return L.rendered(docs, t("pages").select("page_id", F.lit("text").alias("body")), "page_id")


@query("document_file_names", "SELECT page_id, left(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 120) AS file_name FROM pages")
def document_file_names(t):
    return t("pages").select("page_id", L.file_name(F.col("url")).alias("file_name"))


@query("roster_check", oracle(["v_people"], "SELECT country, count(*) FILTER (WHERE pid % 40 = 0) = 0 AS is_roster FROM v_people GROUP BY country"))
def roster_check(t):
    """Arrays of people, some of which have one without a name."""
    named = F.struct(F.when(F.col("pid") % 40 > 0, F.col("name")).alias("name"), "birth_year")
    return t("v_people").groupBy("country").agg(F.collect_list(named).alias("p")).select("country", W.is_roster(F.col("p")).alias("is_roster"))


@query("review_first", oracle(["v_people"], "SELECT 'tags' AS kind, country AS k FROM (SELECT DISTINCT country FROM v_people) QUALIFY row_number() OVER (ORDER BY country) <= 200 UNION ALL SELECT 'people', name FROM v_people QUALIFY row_number() OVER (ORDER BY ord) <= 200 UNION ALL SELECT 'edges', CAST(pid AS STRING) FROM v_people WHERE pid % 2 = 0 QUALIFY row_number() OVER (ORDER BY pid) <= 200"))
def review_first(t):
    p = t("v_people")
    lists = W.review_lists(p.select("country").distinct(), p.select("name", "ord"), p.where("pid % 2 = 0").select("pid"), ("country", "ord", "pid"))
    named = [df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("k")) for df, kind, c in zip(lists, ("tags", "people", "edges"), ("country", "name", "pid"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("flags_joined", oracle(["v_people"], "SELECT pid, array_to_string(list_concat(CASE WHEN pid % 2 = 0 THEN [field] ELSE [] END, CASE WHEN pid % 3 = 0 THEN [country, field] ELSE [] END), ',') AS flags FROM v_people"))
def flags_joined(t):
    flags = P.all_flags(F.when(F.col("pid") % 2 == 0, F.array("field")), F.when(F.col("pid") % 3 == 0, F.array("country", "field")))
    return t("v_people").select("pid", F.array_join(flags, ",").alias("flags"))


@query("passage_order", "SELECT conv_id, array_to_string(CASE WHEN n <= 2 THEN l ELSE list_concat(list_concat([l[1]], l[3:]), [l[2]]) END, ' ') AS documented, array_to_string(l, ' ') AS used FROM (SELECT conv_id, count(*) AS n, list(CAST(turn AS STRING) || role ORDER BY turn, role) AS l FROM conversations GROUP BY conv_id)")
def passage_order(t):
    """Turns as passages, best first, in both orders."""
    one = F.struct("turn", "role")
    l = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(x["turn"].cast("string"), x["role"]))  # noqa: E741
    rows = t("conversations").groupBy("conv_id").agg(l.alias("l"))
    return rows.select("conv_id", F.array_join(R.context_order(F.col("l"), documented=True), " ").alias("documented"), F.array_join(R.context_order(F.col("l")), " ").alias("used"))


@query("tags_outside_vocabulary", oracle(["v_people"], "SELECT DISTINCT country AS tag FROM v_people WHERE country NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)"))
def tags_outside_vocabulary(t):
    return V.unknown_tags(t("v_people").select(F.col("country").alias("tag")).distinct(), t("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("tag")))


@query("files_of_people", oracle(["v_people"], "SELECT person, string_agg(file_name, '|' ORDER BY o) AS files FROM (SELECT o_custkey AS person, o_orderpriority AS file_name, min(o_orderkey) AS o FROM orders GROUP BY 1, 2) GROUP BY person"))
def files_of_people(t):
    r = t("orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("file_name"), F.col("o_orderkey").alias("ord"))
    return E.source_files(r).select("person", F.array_join("source_files", "|").alias("files"))

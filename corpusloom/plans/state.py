"""Pipeline state, queues, feeds and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import state as S
from corpusloom.sources import files as SF
from corpusloom.sources import json as SJ
from corpusloom.sources import scratch
from corpusloom.sources.tail import Tail

from .registry import oracle, query

_STATUS = """q AS (SELECT path, bool_or(queue = 'index') AS qi, bool_or(queue = 'graph') AS qg FROM v_queue GROUP BY 1),
status AS (
  SELECT path, split_part(path, '/', -1) AS file_name, coalesce(nullif(regexp_replace(path, '/?[^/]*$', ''), ''), '.') AS folder, coalesce(i.status, CASE WHEN qi THEN 'queued' ELSE 'not_started' END) AS index_status, coalesce(chunks_indexed, 0) AS chunks_indexed,
    coalesce(g.status, CASE WHEN qg THEN 'queued' ELSE 'pending' END) AS graph_status, coalesce(objects_extracted, 0) AS objects_extracted, coalesce(relationships_extracted, 0) AS relationships_extracted
  FROM v_index i FULL JOIN v_graph g USING (path) FULL JOIN q USING (path))"""
_ALL = ["v_index", "v_graph", "v_queue"]


@query("state_full_join", oracle(_ALL, "SELECT * FROM status", _STATUS))
def state_full_join(t):
    return S.status_table(t("v_index"), t("v_graph"), t("v_queue"))


@query("pipeline_summary", oracle(_ALL, """SELECT count(*) AS total_files, count(*) FILTER (WHERE index_status = 'indexed') AS indexed, count(*) FILTER (WHERE graph_status = 'complete') AS graphed, CAST(sum(chunks_indexed) AS BIGINT) AS total_chunks,
  (SELECT count(*) FROM v_queue WHERE queue = 'index') AS queued_index, (SELECT count(*) FROM v_queue WHERE queue = 'graph') AS queued_graph FROM status""", _STATUS))
def pipeline_summary(t):
    return S.summary(state_full_join(t), t("v_queue"))


@query("status_histogram", oracle(["v_index"], "SELECT coalesce(status, 'unknown') AS status, count(*) AS n, CAST(sum(chunks_indexed) AS BIGINT) AS chunks FROM v_index GROUP BY 1"))
def status_histogram(t):
    return S.histogram(t("v_index"))


@query("pending_files", oracle(["v_index", "v_graph"], "SELECT path FROM v_index WHERE status IN ('indexed', 'embedded_no_qdrant') AND path NOT IN (SELECT path FROM v_graph WHERE status = 'complete' OR retry_count >= 5)"))
def pending_files(t):
    return S.pending(t("v_index"), t("v_graph"))


@query("dirty_files", oracle(["v_files", "v_index"], """SELECT path, sha256(text) AS hash FROM v_files f WHERE NOT EXISTS (SELECT 1 FROM v_index i WHERE i.path = f.path AND status = 'indexed' AND context_version >= 1 AND i.doc_id % 4 > 0)"""))
def dirty_files(t):
    """Every fourth stored hash is out of date."""
    f = t("v_files").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    s = t("v_index").join(f.select("path", "hash"), "path").withColumn("hash", F.when(F.col("doc_id") % 4 > 0, F.col("hash")).otherwise("stale"))
    return S.dirty(f, s).select("path", "hash")


@query("djvu_missing_pdf", oracle(["v_files"], "SELECT replace(path, '.pdf', '.djvu') AS path FROM v_files WHERE doc_id % 3 = 0 AND doc_id % 2 = 1"))
def djvu_missing_pdf(t):
    f = t("v_files")
    djvu = f.where("doc_id % 3 = 0").select(F.replace("path", F.lit(".pdf"), F.lit(".djvu")).alias("path"))
    return SF.missing_pdf(djvu.union(f.where("doc_id % 2 = 0").select(F.replace("path", F.lit(".pdf"), F.lit(".PDF")))))


@query("upload_plan", oracle(["v_files"], "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(count(*) * 100000 / 1000000.0::DOUBLE * 0.15::DOUBLE, 6) AS dollars FROM v_files WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def upload_plan(t):
    f = t("v_files").select("path", F.col("n_chars").alias("length"))
    return SF.upload_cost(SF.to_upload(f, t("v_index")))


@query("queue_order", oracle(["v_queue"], "SELECT queue, path, row_number() OVER (ORDER BY priority DESC, ord) AS place FROM v_queue WHERE queue = 'graph'"))
def queue_order(t):
    """The graph queue in the order it is worked off, with each entry's place."""
    from pyspark.sql import Window

    q = t("v_queue").where("queue = 'graph'")
    # places from counts by priority, then within a priority: no task sorts the whole queue
    sizes = q.groupBy("priority").agg(F.count("*").alias("n"))
    before = sizes.select("priority", (F.sum("n").over(Window.orderBy(F.desc("priority")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("priority").orderBy("ord"))
    return q.join(before, "priority").select("queue", "path", (F.col("before") + within).alias("place"))


@query("queue_enqueue", oracle(["v_queue", "v_files"], """SELECT queue, path, priority FROM v_queue UNION ALL SELECT 'index', path, 9 FROM v_files WHERE path NOT IN (SELECT path FROM v_queue WHERE queue = 'index')"""))
def queue_enqueue(t):
    new = t("v_files").select(F.lit("index").alias("queue"), "path", F.lit(9).alias("priority"), F.col("doc_id").alias("ord"))
    return S.enqueue(t("v_queue"), new.unionByName(new.withColumn("ord", F.col("ord") + 1000000))).select("queue", "path", "priority")


@query("queue_dequeue", oracle(["v_queue", "v_index"], "SELECT queue, path, priority FROM v_queue q WHERE NOT EXISTS (SELECT 1 FROM v_queue d WHERE d.ord % 3 = 0 AND d.queue = q.queue AND d.path = q.path)"))
def queue_dequeue(t):
    q = t("v_queue")
    return S.dequeue(q, q.where("ord % 3 = 0").select("queue", "path")).select("queue", "path", "priority")


@query("reset_failed", oracle(["v_index"], "SELECT path, CASE WHEN status = 'failed' THEN NULL ELSE status END AS status, CASE WHEN status = 'failed' THEN NULL ELSE chunks_indexed END AS chunks_indexed FROM v_index"))
def reset_failed(t):
    return S.reset_failed(t("v_index").select("path", "status", "chunks_indexed"))


@query("state_upsert", oracle(["v_index"], "SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'latex_built' ELSE status END AS status FROM v_index"))
def state_upsert(t):
    i = t("v_index")
    return S.upsert(i.select("path", "status"), i.where("doc_id % 2 = 0").select("path", F.lit("latex_built").alias("status")))


@query("recent_files", oracle(["v_index"], "SELECT path, updated_at FROM v_index ORDER BY updated_at DESC, path LIMIT 5"))
def recent_files(t):
    return S.recent(t("v_index")).select("path", "updated_at")


@query("throughput_eta", """SELECT n, round(rate, 4) AS rate, CASE WHEN 20000 / rate < 1 THEN '~' || CAST(CAST(floor(20000 / rate * 60) AS BIGINT) AS STRING) || ' min' WHEN 20000 / rate < 48 THEN '~' || printf('%.1f', 20000 / rate) || ' hr' ELSE '~' || printf('%.1f', 20000 / rate / 24) || ' days' END AS eta
  FROM (SELECT count(*) AS n, (count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE) AS rate FROM (SELECT ts FROM events ORDER BY ts DESC LIMIT 10))""")
def throughput_eta(t):
    return S.throughput(t("events").select("ts"), 30000, 10000).select("n", F.round("rate", 4).alias("rate"), "eta")


@query("ema_controller", """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, round(sum(0.3::DOUBLE * pow(0.7::DOUBLE, age) * value) + pow(0.7::DOUBLE, max(n)) * 30, 6) AS ema FROM x GROUP BY 1""")
def ema_controller(t):
    return S.ema(t("events"), "event_type", "event_id", F.col("value"), 0.3, 30.0).select("event_type", F.round("ema", 6).alias("ema"))


@query("cap_controller", """WITH RECURSIVE x AS (SELECT user_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, value)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  r AS (SELECT user_id, 0::BIGINT AS rn, 30.0::DOUBLE AS ambient, 50.0::DOUBLE AS cap FROM (SELECT DISTINCT user_id FROM x)
    UNION ALL SELECT x.user_id, x.rn, 0.3::DOUBLE * v + 0.7::DOUBLE * ambient, 0.2::DOUBLE * greatest(10.0::DOUBLE, least(90.0::DOUBLE, 100.0::DOUBLE - (0.3::DOUBLE * v + 0.7::DOUBLE * ambient) - 10.0::DOUBLE)) + 0.8::DOUBLE * cap FROM r JOIN x ON x.user_id = r.user_id AND x.rn = r.rn + 1)
  SELECT user_id, round(arg_max(ambient, rn), 6) AS ambient, round(arg_max(cap, rn), 6) AS cap FROM r GROUP BY 1""")
def cap_controller(t):
    return S.controller(t("events"), "user_id", "event_id", F.col("value")).select("user_id", F.round("ambient", 6).alias("ambient"), F.round("cap", 6).alias("cap"))


@query("worker_batches", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 15")
def worker_batches(t):
    return S.batches(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.lit(100), 15)


@query("worker_round_robin", "SELECT event_id AS call_no, CASE event_id % 4 WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' WHEN 2 THEN 'w4' ELSE 'w5' END AS worker FROM events")
def worker_round_robin(t):
    w = t("region").select(F.concat(F.lit("w"), (F.col("r_regionkey") + 1).cast("string")).alias("worker"), (F.col("r_regionkey") != 2).alias("enabled"))
    return S.round_robin(w, t("events").select(F.col("event_id").alias("call_no")))


@query("quota_reset", "SELECT CAST(ts AS DATE) AS day, least(count(*), 490) AS within, greatest(count(*) - 490, 0) AS beyond FROM events GROUP BY 1")
def quota_reset(t):
    return S.quota(t("events"), F.to_date("ts"))


@query("worker_progress", "SELECT ord, coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 AS done, sum(size) OVER () AS total FROM (SELECT c_nationkey % 7 AS ord, count(*) AS size FROM customer GROUP BY 1)")
def worker_progress(t):
    g = t("customer").groupBy((F.col("c_nationkey") % 7).alias("ord")).agg(F.count("*").alias("size")).withColumn("cursor", F.lit(3))
    return S.progress(g)


@query("record_routing_counts", "SELECT event_type AS record_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def record_routing_counts(t):
    parts = SJ.routed(t("events").withColumnRenamed("event_type", "record_type"), kinds=("click", "view", "purchase"))
    first, *rest = [d.groupBy("record_type").agg(F.count("*").alias("n")) for d in parts.values()]
    for d in rest:
        first = first.unionByName(d)
    return first


@query("jsonl_parse", "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 4 IN (0, 1)")
def jsonl_parse(t):
    """Lines that hold an object stay: arrays and broken lines are dropped."""
    line = F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 4 == 3, F.concat("props", F.lit("}x"))).otherwise(F.col("props"))
    r = t("events").select("event_id", SJ.objects(line).alias("v")).where("v is not null")
    return r.select("event_id", F.variant_get("v", "$.k", "long").alias("k"))


@query("log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 80")
def log_tail(t):
    return SF.log_tail(t("events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))).select(F.col("line_no").alias("event_id"), F.col("line").alias("event_type"))


@query("zotero_lookup", oracle(["v_files"], """SELECT path, coalesce(citekey, '') AS zotero_key, coalesce(title, CAST(f.doc_id AS STRING)) AS title, substr(date, 1, 4) AS year, coalesce(CASE WHEN citekey IS NOT NULL THEN 'webpage' END, 'other') AS publication_type
  FROM v_files f LEFT JOIN (SELECT CAST(page_id // 2 AS STRING) AS stem, max(page_id) AS ord, 'k' || CAST(max(page_id) AS STRING) AS citekey, arg_max(url, page_id) AS title, CAST(1900 + max(page_id) % 100 AS STRING) || '-01' AS date FROM pages GROUP BY 1) z ON CAST(f.doc_id AS STRING) = stem"""))
def zotero_lookup(t):
    """Pages as bibliographic items, two a document; the last attachment of a stem wins."""
    p = t("pages")
    items = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("k"), F.col("page_id").cast("string")).alias("citekey"), F.col("url").alias("title"), F.lit("").alias("author"), F.concat((1900 + F.col("page_id") % 100).cast("string"), F.lit("-01")).alias("date"), F.lit("en").alias("language"), F.lit("webpage").alias("type"), F.array(F.struct(F.concat(F.lit("C:/x/"), F.floor(F.col("page_id") / 2).cast("string"), F.lit(".pdf")).alias("path")), F.struct(F.lit("").alias("path"))).alias("attachments"))
    return SF.with_bibliography(t("v_files"), SF.bibliography_index(items)).select("path", "zotero_key", "title", "year", "publication_type")


@query("path_exclusion", oracle(["v_files"], "SELECT path FROM v_files WHERE NOT contains(lower(path), 'src1') AND NOT contains(lower(path), '/9')"))
def path_exclusion(t):
    from corpusloom.functions.text import excluded

    return t("v_files").where(~excluded(F.col("path"), ("SRC1", "/9"))).select("path")


@query("log_tail_bytes", """SELECT line FROM (SELECT *, sum(length(line) + 1) OVER (ORDER BY event_id DESC) AS back FROM (SELECT event_id, CAST(event_id AS STRING) || ' ' || event_type AS line FROM events)) WHERE back < 8000""")
def log_tail_bytes(t):
    """Events written as a log, and its end read by byte offset."""
    lines = t("events").orderBy("event_id").select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value"))
    spark = lines.sparkSession
    path = scratch.folder(spark, "log")
    lines.coalesce(1).write.text(path)  # a log is one file
    spark.dataSource.register(Tail)
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return spark.read.format("tail").load(files[0]).select("line")

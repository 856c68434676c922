"""The jobs as queries: each runs twice into one new folder, and its output as it stands after the second run is held against SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom import importable
from corpusloom.plans import text
from corpusloom.sources import scratch

from . import index_documents, search_index
from .common import config


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the incremental index over ``documents``; the second finds nothing new."""
    importable(spark)
    out = scratch.folder(spark, index_documents.NAME)
    for _ in range(2):
        now = index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{out}/out", f"{out}/checkpoint", config(index_documents.NAME))
    return now.drop("batch", "language_detected")


def job2_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of the search index over ``documents``, and the benchmark's questions answered from it."""
    importable(spark)
    out = scratch.folder(spark, search_index.NAME)
    for _ in range(2):
        now = search_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, config(search_index.NAME))
    return now


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_index_documents": job1_index_documents, "job2_search_index": job2_search_index}

JOB1_SQL = text.CHUNKS_SQL + """
SELECT c.* EXCLUDE (language_detected), language_detected AS lang, source AS title, 'From: ' || CASE WHEN coalesce(source, '') = '' THEN source_file_id ELSE source END || CASE WHEN page_number > 0 THEN ', p. ' || page_number ELSE '' END || '.' AS context
FROM (SELECT * FROM counted QUALIFY level = 'child' OR NOT bool_or(level = 'child') OVER (PARTITION BY source_file_id)) c JOIN documents d ON CAST(d.doc_id AS STRING) = source_file_id
"""

JOB2_SQL = """
WITH w AS (SELECT doc_id AS id, lang, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT *, len(w) AS n, length(bin(len(w))) AS bits FROM w WHERE len(w) > 0),
l AS (SELECT *, CASE WHEN n < 4 THEN n ELSE 4 * (bits - 2) + CAST(floor(n / pow(2.0::DOUBLE, bits - 3)) AS BIGINT) % 4 END AS level FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY lang, level) AS of_level FROM l),
b AS (SELECT lang, id, w, level * 1099511627776 + CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 13) AS BIGINT) % CAST(ceil(of_level / 1024.0::DOUBLE) AS BIGINT) AS block FROM c),
p AS (SELECT lang, block, id, term, count(*) AS weight FROM (SELECT lang, block, id, unnest(w) AS term FROM b) GROUP BY ALL),
q AS (SELECT item_id AS query_id, term, count(*) AS qw FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark WHERE item_id % 100 = 0) WHERE term <> '' GROUP BY 1, 2),
a AS (SELECT query_id, id, sum(qw * weight)::DOUBLE AS sparse_score FROM q JOIN p USING (term) GROUP BY 1, 2)
SELECT 'index' AS kind, lang, term, block, count(*) AS n, max(weight)::DOUBLE AS max_weight, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, string_agg(CAST(weight AS VARCHAR), ',' ORDER BY id) AS weights,
  CAST(NULL AS BIGINT) AS query_id, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INTEGER) AS sparse_rank, CAST(NULL AS DOUBLE) AS sparse_score FROM p GROUP BY lang, term, block
UNION ALL
SELECT 'answer', NULL, NULL, NULL, NULL, NULL, NULL, NULL, query_id, id, sparse_rank, sparse_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, id) - 1 AS INTEGER) AS sparse_rank FROM a) WHERE sparse_rank < 20
"""

ORACLE_SQL: dict[str, str] = {"job1_index_documents": JOB1_SQL, "job2_search_index": JOB2_SQL}

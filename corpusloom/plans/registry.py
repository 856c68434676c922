"""Where queries and their SQL are kept, and the fixture views both read.

A view is one SQL text that Spark and DuckDB evaluate alike; ``{name}`` in it is
a table or another view.  ``view`` gives it as a DataFrame (Catalyst sees through
it, so filters and columns are pushed to the Parquet scans); ``with_views`` gives
the CTEs that a query's SQL starts with.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    "v_people": """
        SELECT c_custkey AS pid, c_custkey AS ord, c_mktsegment || ' ' || n_name || ' ' || CAST(c_custkey % 700 AS STRING) AS name,
          CAST(1500 + (c_custkey * 37) % 500 AS INT) AS birth_year, CAST(1540 + (c_custkey * 37) % 500 + c_custkey % 50 AS INT) AS death_year,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey % 7 END AS calculus_number, c_mktsegment AS field, n_name AS country,
          CAST(c_custkey % 100 AS DOUBLE) / 100 AS centrality_score, CASE WHEN c_custkey % 5 = 0 THEN n_name ELSE '' END AS cluster_id
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_people_dup": """
        SELECT name, birth_year, death_year, CASE WHEN pid % 3 = 0 THEN NULL WHEN pid % 3 = 1 THEN 'nan' ELSE 'c. ' || CAST(birth_year AS STRING) END AS lifespan_raw, country, field, calculus_number,
          CASE WHEN pid % 4 = 0 THEN 'http://p/' || CAST(pid AS STRING) END AS portrait_url, CASE WHEN pid % 6 = 0 THEN 'note' END AS date_note, pid AS ord FROM {v_people}
        UNION ALL
        SELECT lower(name), birth_year, CAST(death_year + pid % 2 AS INT), 'copy ' || CAST(pid AS STRING), NULL, field, calculus_number,
          CASE WHEN pid % 2 = 0 THEN 'Picture' END, 'late note', pid + 1000000 FROM {v_people} WHERE pid % 5 = 0
        UNION ALL
        SELECT ' ' || name, birth_year, NULL, 'nan', country, NULL, calculus_number, 'Picture', NULL, pid + 2000000 FROM {v_people} WHERE pid % 7 = 0""",
    "v_edges": """
        SELECT o_custkey AS source, l_partkey AS target, l_returnflag || '_' || l_linestatus AS relation_type, max(l_quantity) / 50 AS weight,
          CASE WHEN l_linestatus = 'O' THEN 'ai_hypothesis' ELSE 'canonical' END AS assertion_layer
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey, l_returnflag, l_linestatus""",
    "v_files": "SELECT doc_id, source || '/' || CAST(doc_id AS STRING) || '.pdf' AS path, text, n_chars, lang, source FROM {documents}",
    "v_index": """
        SELECT path, CASE WHEN quality = 1 THEN 'indexed' WHEN toxic = 1 THEN NULL ELSE 'failed' END AS status, CAST(floor(n_chars / 1000) AS INT) AS chunks_indexed,
          '2024-01-' || lpad(CAST(l.doc_id % 28 + 1 AS STRING), 2, '0') AS updated_at, l.doc_id AS doc_id, CAST(l.doc_id % 3 AS INT) AS context_version
        FROM {v_files} f JOIN {labels} l ON f.doc_id = l.doc_id""",
    "v_graph": """
        SELECT path, CASE WHEN toxic = 0 THEN 'complete' ELSE 'error' END AS status, CAST(f.doc_id % 10 AS INT) AS objects_extracted, CAST(f.doc_id % 4 AS INT) AS relationships_extracted, CAST(f.doc_id % 8 AS INT) AS retry_count
        FROM {v_files} f JOIN {labels} l ON f.doc_id = l.doc_id WHERE f.doc_id % 3 = 0""",
    "v_queue": """
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'index' ELSE 'graph' END AS queue, 'src' || CAST(o_custkey % 20 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.pdf' AS path,
          CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderkey AS ord FROM {orders}""",
}


def fields(sql: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(sql) if f))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a table of the data."""
    if name in VIEWS:
        return spark.sql(VIEWS[name], **{f: table(spark, sf_dir, f) for f in fields(VIEWS[name])})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(names: list[str]) -> list[str]:
    """The views' CTEs, each after those it needs."""
    out: dict[str, str] = {}

    def need(name: str) -> None:
        if name in VIEWS and name not in out:
            for f in fields(VIEWS[name]):
                need(f)
            out[name] = f"{name} AS ({VIEWS[name].format(**{f: f for f in fields(VIEWS[name])})})"

    for n in names:
        need(n)
    return list(out.values())


def oracle(views: list[str], body: str, *more: str) -> str:
    """SQL that starts with the views' CTEs and ``more`` (``name AS (...)``)."""
    parts = [*ctes(views), *more]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


def query(name: str, sql: str | None = None):
    """Registers a function ``(t)``, where ``t(name)`` is a table or view, under ``name``."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(lambda n: table(spark, sf_dir, n))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put

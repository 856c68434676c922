"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_windows, decontam, exact_dedup, html_extract, mixing, ngram_join, quality, secrets_crf, spelling, suffix_dedup, token_count, toxicity


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns find: the columns of ``op1`` that SQL can express."""
    return secrets_crf.op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2`` that don't depend on its template."""
    return chat_windows.op2_chat_format(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5`` that don't depend on its model."""
    return quality.op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets_crf.op1_secret_scan,
    "op2_chat_format": chat_windows.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_quality": quality.op5_quality,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_token_count": token_count.op8_token_count,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_mix": mixing.op10_mix,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "secret_patterns": secret_patterns,
    "chat_digests": chat_digests,
    "quality_counts": quality_counts,
}

#: Matches are put between two private characters and counted off; group 2 of ``assign`` is found again within its match.
SECRETS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, 0 AS o, 'assign' AS kind, string_split(regexp_replace(t, '((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS parts FROM d
  UNION ALL SELECT r, 1, 'access', string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) FROM d
  UNION ALL SELECT r, 2, 'hex', string_split(regexp_replace(t, '([0-9a-f]+)', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) FROM d),
p AS (SELECT r, o, kind, i, parts[i] AS s FROM m, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
q AS (SELECT r, o, kind, i, split_part(s, chr(57345), 1) AS x, sum(length(replace(s, chr(57345), ''))) OVER (PARTITION BY r, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM p),
f AS (
  SELECT r, o, kind, a, a + length(x) AS b FROM q
  WHERE i > 1 AND CASE o WHEN 0 THEN length(regexp_extract(x, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 1 THEN length(x) >= 20 ELSE length(x) >= 24 END),
g AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' ORDER BY a, o) AS names FROM f GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(names, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM t GROUP BY conv_id
"""

QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontam.OP4_SQL,
    "op7_suffix_dedup": suffix_dedup.OP7_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op10_mix": mixing.OP10_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "secret_patterns": SECRETS_SQL,
    "chat_digests": CHAT_SQL,
    "quality_counts": QUALITY_SQL,
}

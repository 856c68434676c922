"""Windowed queries over events, in their batch form; tests run the streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.streaming import watch as W

from .registry import query

def _aggs():
    return F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")


def _start(df, *more):
    return df.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *more)


@query("events_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    return _start(W.tumbling(t("events"), "1 hour", ["event_type"], *_aggs()), "event_type", "n", "total")


@query("events_sliding", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value, unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS s FROM events) GROUP BY 1, 2""")
def events_sliding(t):
    return _start(W.sliding(t("events"), "2 hours", "1 hour", ["event_type"], *_aggs()), "event_type", "n", "total")


@query("events_session", """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_session(t):
    return _start(W.sessions(t("events"), "30 minutes", ["user_id"], *_aggs()), "user_id", "n", "total")


@query("events_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def events_dedup_watermark(t):
    return W.first_of(t("events"), ["user_id", "event_type"]).select("user_id", "event_type")

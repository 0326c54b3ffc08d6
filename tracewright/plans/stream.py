"""Streaming queries, drained over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from .evidence import ASOF


def _events(spark, sf_dir):
    return E.read_files(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_asof_status(spark, sf_dir):
    e = _events(spark, sf_dir)
    updates = e.select("user_id", (F.col("event_id") % 5).alias("dimension"), F.round("value").cast("long").alias("state"), E.verification(F.col("event_type")).alias("verification"), F.to_date("ts").alias("observed_on"), F.col("ts").alias("recorded_on"), F.col("event_id").alias("update_id"))
    return E.drain(E.effective_states(updates, ["user_id", "dimension"]), "update", ["user_id", "dimension"])


def stream_day_windows(spark, sf_dir):
    rows = E.drain(E.window_counts(_events(spark, sf_dir), ["event_type"], "1 day"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


DAYS = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"


def stream_sliding_windows(spark, sf_dir):
    rows = E.drain(E.window_counts(_events(spark, sf_dir), [], "12 hours", "6 hours"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "n", F.round("total", 4).alias("total"))


SLIDING = """select strftime(start_at, '%Y-%m-%d %H') as window_start, count(*) as n, round(sum(value), 4) as total
    from (select value, unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) as start_at from events) group by start_at"""


def stream_sessions(spark, sf_dir):
    rows = E.drain(E.sessions(_events(spark, sf_dir), "user_id", "8 hours"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("user_id", text("first_at"), text("last_at"), "n")


SESSIONS = """with m as (select user_id, ts, case when ts < lag(ts) over w + interval 8 hours then 0 else 1 end as b from events window w as (partition by user_id order by ts)),
    k as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from m)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at, count(*) as n from k group by user_id, s"""

PLANS = {
    "stream_asof_status": (stream_asof_status, ASOF),
    "stream_day_windows": (stream_day_windows, DAYS),
    "stream_sliding_windows": (stream_sliding_windows, SLIDING),
    "stream_sessions": (stream_sessions, SESSIONS),
}

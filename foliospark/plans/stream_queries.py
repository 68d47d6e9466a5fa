"""Streaming queries, each drained over what is there now and compared with its batch equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliospark.runtime import shared_folder
from foliospark.streaming import progress

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _run(spark, stream, name, mode):
    return progress.drain(stream, name, mode, f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}")


@query("stream_progress", "SELECT job_id, round(coalesce(max(CASE WHEN fraction > 1 THEN 1.0 ELSE fraction END), 0.0), 6) AS progress, count(DISTINCT event_id) AS events FROM job_events GROUP BY 1")
def stream_progress(spark, sf):
    rows = _run(spark, progress.monotone_stream(progress.event_stream(spark, f"{sf}/job_events.parquet")), "progress", "update")
    return progress.latest(rows, ["job_id"]).select("job_id", F.round("progress", 6).alias("progress"), "events")


@query("stream_batches", "SELECT batch_id, count(*) AS n_events, round(max(CASE WHEN fraction > 1 THEN 1.0 ELSE fraction END), 6) AS top FROM job_events WHERE batch_id IS NOT NULL GROUP BY 1")
def stream_batches(spark, sf):
    rows = _run(spark, progress.batch_totals(progress.event_stream(spark, f"{sf}/job_events.parquet")), "batches", "update")
    return progress.latest(rows, ["batch_id"]).select("batch_id", "n_events", F.round("top", 6).alias("top"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', event_ts) AS win_start, status, count(*) AS n FROM job_events GROUP BY ALL")
def stream_tumbling(spark, sf):
    rows = _run(spark, progress.tumbling(progress.event_stream(spark, f"{sf}/job_events.parquet"), late="3650 days"), "tumbling", "update")
    return progress.latest(rows, ["win_start", "status"]).select(F.col("win_start").cast("timestamp_ntz").alias("win_start"), "status", "n")


@query("stream_sliding", "SELECT time_bucket(INTERVAL '15 minutes', event_ts) - k * INTERVAL '15 minutes' AS win_start, count(*) AS n FROM job_events, (SELECT unnest(range(4)) AS k) WHERE event_ts IS NOT NULL GROUP BY ALL")
def stream_sliding(spark, sf):
    rows = _run(spark, progress.sliding(progress.event_stream(spark, f"{sf}/job_events.parquet"), late="3650 days"), "sliding", "update")
    return progress.latest(rows, ["win_start"]).select(F.col("win_start").cast("timestamp_ntz").alias("win_start"), "n")


@query("stream_sessions", """WITH e AS (SELECT job_id, event_ts, max(event_ts) OVER (PARTITION BY job_id ORDER BY event_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM job_events WHERE event_ts IS NOT NULL),
g AS (SELECT job_id, event_ts, sum(CASE WHEN prev IS NULL OR event_ts > prev + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY event_ts) AS k FROM e)
SELECT job_id, min(event_ts) AS win_start, max(event_ts) + INTERVAL '30 minutes' AS win_end, count(*) AS n FROM g GROUP BY job_id, k""")
def stream_sessions(spark, sf):
    """Complete mode, which session windows allow: sessions still open at the end come out too, and no event is too late."""
    rows = _run(spark, progress.sessions(progress.event_stream(spark, f"{sf}/job_events.parquet"), late="3650 days"), "sessions", "complete")
    last = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # the last batch holds all sessions
    return last.select("job_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("win_start", "win_end")], "n")

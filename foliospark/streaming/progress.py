"""Streams of job events: monotone progress, batch totals, event-time windows, expiry, incremental folders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType

from foliospark.operators.jobs import capped
from foliospark.schemas import TABLES
from foliospark.sources.readers import BINARY_SCHEMA

EVENT_SCHEMA = TABLES["job_events"]


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Job events as a stream; timestamps in the session's zone, so that watermarks accept them."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = spark.readStream.schema(schema).parquet(path)
    else:  # a stream reads folders: take the one file out of its folder
        rows = spark.readStream.schema(schema).option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return rows.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withColumn("received_ts", F.col("received_ts").cast("timestamp"))


def monotone_stream(events: DataFrame, ttl_minutes: int | None = None) -> DataFrame:
    """(job_id, progress, events) updated per batch: progress never falls.

    With ttl_minutes idle state times out; such a stream never ends by itself, so drain() takes one without."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, n = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            f = pdf["fraction"].dropna()
            if len(f):
                best = max(best, min(1.0, float(f.max())))
            n += len(pdf)
        state.update((best, n))
        if ttl_minutes:
            state.setTimeoutDuration(ttl_minutes * 60_000)
        yield pd.DataFrame({"job_id": [key[0]], "progress": [best], "events": [n]})

    keyed = events.dropDuplicates(["event_id"]).groupBy("job_id")
    return keyed.applyInPandasWithState(step, "job_id string, progress double, events bigint", "best double, n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout if ttl_minutes else GroupStateTimeout.NoTimeout)


def batch_totals(events: DataFrame) -> DataFrame:
    """Events and highest fraction per batch, for update or complete mode."""
    return events.where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("n_events"), F.max(capped()).alias("top"))


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    w = events.withWatermark("event_ts", late).groupBy(F.window("event_ts", size), "status").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("win_start"), "status", "n")


def sliding(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    w = events.withWatermark("event_ts", late).groupBy(F.window("event_ts", size, slide)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("win_start"), "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per job: a session ends after a gap without events."""
    s = events.withWatermark("event_ts", late).groupBy("job_id", F.session_window("event_ts", gap)).agg(F.count("*").alias("n"))
    return s.select("job_id", F.col("session_window.start").alias("win_start"), F.col("session_window.end").alias("win_end"), "n")


def folder_stream(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """New files of a folder as a stream; the checkpoint makes a restart go on where it stopped."""
    return spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, timeout: int = 300) -> DataFrame:
    """Run a stream over what is there now, into a parquet sink or (update and complete mode) the last rows by key; bounded in time."""
    spark = stream.sparkSession
    out = f"{checkpoint}/{name}"
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint")
    if mode == "append":
        q = query.format("parquet").option("path", f"{out}/rows").start()
    else:
        q = query.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"stream {name} took more than {timeout} s")
    return spark.read.schema(stream.schema.add("batch", LongType()) if mode != "append" else stream.schema).parquet(f"{out}/rows")


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last row of every key of an update stream."""
    cols = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*key, "r.*")

"""Jobs and batches: current state, monotone progress, boards, expiry, names, admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import text as T

def capped(fraction: str = "fraction") -> Column:
    """The fraction, at most 1; null stays null."""
    return F.when(F.col(fraction) > 1, 1.0).otherwise(F.col(fraction))


TERMINAL = ["done", "failed", "expired"]


def monotone(events: DataFrame) -> DataFrame:
    """Distinct events with progress: the highest fraction up to the event, at most 1; null fractions change nothing."""
    w = Window.partitionBy("job_id").orderBy("seq", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.distinct().withColumn("progress", F.coalesce(F.max(capped()).over(w), F.lit(0.0)))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, batch_id, doc_id, status, progress, created_at, updated_at): the latest state of every job."""
    e = events.distinct()
    last = F.struct("seq", "event_id")
    return e.groupBy("job_id").agg(F.max("batch_id").alias("batch_id"), F.max("doc_id").alias("doc_id"), F.max_by("status", last).alias("status"), F.coalesce(F.max(capped()), F.lit(0.0)).alias("progress"), F.min("event_ts").alias("created_at"), F.max("event_ts").alias("updated_at"))


def batch_board(states: DataFrame) -> DataFrame:
    """One row per batch: jobs by state, mean progress and whether it has ended. Jobs without a batch are left out."""
    n = lambda s: F.count_if(F.col("status") == s)
    ended = F.count_if(F.col("status").isin(TERMINAL))
    return states.where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("total"), ended.alias("finished"), n("done").alias("done"), n("failed").alias("failed"), n("queued").alias("queued"), n("running").alias("running"), F.round(F.avg("progress"), 4).alias("progress"), (ended == F.count("*")).alias("ended"))


def expired(states: DataFrame, now: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Terminal jobs older than the time to live; queued and running jobs never expire."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    return states.where(F.col("status").isin("done", "failed") & (age > cfg.ttl_minutes * 60_000_000))


def orphan_batches(states: DataFrame, gone: DataFrame) -> DataFrame:
    """Batches all of whose jobs have expired."""
    alive = states.join(gone.select("job_id"), "job_id", "left_anti").where("batch_id is not null").select("batch_id").distinct()
    return states.where("batch_id is not null").select("batch_id").distinct().join(alive, "batch_id", "left_anti")


def folder_names(files: DataFrame) -> DataFrame:
    """files (batch_id, idx, filename) with folder: stems made unique per batch without regard to case, in order of idx.

    A name that is taken gets -2, -3, ... until one is free, whether the taken one was given or generated.  Names can
    only meet when they share their root (the stem without trailing numbers), so each root is numbered by itself, as a
    stream of sorted rows: no batch is gathered."""
    stem = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce("filename", F.lit("")), "^.*[/\\\\]", ""), "(?<=.)\\.[^.]*$", ""), F.lit("")), F.lit("documento"))
    f = files.withColumn("folder", stem).withColumn("__root", F.regexp_replace(F.lower("folder"), "(-\\d+)+$", ""))
    sorted_ = f.repartition("batch_id", "__root").sortWithinPartitions("batch_id", "__root", "idx", "folder")

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, following = None, set(), {}
        for pdf in batches:
            out = []
            for batch, root, base in zip(pdf["batch_id"], pdf["__root"], pdf["folder"]):
                if (batch, root) != at:
                    at, used, following = (batch, root), set(), {}
                folder, n = base, following.get(base.lower(), 2)
                while folder.lower() in used:
                    folder, n = f"{base}-{n}", n + 1
                following[base.lower()] = n
                used.add(folder.lower())
                out.append(folder)
            yield pdf.assign(folder=out)

    return sorted_.mapInPandas(name, sorted_.schema).drop("__root")


def admission(files: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """files (batch_id, idx, filename, bytes, magic) with reason, null where accepted.

    The batch total counts every valid file, the one that overflows included."""
    mb = 1024 * 1024
    alone = F.when(F.coalesce("bytes", F.lit(0)) == 0, "arquivo vazio").when(~F.coalesce(F.col("magic").startswith("%PDF-"), F.lit(False)), "não é um PDF").when(F.col("bytes") > cfg.max_file_mb * mb, f"acima de {cfg.max_file_mb} MB")
    w = Window.partitionBy("batch_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    f = files.withColumn("alone", alone).withColumn("total", F.sum(F.when(F.col("alone").isNull(), F.col("bytes")).otherwise(0)).over(w))
    return f.withColumn("reason", F.coalesce("alone", F.when(F.col("total") > cfg.max_batch_mb * mb, f"lote acima de {cfg.max_batch_mb} MB no total"))).drop("alone", "total")


def report_board(states: DataFrame, reports: DataFrame, json_col: str = "resultado_processamento") -> DataFrame:
    """Jobs with what their latest readable report says: one row per job for a person to check."""
    r = reports.distinct()
    j = lambda p: F.get_json_object(json_col, p)
    fields = {"report_status": "$.resumo.status", "coverage": "$.text_accuracy", "pages": "$.documento.paginas", "tables": "$.tables_detected", "to_review": "$.tabelas.para_revisar", "images": "$.images_extracted", "ocr_pages": "$.ocr.paginas_com_ocr"}
    readable = r.where(F.try_parse_json(F.col(json_col)).isNotNull()).select("doc_id", "report_id", *[j(p).alias(c) for c, p in fields.items()], F.from_json(j("$.resumo.pendencias"), "array<string>").alias("pending"))
    last = readable.groupBy("doc_id").agg(F.max_by(F.struct(*fields, "pending"), "report_id").alias("r"))
    s = states.join(last, "doc_id", "left")
    status = F.coalesce("r.report_status", F.when(F.col("status") == "failed", "falhou"))
    num = lambda c, t: F.expr(f"try_cast(r.{c} as {t})")
    return s.select("job_id", "batch_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), "status", status.alias("report_status"), num("coverage", "double").alias("coverage"), *[num(c, "int").alias(c) for c in ("pages", "tables", "to_review", "images", "ocr_pages")], F.array_join(F.coalesce("r.pending", F.array().cast("array<string>")), " | ").alias("pending"))


def board_csv(board: DataFrame) -> DataFrame:
    """(batch_id, job_id, line): the board as lines of a ';' separated file; fields with ';' or quotes are quoted."""
    q = lambda c: F.when(c.rlike('[;"\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [q(s("filename")), q(F.coalesce("report_status", "status")), s("coverage"), s("pages"), s("tables"), s("to_review"), s("images"), s("ocr_pages"), q(s("pending"))]
    return board.select("batch_id", "job_id", F.concat_ws(";", *cols).alias("line"))


def sse_frame(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def markdown_name(filename: Column) -> Column:
    return F.concat(T.safe_stem(filename), F.lit(".md"))

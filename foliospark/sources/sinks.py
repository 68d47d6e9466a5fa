"""Sinks: Markdown files, JSON reports, the batch board."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file per row in a shared folder, from the executors; (name, bytes) of what was written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path

        base = Path(folder)
        base.mkdir(parents=True, exist_ok=True)
        for pdf in batches:
            done = []
            for n, c in zip(pdf[name], pdf[content]):
                data = c.encode("utf-8")
                part = base / f".{n}.part"
                part.write_bytes(data)
                part.replace(base / n)  # a retried task leaves no half-written file
                done.append((n, len(data)))
            yield pd.DataFrame(done, columns=["name", "bytes"])

    return rows.select(name, content).mapInPandas(write, "name string, bytes bigint")


def markdown_files(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, markdown): names (doc_id, filename) made safe."""
    return documents.join(names, "doc_id").select("doc_id", F.concat(T.safe_stem(F.col("filename")), F.lit(".md")).alias("name"), "markdown")


def write_markdown(documents: DataFrame, path: str) -> None:
    """All documents as one partitioned text table."""
    documents.select("markdown").write.mode("overwrite").text(path, lineSep="\u0000")


def write_board(lines: DataFrame, path: str) -> None:
    """The batch board as ';' separated files, one folder per batch."""
    lines.select("batch_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("batch_id").text(path)

"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators import nested
from foliospark.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.report_children(table(spark, sf_dir, "reports"))


def _one(path: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, plan = nested.report_tables(table(spark, sf_dir, "reports"))
        return nested.as_table(rows, "report_id", plan[path])

    return query


QUERIES = {
    "p4_found": p4_found,
    "p4_report": _one(""),
    "p4_pages": _one("paginas"),
    "p4_tables": _one("tabelas.detalhe"),
    "p4_warnings": _one("warnings"),
    "p4_warning_pages": _one("warnings.detail.paginas"),
}

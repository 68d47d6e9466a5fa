"""Page routing: which pages have usable text, which need recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config

ROUTES = ["native", "ocr", "hybrid", "empty"]


def routes(pages: DataFrame, mode: str = "auto", page_range: tuple[int, ...] = (), cfg: Config = DEFAULT) -> DataFrame:
    """pages (distinct) with route, needs_ocr and excluded. Null counts and ratios count as 0."""
    z = lambda c: F.coalesce(c, F.lit(0))
    p = pages.distinct().withColumn("excluded", ~F.col("page").isin(list(page_range)) if page_range else F.lit(False))
    has_text = (z("native_char_count") >= cfg.min_chars) & (z("text_area_ratio") >= cfg.min_text_area)
    dominant = z("image_area_ratio") >= cfg.image_dominance
    ink = (z("image_count") > 0) | (z("vector_line_count") > cfg.ink_lines)
    if mode == "force":
        route, needs = F.lit("ocr"), F.lit(True)
    elif mode == "never":
        route, needs = F.when(has_text, "native").otherwise("empty"), ~has_text & ink
    else:
        route = F.when(~has_text & ink, "ocr").when(~has_text, "empty").when(dominant, "hybrid").otherwise("native")
        needs = F.when(~has_text, ink).otherwise(dominant)
    return p.withColumn("route", F.when(F.col("excluded"), "empty").otherwise(route)).withColumn("needs_ocr", ~F.col("excluded") & needs)


def histogram(routed: DataFrame) -> DataFrame:
    """(doc_id, native, ocr, hybrid, empty): pages per route, zeros included."""
    return routed.groupBy("doc_id").agg(*[F.count_if(F.col("route") == r).alias(r) for r in ROUTES])


def ocr_targets(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route").isin("ocr", "hybrid"))


def native_pages(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route").isin("native", "hybrid"))

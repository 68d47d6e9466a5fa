"""Compact block descriptions for a reviewing provider, and windows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.operators.reading_order import place_in_file


def payloads(ordered: DataFrame, pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, ord, block_id, payload): JSON of every block but page breaks; texts as previews with a truncated flag."""
    sizes = pages.select("doc_id", "page", F.col("width").alias("pw")).distinct()
    b = ordered.where("kind <> 'page_break'").join(sizes, ["doc_id", "page"], "left")
    k, t = F.col("kind"), F.col("text")
    is_ = lambda *kinds: k.isin(*kinds)
    ratio = lambda c: F.when(F.col("pw") > 0, F.round(c / F.col("pw"), 3))
    entry = F.struct(
        F.col("block_id").alias("id"), k, "page", F.when(is_("heading"), F.col("level")).alias("level"), F.when(is_("heading"), F.col("numbering")).alias("numbering"), F.when(is_("paragraph"), F.col("style")).alias("style"),
        F.when(is_("heading", "paragraph", "list_item", "footnote"), F.left(t, F.lit(cfg.preview_chars))).alias("text"), F.when(is_("paragraph"), F.char_length(t) > cfg.preview_chars).alias("truncated"),
        F.when(is_("paragraph"), t.rlike("[.!?;:]\\s*$")).alias("ends_complete"), F.when(is_("list_item", "footnote"), F.col("marker")).alias("marker"), F.when(is_("list_item"), F.col("ordered")).alias("ordered"),
        F.when(is_("figure"), t).alias("caption"), ratio(F.col("x0")).alias("indent"), ratio(F.col("x1") - F.col("x0")).alias("width"), F.when(F.col("source") == "ocr", True).alias("from_ocr"), F.when(F.col("source") == "ocr", F.round("confidence", 3)).alias("ocr_confidence"),
    )
    return b.select("doc_id", "ord", "block_id", F.to_json(entry).alias("payload"))


def windows(ordered: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, window, block_id, pos): overlapping windows of at most window_blocks blocks; the last covers the end."""
    step = max(1, cfg.window_blocks - cfg.window_overlap)
    b = ordered.where("kind <> 'page_break'").select("doc_id", "page", "block_id", "ord")
    b = place_in_file(b, ["ord"])
    n = b.groupBy("doc_id").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - cfg.window_blocks) / step)).cast("int")
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - cfg.window_blocks + 1) / step)).cast("int")
    hi = F.least(last, F.floor(F.col("pos") / step).cast("int"))
    return b.join(n, "doc_id").withColumn("window", F.explode(F.sequence(lo, hi))).select("doc_id", "window", "block_id", "pos")

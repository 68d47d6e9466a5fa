"""Spans to lines, lines to blocks, blocks to pages; recognised words to lines.

Equal rows count once. A null text counts as empty, null coordinates are left out of envelopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T

LINE = ["doc_id", "page", "block_no", "line_no"]
BLOCK = ["doc_id", "page", "block_no"]
FLAG_SUPERSCRIPT, FLAG_ITALIC, FLAG_MONO, FLAG_BOLD = 1, 2, 8, 16


def span_styles(spans: DataFrame) -> DataFrame:
    """Distinct spans with bold, italic, mono, superscript and n, the length of the trimmed text."""
    bit = lambda b: F.coalesce(F.col("flags").bitwiseAND(b) != 0, F.lit(False))
    named = lambda p: F.coalesce(F.col("font").rlike(p), F.lit(False))
    s = spans.distinct().withColumn("text", F.coalesce("text", F.lit("")))
    return (
        s.withColumn("bold", bit(FLAG_BOLD) | named("(?i)(bold|black|heavy|semibold|demi)"))
        .withColumn("italic", bit(FLAG_ITALIC) | named("(?i)(italic|oblique)"))
        .withColumn("mono", bit(FLAG_MONO))
        .withColumn("superscript", bit(FLAG_SUPERSCRIPT))
        .withColumn("n", F.char_length(T.strip(F.col("text"))))
    )


def _weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def text_lines(spans: DataFrame) -> DataFrame:
    """One row per line with text, size, font, weight, confidence and box."""
    s = span_styles(spans)
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    w = F.when(F.col("n") > 0, F.col("n"))
    agg = s.groupBy(*LINE).agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"),
        F.coalesce(_weighted(F.col("size"), w), F.lit(0.0)).alias("size"),
        F.max_by(F.coalesce("font", F.lit("")), F.struct("n", -F.col("span_no"))).alias("font"),
        F.coalesce(F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("bold_ratio"),
        F.coalesce(F.sum(F.when(F.col("italic"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("italic_ratio"),
        F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("confidence"))), F.lit(1.0)).alias("confidence"),
        *G.envelope(),
    )
    stripped = T.strip(F.col("text"))
    return agg.withColumn("stripped", stripped).withColumn("n_chars", F.char_length(stripped)).withColumn("is_bold", F.col("bold_ratio") >= 0.7).withColumn("is_italic", F.col("italic_ratio") >= 0.7)


def raw_blocks(lines: DataFrame) -> DataFrame:
    """One row per block: text of its non-blank lines, size, characters, confidence and box."""
    w = F.when(F.col("n_chars") > 0, F.col("n_chars"))
    shown = F.filter(F.array_sort(F.collect_list(F.struct("line_no", "stripped"))), lambda x: x["stripped"] != "")
    return lines.groupBy(*BLOCK).agg(
        F.array_join(F.transform(shown, lambda x: x["stripped"]), "\n").alias("text"),
        F.sum("n_chars").alias("char_count"),
        F.coalesce(_weighted(F.col("size"), w), F.lit(0.0)).alias("size"),
        F.coalesce(F.avg(F.when(F.col("n_chars") > 0, F.col("confidence"))), F.lit(1.0)).alias("confidence"),
        F.count_if(F.col("n_chars") > 0).alias("n_lines"),
        *G.envelope(),
    )


def page_envelopes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page").agg(*G.envelope(), F.count("*").alias("n_blocks"))


def recognised_words(ocr_words: DataFrame, dpi: float = 300.0, min_conf: float = 40.0) -> DataFrame:
    """Kept words (conf >= min_conf) with their box in page points and confidence from 0 to 1."""
    k = 72.0 / dpi
    kept = ocr_words.distinct().where((T.strip(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("conf", F.lit(-1.0)) >= min_conf))
    return kept.withColumns({"x0": F.col("left_px") * k, "y0": F.col("top_px") * k, "x1": (F.col("left_px") + F.col("width_px")) * k, "y1": (F.col("top_px") + F.col("height_px")) * k, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / 100))})


def ocr_lines(ocr_words: DataFrame, dpi: float = 300.0, min_conf: float = 40.0) -> DataFrame:
    """Lines of recognised words in page points: kept words (conf >= min_conf), text, size, mean confidence and box."""
    w = recognised_words(ocr_words, dpi, min_conf)
    key = ["doc_id", "page", "block_num", "par_num", "line_num"]
    ordered = F.array_sort(F.collect_list(F.struct("word_num", "text")))
    return w.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_words"), F.avg(F.bround((F.col("y1") - F.col("y0")) * 0.92, 2)).alias("size"), F.avg("confidence").alias("confidence"), *G.envelope())


def ocr_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of recognised lines, numbered in reading order of the hierarchy; confidence weighted by words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "text"))), lambda x: x["text"]), "\n")
    blocks = lines.groupBy("doc_id", "page", "block_num", "par_num").agg(text.alias("text"), F.sum("n_words").alias("n_words"), F.round(F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words"), 4).alias("confidence"), *G.envelope())
    order = Window.partitionBy("doc_id", "page").orderBy("block_num", "par_num")
    return blocks.withColumn("number", F.row_number().over(order) - 1)


def drop_native_duplicates(ocr: DataFrame, native: DataFrame, overlap: float = 0.35) -> DataFrame:
    """Recognised blocks without those covering native text; pages meet by key, boxes by range."""
    n = native.select("doc_id", "page", *[F.col(c).alias("n_" + c) for c in ("x0", "y0", "x1", "y1")])
    own = F.when(G.area() > 0, G.area()).otherwise(1.0)
    cond = (ocr["doc_id"] == n["doc_id"]) & (ocr["page"] == n["page"])
    return ocr.join(n, cond & (G.intersection("", "n_") / own >= overlap), "left_anti")


def ocr_spans(ocr_words: DataFrame, dpi: float = 300.0, min_conf: float = 40.0) -> DataFrame:
    """Kept recognised words in the shape of spans; blocks are numbered in reading order of the hierarchy."""
    block = Window.partitionBy("doc_id", "page").orderBy("block_num", "par_num")
    line = Window.partitionBy("doc_id", "page", "block_num", "par_num", "line_num").orderBy("word_num", "text", "left_px", "top_px", "width_px", "height_px", "conf")
    w = recognised_words(ocr_words, dpi, min_conf)
    return w.select(
        "doc_id", "page", (F.dense_rank().over(block) - 1).alias("block_no"), F.col("line_num").alias("line_no"), (F.row_number().over(line) - 1).alias("span_no"),
        F.concat("text", F.when(F.lead("text").over(line).isNotNull(), " ").otherwise("")).alias("text"), "x0", "y0", "x1", "y1",
        F.lit("OCR").alias("font"), F.bround((F.col("y1") - F.col("y0")) * 0.92, 2).alias("size"), F.lit(0).alias("flags"), F.lit(0).alias("color"), "confidence",
    )


def united_spans(spans: DataFrame, ocr_words: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Native spans and recognised words in one shape; recognised blocks come after the native ones of their page.

    On the pages of hybrid (doc_id, page) recognised blocks that cover native text are left out."""
    ocr = ocr_spans(ocr_words)
    native = spans.groupBy(*BLOCK).agg(*G.envelope())
    kept = drop_native_duplicates(ocr.groupBy(*BLOCK).agg(*G.envelope()), native.join(hybrid.select("doc_id", "page"), ["doc_id", "page"], "left_semi")).select(*BLOCK)
    after = native.groupBy("doc_id", "page").agg((F.max("block_no") + 1).alias("after"))
    added = ocr.join(kept, BLOCK, "left_semi").join(after, ["doc_id", "page"], "left").withColumn("block_no", F.col("block_no") + F.coalesce("after", F.lit(0))).drop("after")
    return spans.select(*added.columns).unionByName(added)


def provenance(source: Column, engine: Column, confidence: Column, inferred: Column) -> Column:
    """Recognised blocks keep their provenance; others are heuristic where inferred, else native."""
    return F.struct(F.when(source == "ocr", source).when(inferred, "heuristic").otherwise("native").alias("source"), engine.alias("engine"), confidence.alias("confidence"))


def degrade(confidence: Column, factor: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence * factor))

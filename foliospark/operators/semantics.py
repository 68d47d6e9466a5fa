"""Typography to structure: body style, heading levels, paragraphs, list items, quotations, footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import text as T
from foliospark.operators.layout import LINE


def half_points(size: Column) -> Column:
    return F.bround(size * 2, 0) / 2


def styled(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their style: size to half a point, and weight."""
    return lines.where("n_chars > 0").withColumn("style_size", half_points(F.col("size"))).withColumn("style_bold", F.col("is_bold"))


def style_weights(lines: DataFrame) -> DataFrame:
    """(doc_id, style_size, style_bold, chars, first): characters of every style and where it is first seen."""
    s = styled(lines)
    return s.groupBy("doc_id", "style_size", "style_bold").agg(F.sum("n_chars").alias("chars"), F.min(F.struct("page", "block_no", "line_no")).alias("first"))


def body_styles(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_bold): the style of most characters, the one seen first on a tie."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first")
    top = style_weights(lines).withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select("doc_id", F.col("style_size").alias("body_size"), F.col("style_bold").alias("body_bold"))


def heading_levels(lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, style_size, style_bold, level): styles larger or bolder than the body, ranked from the largest."""
    s = style_weights(lines).join(body_styles(lines), "doc_id")
    other = ~((F.col("style_size") == F.col("body_size")) & (F.col("style_bold") == F.col("body_bold")))
    bigger = F.col("style_size") >= F.col("body_size") + cfg.heading_delta
    bolder = F.col("style_bold") & ~F.col("body_bold") & (F.col("style_size") >= F.col("body_size") - 0.5)
    w = Window.partitionBy("doc_id").orderBy(F.desc("style_size"), F.desc("style_bold"))
    return s.where(other & (bigger | bolder)).withColumn("level", F.row_number().over(w)).where(F.col("level") <= cfg.heading_levels).select("doc_id", "style_size", "style_bold", "level")


def hyphenation(lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, hyphen_rate, dehyphenate): whether the file breaks words at line ends."""
    rate = F.avg(F.col("stripped").rlike(T.HYPHEN_END).cast("double"))
    return lines.where("n_chars > 0").groupBy("doc_id").agg(rate.alias("hyphen_rate")).withColumn("dehyphenate", F.col("hyphen_rate") >= cfg.hyphenation)


def paragraph_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with group: the paragraph inside their block, from 0.

    A new paragraph starts at a wide gap, at a change of style or an indent after a short line, at a bullet or number."""
    w = Window.partitionBy("doc_id", "page", "block_no").orderBy("line_no")
    block = Window.partitionBy("doc_id", "page", "block_no")
    s = lines.where("n_chars > 0")
    s = s.withColumns({"py1": F.lag("y1").over(w), "px1": F.lag("x1").over(w), "psize": F.lag("size").over(w), "pbold": F.lag("is_bold").over(w), "bx0": F.min("x0").over(block), "bx1": F.max("x1").over(block)})
    s = s.withColumn("gap", F.col("y0") - F.col("py1"))
    s = s.withColumn("mgap", F.coalesce(F.median(F.when(F.col("gap") >= 0, F.col("gap"))).over(block), F.lit(0.0)))
    short = F.col("px1") < F.col("bx1") - (F.col("bx1") - F.col("bx0")) * 0.18
    changed = (F.abs(F.col("size") - F.col("psize")) >= 0.6) | (F.col("is_bold") != F.col("pbold"))
    new = ((F.col("mgap") > 0) & (F.col("gap") > F.col("mgap") * 1.6)) | (changed & short) | ((F.col("x0") - F.col("bx0") > 8.0) & short) | F.col("stripped").rlike(T.BULLET) | F.col("stripped").rlike(T.ORDERED_NUM)
    starts = F.when(F.col("psize").isNull(), 0).otherwise(F.coalesce(new, F.lit(False)).cast("int"))
    return s.withColumn("group", F.sum(starts).over(w)).drop("py1", "px1", "psize", "pbold", "bx0", "bx1", "gap", "mgap")


def paragraphs(lines: DataFrame) -> DataFrame:
    """One row per paragraph of every block: text, box, style and place of its first line, isolated."""
    g = paragraph_lines(lines).join(hyphenation(lines).select("doc_id", "dehyphenate"), "doc_id")
    order = F.array_sort(F.collect_list(F.struct("line_no", "stripped")))
    first = lambda c: F.min_by(c, "line_no")
    per = g.groupBy("doc_id", "page", "block_no", "group").agg(
        F.transform(order, lambda x: x["stripped"]).alias("texts"), F.first("dehyphenate").alias("dehyphenate"), first("size").alias("size"), first("is_bold").alias("is_bold"),
        first("x0").alias("fx0"), first("x1").alias("fx1"), F.count("*").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"),
    )
    total = F.sum("n_lines").over(Window.partitionBy("doc_id", "page", "block_no"))
    return per.withColumn("text", T.join_lines(F.col("texts"), F.col("dehyphenate"))).withColumn("isolated", (F.col("n_lines") == 1) & (total == 1)).drop("texts", "n_lines")


def heading_score(width: Column, cfg: Config = DEFAULT) -> Column:
    """Points for a heading; needs text, size, is_bold, isolated, fx0, fx1, body_size, body_bold, level_of_style; -1 where ruled out."""
    t = F.col("text")
    n = F.size(T.words(t))
    style = half_points(F.col("size"))
    out = (F.char_length(t) < 2) | (n > cfg.heading_words) | (t.rlike(T.SENTENCE_END) & ~t.rlike(T.STRUCTURAL) & (n > 6)) | t.rlike(T.BULLET) | t.rlike(T.ORDERED_ALPHA)
    p = lambda cond, points=1: F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)
    right = width - F.col("fx1")
    score = (
        p(F.col("level_of_style").isNotNull(), 2) + p(style >= F.col("body_size") + 0.5) + p(F.col("is_bold") & ~F.col("body_bold")) + p(T.is_upper(t))
        + p(F.col("isolated") & (style > F.col("body_size"))) + p(t.rlike(T.STRUCTURAL), 2) + p(t.rlike(T.NUMBERING) | t.rlike(T.ROMAN_HEADING))
        + p((width > 0) & (F.abs(F.col("fx0") - right) < width * 0.06) & (F.col("fx0") > width * 0.14))
    )
    return F.when(out, -1).otherwise(score)


def classify(lines: DataFrame, pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Paragraphs typed as heading, list_item or paragraph with level, numbering, marker, list_level and style."""
    sizes = pages.select("doc_id", "page", "width").distinct()
    left = lines.where("n_chars > 0").groupBy("doc_id", "page").agg(F.min("x0").alias("page_left"))
    levels = heading_levels(lines, cfg).withColumnRenamed("level", "level_of_style")
    p = paragraphs(lines).withColumn("style_size", half_points(F.col("size"))).withColumn("style_bold", F.col("is_bold"))
    p = p.join(body_styles(lines), "doc_id").join(levels, ["doc_id", "style_size", "style_bold"], "left").join(sizes, ["doc_id", "page"], "left").join(left, ["doc_id", "page"], "left")
    p = p.where("text <> ''").withColumn("score", heading_score(F.col("width"), cfg)).withColumn("list", T.list_marker(F.col("text")))
    heading = F.col("score") >= 3
    number = F.regexp_extract("text", T.NUMBERING, 1)
    roman = F.regexp_extract("text", T.ROMAN_HEADING, 1)
    numbering = F.when(number != "", number).when(roman != "", roman)
    depth = F.when(number != "", F.char_length(number) - F.char_length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(0)
    base = F.coalesce("level_of_style", F.lit(2))
    rest = F.expr("substring(text, char_length(__num) + 1)")
    p = p.withColumn("__num", F.coalesce(numbering, F.lit("")))
    clean = T.strip(F.regexp_replace(T.strip(F.when(F.col("__num") != "", rest).otherwise(F.col("text"))), "^[.)]?\\s*", ""))
    clean = F.when((F.col("__num") == "") | (clean == ""), F.col("text")).otherwise(clean)
    item = ~heading & F.col("list").isNotNull()
    indent = F.greatest(F.lit(0), F.least(F.lit(4), F.floor((F.col("fx0") - F.col("page_left")) / 18))).cast("int")
    quote = (F.col("fx0") - F.col("page_left") > F.col("width") * 0.06) & ((F.col("x1") - F.col("x0") < F.col("width") * 0.74) | (F.col("style_size") < F.col("body_size") - 0.4))
    return p.select(
        "doc_id", "page", "block_no", "group", F.when(heading, "heading").when(item, "list_item").otherwise("paragraph").alias("kind"),
        F.when(heading, clean).when(item, T.strip(F.col("list.rest"))).otherwise(F.col("text")).alias("text"),
        F.when(heading, F.least(F.lit(cfg.heading_levels), F.greatest(base, depth))).alias("level"), F.when(heading, numbering).alias("numbering"),
        F.when(item, F.col("list.marker")).alias("marker"), F.when(item, F.col("list.ordered")).alias("ordered"), F.when(item, indent).alias("list_level"),
        F.when(~heading & ~item, F.when(F.coalesce(quote, F.lit(False)), "quote").otherwise("body")).alias("style"), "score", "x0", "y0", "x1", "y1", "confidence",
    )


def footnotes(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, note_no, marker, text): a note per marker line; text before the first marker is a note of its own, marked *."""
    w = Window.partitionBy("doc_id", "page", "block_no").orderBy("line_no")
    s = lines.where("n_chars > 0").join(hyphenation(lines).select("doc_id", "dehyphenate"), "doc_id")
    hit = F.col("stripped").rlike(T.FOOTNOTE)
    s = s.withColumn("note_no", F.sum(hit.cast("int")).over(w))
    s = s.withColumn("body", F.when(hit, T.strip(F.regexp_replace("stripped", T.FOOTNOTE, ""))).otherwise(F.col("stripped"))).withColumn("mark", F.when(hit, F.regexp_replace(F.regexp_extract("stripped", T.FOOTNOTE, 1), "^[\\[\\].)]+|[\\[\\].)]+$", "")))
    per = s.groupBy("doc_id", "page", "block_no", "note_no").agg(F.coalesce(F.max("mark"), F.lit("*")).alias("marker"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]).alias("texts"), F.first("dehyphenate").alias("d"))
    return per.select("doc_id", "page", "block_no", "note_no", "marker", T.join_lines(F.col("texts"), F.col("d")).alias("text"))


def body_lines(lines: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Lines outside the removed blocks (doc_id, page, block_no)."""
    kept = lines.where("n_chars > 0")
    return kept if removed is None else kept.join(removed.select(*LINE[:3]).distinct(), LINE[:3], "left_anti")

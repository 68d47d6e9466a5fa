"""Queries of the document operators and their SQL. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Options
from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators import guard, images, jobs, layout, payload, quality, reading_order, regions, render, rulings, semantics, tables_grid, tables_stream, triage
from foliospark.runtime import cut, table
from foliospark.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r4(*cols: str) -> list:
    return [F.round(c, 4).alias(c) for c in cols]


def r9(*cols: str) -> list:
    """Means of many decimals: nine places, so that no tie depends on the order of a sum."""
    return [F.round(c, 9).alias(c) for c in cols]


# --- SQL building blocks -------------------------------------------------------------------------------------------
WS = T.WS


def s_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def s_collapse(c: str) -> str:
    return s_strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


UNITED = f"""
uo AS (SELECT *, left_px * (72.0 / 300.0)::DOUBLE AS x0, top_px * (72.0 / 300.0)::DOUBLE AS y0, (left_px + width_px) * (72.0 / 300.0)::DOUBLE AS x1, (top_px + height_px) * (72.0 / 300.0)::DOUBLE AS y1 FROM (SELECT DISTINCT * FROM ocr_words) WHERE {s_strip("coalesce(text, '')")} <> '' AND coalesce(conf, -1) >= 40),
us AS (SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY block_num, par_num) - 1 AS INT) AS block_no, line_num AS line_no, CAST(row_number() OVER ln - 1 AS INT) AS span_no, text || CASE WHEN lead(text) OVER ln IS NOT NULL THEN ' ' ELSE '' END AS text, x0, y0, x1, y1,
  'OCR' AS font, round_even((y1 - y0) * 0.92::DOUBLE, 2) AS size, 0 AS flags, 0 AS color, greatest(0.0, least(1.0, conf / 100)) AS confidence FROM uo WINDOW ln AS (PARTITION BY doc_id, page, block_num, par_num, line_num ORDER BY word_num, text, left_px, top_px, width_px, height_px, conf)),
uh AS (SELECT DISTINCT doc_id, page FROM pages_info WHERE native_char_count >= 60 AND text_area_ratio >= 0.012 AND image_area_ratio >= 0.55),
ue AS (SELECT doc_id, page, block_no, min(x0) AS a0, min(y0) AS b0, max(x1) AS a1, max(y1) AS b1 FROM spans SEMI JOIN uh USING (doc_id, page) GROUP BY ALL),
ub AS (SELECT doc_id, page, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM us GROUP BY ALL),
uk AS (SELECT doc_id, page, block_no FROM ub ANTI JOIN ue ON ub.doc_id = ue.doc_id AND ub.page = ue.page AND greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) / CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN (x1 - x0) * (y1 - y0) ELSE 1.0 END >= 0.35),
ua AS (SELECT doc_id, page, max(block_no) + 1 AS after FROM spans GROUP BY ALL),
un AS (SELECT doc_id, page, block_no, line_no, span_no, text, x0, y0, x1, y1, font, size, flags, color, confidence FROM spans
 UNION ALL SELECT doc_id, page, block_no + coalesce(after, 0), line_no, span_no, text, x0, y0, x1, y1, font, size, flags, color, confidence FROM us SEMI JOIN uk USING (doc_id, page, block_no) LEFT JOIN ua USING (doc_id, page))"""
SPANS = f"""
s AS (SELECT *, length({s_strip('t')}) AS n,
  coalesce((flags & 16) <> 0, false) OR coalesce(regexp_matches(font, '(?i)(bold|black|heavy|semibold|demi)'), false) AS bold,
  coalesce((flags & 2) <> 0, false) OR coalesce(regexp_matches(font, '(?i)(italic|oblique)'), false) AS italic,
  coalesce((flags & 8) <> 0, false) AS mono, coalesce((flags & 1) <> 0, false) AS superscript
 FROM (SELECT DISTINCT *, coalesce(text, '') AS t FROM spans))"""
LINES = f"""{UNITED}, {SPANS.replace('FROM spans', 'FROM un')},
l0 AS (SELECT doc_id, page, block_no, line_no, string_agg(t, '' ORDER BY span_no) AS text,
  coalesce(sum(size * n) FILTER (n > 0) / sum(n) FILTER (n > 0), 0.0) AS size,
  arg_max(coalesce(font, ''), row(n, -span_no)) AS font,
  coalesce(sum(CASE WHEN bold THEN n ELSE 0 END) / nullif(sum(n), 0), 0.0) AS bold_ratio,
  coalesce(sum(CASE WHEN italic THEN n ELSE 0 END) / nullif(sum(n), 0), 0.0) AS italic_ratio,
  coalesce(avg(CASE WHEN n > 0 THEN confidence END), 1.0) AS confidence,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
 FROM s GROUP BY ALL),
l AS (SELECT *, {s_strip('text')} AS stripped, length({s_strip('text')}) AS n_chars, bold_ratio >= 0.7 AS is_bold, italic_ratio >= 0.7 AS is_italic FROM l0)"""
BLOCKS = f"""{LINES},
rb AS (SELECT doc_id, page, block_no, coalesce(string_agg(stripped, chr(10) ORDER BY line_no) FILTER (stripped <> ''), '') AS text,
  CAST(sum(n_chars) AS BIGINT) AS char_count, coalesce(sum(size * n_chars) FILTER (n_chars > 0) / sum(n_chars) FILTER (n_chars > 0), 0.0) AS size,
  coalesce(avg(CASE WHEN n_chars > 0 THEN confidence END), 1.0) AS confidence, count(*) FILTER (n_chars > 0) AS n_lines,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l GROUP BY ALL)"""
PAGES = "pg AS (SELECT DISTINCT * FROM pages_info)"
ROUTED = f"""{PAGES},
rt AS (SELECT *, CASE WHEN NOT ht AND ink THEN 'ocr' WHEN NOT ht THEN 'empty' WHEN dom THEN 'hybrid' ELSE 'native' END AS route, CASE WHEN NOT ht THEN ink ELSE dom END AS needs_ocr
 FROM (SELECT *, coalesce(native_char_count, 0) >= 60 AND coalesce(text_area_ratio, 0) >= 0.012 AS ht, coalesce(image_area_ratio, 0) >= 0.55 AS dom,
   coalesce(image_count, 0) > 0 OR coalesce(vector_line_count, 0) > 4 AS ink FROM pg))"""
ORDERED = """
b AS (SELECT DISTINCT * FROM blocks),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, CAST(kind = 'footnote' AS INT), round_even(y0, 1) NULLS FIRST, round_even(x0, 1) NULLS FIRST, seq NULLS FIRST, block_id) - 1 AS ord FROM b)"""


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of native text and of recognised pages."""
    return layout.text_lines(layout.united_spans(table(spark, sf, "spans"), table(spark, sf, "ocr_words"), routed_of(spark, sf).where("route = 'hybrid'")))


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return layout.raw_blocks(lines_of(spark, sf))


def native_blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return layout.raw_blocks(layout.text_lines(table(spark, sf, "spans")))


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages_info").distinct()


def routed_of(spark: SparkSession, sf: str) -> DataFrame:
    return triage.routes(table(spark, sf, "pages_info"))


def ordered_of(spark: SparkSession, sf: str) -> DataFrame:
    return reading_order.reading_order(table(spark, sf, "blocks"))


@query("span_geometry", "SELECT DISTINCT doc_id, page, block_no, line_no, span_no, round(x1 - x0, 4) AS width, round(y1 - y0, 4) AS height, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy, round(greatest(0, x1 - x0) * greatest(0, y1 - y0), 4) AS area FROM spans WHERE y0 IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
def span_geometry(spark, sf):
    s = table(spark, sf, "spans").where("y0 is not null and x0 is not null and x1 is not null and y1 is not null").distinct()
    return s.select("doc_id", "page", "block_no", "line_no", "span_no", F.round(G.width(), 4).alias("width"), F.round(G.height(), 4).alias("height"), F.round(G.cx(), 4).alias("cx"), F.round(G.cy(), 4).alias("cy"), F.round(G.area(), 4).alias("area")).distinct()


@query("span_styles", f"WITH {SPANS} SELECT doc_id, count(*) AS spans, CAST(sum(bold::INT) AS BIGINT) AS bold, CAST(sum(italic::INT) AS BIGINT) AS italic, CAST(sum(mono::INT) AS BIGINT) AS mono, CAST(sum(superscript::INT) AS BIGINT) AS superscript FROM s GROUP BY 1")
def span_styles(spark, sf):
    s = layout.span_styles(table(spark, sf, "spans"))
    return s.groupBy("doc_id").agg(F.count("*").alias("spans"), *[F.count_if(c).alias(c) for c in ("bold", "italic", "mono", "superscript")])


@query("line_text", f"WITH {LINES} SELECT doc_id, page, block_no, line_no, text, n_chars, round(size, 9) AS size, font, is_bold, is_italic, round(confidence, 9) AS confidence, x0, y0, x1, y1 FROM l")
def line_text(spark, sf):
    return lines_of(spark, sf).select("doc_id", "page", "block_no", "line_no", "text", "n_chars", *r9("size"), "font", "is_bold", "is_italic", *r9("confidence"), "x0", "y0", "x1", "y1")


@query("block_text", f"WITH {BLOCKS} SELECT doc_id, page, block_no, text, char_count, n_lines, round(size, 9) AS size, round(confidence, 9) AS confidence, x0, y0, x1, y1 FROM rb")
def block_text(spark, sf):
    return blocks_of(spark, sf).select("doc_id", "page", "block_no", "text", "char_count", "n_lines", *r9("size", "confidence"), "x0", "y0", "x1", "y1")


@query("page_envelopes", f"WITH {BLOCKS} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_blocks FROM rb GROUP BY ALL")
def page_envelopes(spark, sf):
    return layout.page_envelopes(blocks_of(spark, sf))


@query("spans_in_blocks", """WITH s AS (SELECT DISTINCT * FROM spans WHERE y0 IS NOT NULL), b AS (SELECT DISTINCT * FROM blocks WHERE y0 IS NOT NULL)
SELECT b.doc_id, b.block_id, count(*) AS n_spans, CAST(sum(length(s.text)) AS BIGINT) AS n_chars FROM b JOIN s ON b.doc_id = s.doc_id AND b.page = s.page
 AND (s.x0 + s.x1) / 2 BETWEEN b.x0 AND b.x1 AND (s.y0 + s.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY ALL""")
def spans_in_blocks(spark, sf):
    return reading_order.point_in_blocks(table(spark, sf, "spans").distinct(), table(spark, sf, "blocks").distinct())


@query("block_overlaps", f"""WITH {BLOCKS}, t AS (SELECT DISTINCT doc_id, page, block_id, x0 AS tx0, y0 AS ty0, x1 AS tx1, y1 AS ty1 FROM blocks WHERE kind = 'table' AND y0 IS NOT NULL),
j AS (SELECT rb.doc_id, rb.page, rb.block_no, t.block_id, rb.x0, rb.y0, rb.x1, rb.y1, tx0, ty0, tx1, ty1, least(x1, tx1) - greatest(x0, tx0) AS dx, least(y1, ty1) - greatest(y0, ty0) AS dy FROM rb JOIN t USING (doc_id, page) WHERE rb.y0 IS NOT NULL),
i AS (SELECT *, CASE WHEN dx <= 0 OR dy <= 0 THEN 0.0 ELSE dx * dy END AS inter, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS a, greatest(0, tx1 - tx0) * greatest(0, ty1 - ty0) AS ta FROM j)
SELECT doc_id, page, block_no, block_id, round(inter, 4) AS intersection, round(inter / (a + ta - inter), 4) AS iou, a > 0 AND inter / a >= 0.7 AS inside FROM i WHERE inter > 0""")
def block_overlaps(spark, sf):
    b = blocks_of(spark, sf).where("y0 is not null")
    t = table(spark, sf, "blocks").where("kind = 'table' and y0 is not null").select("doc_id", "page", "block_id", *[F.col(c).alias("t_" + c) for c in ("x0", "y0", "x1", "y1")]).distinct()
    j = b.join(t, ["doc_id", "page"]).withColumn("intersection", G.intersection("", "t_")).where("intersection > 0")
    return j.select("doc_id", "page", "block_no", "block_id", *r4("intersection"), F.round(G.iou("", "t_"), 4).alias("iou"), G.contained("", "t_", 0.7).alias("inside"))


@query("ocr_lines", f"""WITH w AS (SELECT DISTINCT * FROM ocr_words WHERE {s_strip("coalesce(text, '')")} <> '' AND coalesce(conf, -1) >= 40)
SELECT doc_id, page, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num) AS text, count(*) AS n_words, round(avg(least(1.0, greatest(0.0, conf / 100))), 9) AS confidence, round(min(left_px) * 0.24, 4) AS x0, round(max(left_px + width_px) * 0.24, 4) AS x1 FROM w GROUP BY ALL""")
def ocr_lines(spark, sf):
    return layout.ocr_lines(table(spark, sf, "ocr_words")).select("doc_id", "page", "block_num", "par_num", "line_num", "text", "n_words", F.round("confidence", 9).alias("confidence"), *r4("x0", "x1"))


@query("ocr_blocks", f"""WITH w AS (SELECT DISTINCT * FROM ocr_words WHERE {s_strip("coalesce(text, '')")} <> '' AND coalesce(conf, -1) >= 40),
l AS (SELECT doc_id, page, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num) AS text, count(*) AS n, avg(least(1.0, greatest(0.0, conf / 100))) AS c FROM w GROUP BY ALL)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY block_num, par_num) - 1 AS INT) AS number, text, CAST(n_words AS BIGINT) AS n_words FROM
 (SELECT doc_id, page, block_num, par_num, string_agg(text, chr(10) ORDER BY line_num) AS text, sum(n) AS n_words, round(sum(c * n) / sum(n), 4) AS c FROM l GROUP BY ALL)""")
def ocr_blocks(spark, sf):
    return layout.ocr_blocks(layout.ocr_lines(table(spark, sf, "ocr_words"))).select("doc_id", "page", "number", "text", "n_words")


@query("ocr_without_native", f"""WITH {UNITED}, w AS (SELECT doc_id, page, block_num, par_num, line_num, count(*) AS n FROM uo GROUP BY ALL),
ob AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY block_num, par_num) - 1 AS INT) AS number, n_words FROM (SELECT doc_id, page, block_num, par_num, CAST(sum(n) AS BIGINT) AS n_words FROM w GROUP BY ALL)),
nb AS (SELECT doc_id, page, min(x0) AS a0, min(y0) AS b0, max(x1) AS a1, max(y1) AS b1 FROM spans GROUP BY doc_id, page, block_no),
k AS (SELECT ub.doc_id, ub.page, block_no AS number FROM ub ANTI JOIN nb ON ub.doc_id = nb.doc_id AND ub.page = nb.page AND greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) / CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN (x1 - x0) * (y1 - y0) ELSE 1.0 END >= 0.35)
SELECT doc_id, page, number, n_words FROM ob JOIN k USING (doc_id, page, number)""")
def ocr_without_native(spark, sf):
    return layout.drop_native_duplicates(layout.ocr_blocks(layout.ocr_lines(table(spark, sf, "ocr_words"))), native_blocks_of(spark, sf)).select("doc_id", "page", "number", F.col("n_words").cast("bigint").alias("n_words"))


# --- triage --------------------------------------------------------------------------------------------------------
@query("page_routes", f"WITH {ROUTED} SELECT doc_id, page, route, needs_ocr FROM rt")
def page_routes(spark, sf):
    return routed_of(spark, sf).select("doc_id", "page", "route", "needs_ocr")


@query("route_histogram", f"WITH {ROUTED} SELECT doc_id, count(*) FILTER (route = 'native') AS native, count(*) FILTER (route = 'ocr') AS ocr, count(*) FILTER (route = 'hybrid') AS hybrid, count(*) FILTER (route = 'empty') AS empty FROM rt GROUP BY 1")
def route_histogram(spark, sf):
    return triage.histogram(routed_of(spark, sf))


@query("ocr_targets", f"WITH {ROUTED} SELECT doc_id, page, route FROM rt WHERE route IN ('ocr', 'hybrid')")
def ocr_targets(spark, sf):
    return triage.ocr_targets(routed_of(spark, sf)).select("doc_id", "page", "route")


@query("page_range_routes", f"WITH {PAGES} SELECT doc_id, page, CASE WHEN page NOT IN (1, 2, 5) THEN 'empty' WHEN coalesce(native_char_count, 0) >= 60 AND coalesce(text_area_ratio, 0) >= 0.012 THEN 'native' ELSE 'empty' END AS route, page NOT IN (1, 2, 5) AS excluded FROM pg")
def page_range_routes(spark, sf):
    return triage.routes(table(spark, sf, "pages_info"), mode="never", page_range=(1, 2, 5)).select("doc_id", "page", "route", "excluded")


# --- regions -------------------------------------------------------------------------------------------------------
OCR_BLOCKS = f"""ow AS (SELECT DISTINCT * FROM ocr_words WHERE {s_strip("coalesce(text, '')")} <> '' AND coalesce(conf, -1) >= 40),
ol AS (SELECT doc_id, page, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num) AS text, min(left_px) * (72.0 / 300.0)::DOUBLE AS x0, min(top_px) * (72.0 / 300.0)::DOUBLE AS y0, max(left_px + width_px) * (72.0 / 300.0)::DOUBLE AS x1, max(top_px + height_px) * (72.0 / 300.0)::DOUBLE AS y1 FROM ow GROUP BY ALL),
rb AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY block_num, par_num) - 1 AS INT) AS block_no, * EXCLUDE (doc_id, page, block_num, par_num) FROM (SELECT doc_id, page, block_num, par_num, string_agg(text, chr(10) ORDER BY line_num) AS text, CAST(sum(length(text)) AS BIGINT) AS char_count, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ol GROUP BY ALL))"""
BANDS = f"""{BLOCKS}, {PAGES}, pz AS (SELECT DISTINCT doc_id, page, width, height FROM pg WHERE height > 0),
bd AS (SELECT *, {s_collapse("regexp_replace(lower(text), '\\p{Nd}+', '#', 'g')")} AS key FROM (SELECT rb.*, CASE WHEN y1 <= height * 0.11 THEN 'header' WHEN y0 >= height - height * 0.11 THEN 'footer' END AS band FROM rb JOIN pz USING (doc_id, page)) WHERE band IS NOT NULL)"""
RECURRENT = f"""{BANDS}, np AS (SELECT doc_id, count(DISTINCT page) AS pages FROM pg GROUP BY 1 HAVING count(DISTINCT page) >= 2),
be AS (SELECT bd.* FROM bd SEMI JOIN np USING (doc_id)),
el AS (SELECT doc_id, band, count(DISTINCT page) AS eligible FROM be GROUP BY ALL),
rec AS (SELECT be.* FROM be JOIN (SELECT doc_id, band, key FROM be JOIN el USING (doc_id, band) WHERE length(key) >= 4 GROUP BY doc_id, band, key, eligible HAVING count(DISTINCT page) / greatest(1, eligible) >= 0.6) k USING (doc_id, band, key))"""


def recognised_of(spark, sf):
    """Recognised blocks in the shape of raw blocks."""
    b = layout.ocr_blocks(layout.ocr_lines(table(spark, sf, "ocr_words")))
    chars = F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return b.withColumn("block_no", F.col("number")).withColumn("char_count", chars)


def bands_of(spark, sf):
    return regions.band_blocks(blocks_of(spark, sf), pages_of(spark, sf))


def n_pages_of(spark, sf):
    return pages_of(spark, sf).groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))


@query("edge_bands", f"WITH {BANDS} SELECT doc_id, page, block_no, band, key FROM bd")
def edge_bands(spark, sf):
    return bands_of(spark, sf).select("doc_id", "page", "block_no", "band", "key")


@query("header_footer_recurrence", f"WITH {RECURRENT} SELECT doc_id, page, block_no, band, key FROM rec")
def header_footer_recurrence(spark, sf):
    return regions.recurrent_exact(bands_of(spark, sf), n_pages_of(spark, sf)).select("doc_id", "page", "block_no", "band", "key")


@query("boilerplate_chars", f"WITH {RECURRENT} SELECT doc_id, page, CAST(sum(char_count) AS BIGINT) AS boilerplate_chars, arg_min(text, block_no) FILTER (band = 'header') AS header_text, arg_min(text, block_no) FILTER (band = 'footer') AS footer_text FROM rec GROUP BY ALL")
def boilerplate_chars(spark, sf):
    return regions.boilerplate(regions.recurrent_exact(bands_of(spark, sf), n_pages_of(spark, sf)))


@query("header_footer_fuzzy")
def header_footer_fuzzy(spark, sf):
    return regions.recurrent_fuzzy(bands_of(spark, sf), n_pages_of(spark, sf)).select("doc_id", "page", "block_no", "band", "key")


@query("discarded_headers", f"WITH {RECURRENT}, k AS (SELECT doc_id, band, key, arg_min(text, row(page, block_no)) AS text, min(row(page, block_no)) AS first FROM rec GROUP BY ALL) SELECT doc_id, band, CAST(row_number() OVER (PARTITION BY doc_id, band ORDER BY first) AS INT) AS ord, text FROM k")
def discarded_headers(spark, sf):
    return regions.discarded(regions.recurrent_exact(bands_of(spark, sf), n_pages_of(spark, sf)))


@query("median_block_size", f"WITH {BLOCKS} SELECT doc_id, round(median(size), 4) AS median_size FROM rb WHERE size > 0 GROUP BY 1")
def median_block_size(spark, sf):
    return regions.median_sizes(blocks_of(spark, sf)).select("doc_id", *r4("median_size"))


@query("footnote_zones", f"""WITH {BLOCKS}, {PAGES}, pz AS (SELECT DISTINCT doc_id, page, height FROM pg), m AS (SELECT doc_id, median(size) AS ms FROM rb WHERE size > 0 GROUP BY 1)
SELECT doc_id, page, block_no, coalesce(size > 0 AND size <= 0.86 * ms AND y0 >= 0.72 * height, false) AS footnote_zone FROM rb LEFT JOIN pz USING (doc_id, page) LEFT JOIN m USING (doc_id)""")
def footnote_zones(spark, sf):
    return regions.footnote_zones(blocks_of(spark, sf), pages_of(spark, sf)).select("doc_id", "page", "block_no", "footnote_zone")


@query("column_gutters", f"""WITH {BLOCKS}, e AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM rb WHERE char_count > 0 GROUP BY ALL HAVING count(*) >= 6 AND max(x1) > min(x0)),
t AS (SELECT doc_id, page, frac, l + (r - l) * frac AS x FROM e, (SELECT unnest([0.44, 0.46, 0.48, 0.50, 0.52, 0.54, 0.56]::DOUBLE[]) AS frac)),
c AS (SELECT t.doc_id, t.page, frac, x, count(*) FILTER (x0 < x AND x < x1) AS crossing, count(*) FILTER (x1 <= x) AS ln, count(*) FILTER (x0 >= x) AS rn FROM rb JOIN t USING (doc_id, page) WHERE char_count > 0 GROUP BY ALL)
SELECT doc_id, page, round(arg_min(x, frac), 4) AS gutter FROM c WHERE crossing = 0 AND ln >= 3 AND rn >= 3 AND least(ln, rn) / greatest(ln, rn) >= 0.35 GROUP BY ALL""")
def column_gutters(spark, sf):
    return regions.columns(blocks_of(spark, sf)).select("doc_id", "page", *r4("gutter"))


# --- semantics -----------------------------------------------------------------------------------------------------
STYLES = f"""{LINES}, st AS (SELECT *, round_even(size * 2, 0) / 2 AS ss, is_bold AS sb FROM l WHERE n_chars > 0),
sw AS (SELECT doc_id, ss, sb, sum(n_chars) AS chars, min(row(page, block_no, line_no)) AS first FROM st GROUP BY ALL),
bs AS (SELECT doc_id, ss AS body_size, sb AS body_bold FROM sw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1)"""


@query("body_style", f"WITH {STYLES} SELECT doc_id, body_size, body_bold FROM bs")
def body_style(spark, sf):
    return semantics.body_styles(lines_of(spark, sf))


@query("heading_styles", f"""WITH {STYLES} SELECT doc_id, ss AS style_size, sb AS style_bold, row_number() OVER (PARTITION BY doc_id ORDER BY ss DESC, sb DESC) AS level FROM sw JOIN bs USING (doc_id)
WHERE NOT (ss = body_size AND sb = body_bold) AND (ss >= body_size + 0.75 OR (sb AND NOT body_bold AND ss >= body_size - 0.5)) QUALIFY level <= 6""")
def heading_styles(spark, sf):
    return semantics.heading_levels(lines_of(spark, sf))


@query("hyphenation_rate", f"WITH {LINES} SELECT doc_id, round(avg(CAST(regexp_matches(stripped, '[\\p{{L}}\\p{{N}}_]-$') AS DOUBLE)), 6) AS hyphen_rate, avg(CAST(regexp_matches(stripped, '[\\p{{L}}\\p{{N}}_]-$') AS DOUBLE)) >= 0.02 AS dehyphenate FROM l WHERE n_chars > 0 GROUP BY 1")
def hyphenation_rate(spark, sf):
    return semantics.hyphenation(lines_of(spark, sf)).select("doc_id", F.round("hyphen_rate", 6).alias("hyphen_rate"), "dehyphenate")


SPLIT = f"""{LINES}, pl AS (SELECT *, lag(y1) OVER w AS py1, lag(x1) OVER w AS px1, lag(size) OVER w AS psize, lag(is_bold) OVER w AS pbold, min(x0) OVER b AS bx0, max(x1) OVER b AS bx1, y0 - lag(y1) OVER w AS gap
 FROM l WHERE n_chars > 0 WINDOW w AS (PARTITION BY doc_id, page, block_no ORDER BY line_no), b AS (PARTITION BY doc_id, page, block_no)),
mg AS (SELECT doc_id, page, block_no, coalesce(median(gap) FILTER (gap >= 0), 0.0) AS mgap FROM pl GROUP BY ALL),
sp AS (SELECT doc_id, page, block_no, line_no, CASE WHEN psize IS NULL THEN 0 ELSE CAST(coalesce((mgap > 0 AND gap > mgap * 1.6) OR ((abs(size - psize) >= 0.6 OR is_bold <> pbold) AND px1 < bx1 - (bx1 - bx0) * 0.18)
  OR (x0 - bx0 > 8.0 AND px1 < bx1 - (bx1 - bx0) * 0.18) OR regexp_matches(stripped, '^{WS}*[-–—•▪◦·*]{WS}+\\S') OR regexp_matches(stripped, '^{WS}*\\(?\\d{{1,3}}[.)]{WS}+\\S'), false) AS INT) END AS new
 FROM pl JOIN mg USING (doc_id, page, block_no))"""


@query("paragraph_split", f"WITH {SPLIT} SELECT doc_id, page, block_no, line_no, CAST(sum(new) OVER (PARTITION BY doc_id, page, block_no ORDER BY line_no) AS BIGINT) AS \"group\" FROM sp")
def paragraph_split(spark, sf):
    return semantics.paragraph_lines(lines_of(spark, sf)).select("doc_id", "page", "block_no", "line_no", "group")


@query("typed_blocks")
def typed_blocks(spark, sf):
    return semantics.classify(lines_of(spark, sf), pages_of(spark, sf)).select("doc_id", "page", "block_no", "group", "kind", "text", "level", "numbering", "marker", "ordered", "list_level", "style", "score")


@query("footnote_split")
def footnote_split(spark, sf):
    return semantics.footnotes(lines_of(spark, sf))


DOC_LINES = "dl AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) - 1 AS seq FROM documents WHERE text IS NOT NULL)"


@query("list_markers", f"""WITH {DOC_LINES}, k AS (SELECT *, regexp_extract(line, '^{WS}*([-–—•▪◦·*]){WS}+\\S', 1) AS bullet, regexp_extract(line, '^{WS}*\\(?\\d{{1,3}}[.)]{WS}+\\S', 0) AS num, regexp_extract(line, '^{WS}*\\(?[a-zA-Z][.)]{WS}+\\S', 0) AS alpha FROM dl)
SELECT doc_id, CAST(seq AS INT) AS seq, CASE WHEN bullet <> '' THEN bullet WHEN num <> '' THEN {s_strip('left(num, length(num) - 1)')} ELSE {s_strip('left(alpha, length(alpha) - 1)')} END AS marker, bullet = '' AS ordered FROM k WHERE bullet <> '' OR num <> '' OR alpha <> ''""")
def list_markers(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\\r\\n|\\r|\\n")).alias("seq", "line"))
    m = d.select("doc_id", "seq", "line", T.list_marker(F.col("line")).alias("m")).where("m is not null")
    return m.select("doc_id", "seq", "m.marker", "m.ordered")


@query("markdown_blocks")
def markdown_blocks(spark, sf):
    return readers.markdown_blocks(table(spark, sf, "documents"))


@query("positioned_text", """WITH dl AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(pos // 20 + 1 AS INT) AS page, CAST(pos AS INT) AS line_no, line AS text, CAST(60 + (pos % 20) * 36 AS DOUBLE) AS y0, 56 + least(480.0, CAST(4.5 AS DOUBLE) * length(line)) AS x1 FROM dl""")
def positioned_text(spark, sf):
    return readers.text_lines(table(spark, sf, "documents")).select("doc_id", "page", "line_no", "text", "y0", "x1")


# --- rulings and tables --------------------------------------------------------------------------------------------
def drawings_of(spark, sf):
    """Drawn borders at the table blocks: 3 to 5 rows of 24 points and 2 to 3 columns, every border in two touching strokes."""
    b = table(spark, sf, "blocks").where("kind = 'table' and x0 is not null and y0 is not null and x1 > x0 + 48").select("doc_id", "page", "seq", "x0", "y0", "x1").distinct()
    b = b.withColumn("n", (F.col("seq") % 3 + 3).cast("int")).withColumn("m", (F.col("seq") % 2 + 2).cast("int")).withColumn("y1", F.col("y0") + F.col("n") * 24)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    h = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("y", F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("i") / F.col("n"))
    v = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m")))).withColumn("x", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / F.col("m"))
    line = lambda df, a, b_, c, d: df.select("doc_id", "page", F.lit("l").alias("op"), a.alias("x0"), b_.alias("y0"), c.alias("x1"), d.alias("y1"))
    return line(h, F.col("x0"), F.col("y"), mx, F.col("y")).unionByName(line(h, mx, F.col("y"), F.col("x1"), F.col("y"))).unionByName(line(v, F.col("x"), F.col("y0"), F.col("x"), my)).unionByName(line(v, F.col("x"), my, F.col("x"), F.col("y1")))


def segments_of(spark, sf):
    return rulings.merge_segments(rulings.from_drawings(drawings_of(spark, sf)))


DRAWN = """tb AS (SELECT DISTINCT doc_id, page, seq, x0, y0, x1, y0 + CAST(seq % 3 + 3 AS INT) * 24 AS y1, CAST(seq % 3 + 3 AS INT) AS n, CAST(seq % 2 + 2 AS INT) AS m FROM blocks WHERE kind = 'table' AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 > x0 + 48),
hh AS (SELECT doc_id, page, x0, x1, (x0 + x1) / 2 AS mx, y0 + (y1 - y0) * i / n AS y FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM tb)),
vv AS (SELECT doc_id, page, y0, y1, (y0 + y1) / 2 AS my, x0 + (x1 - x0) * i / m AS x FROM (SELECT *, unnest(range(0, m + 1)) AS i FROM tb)),
ru AS (SELECT doc_id, page, 'h' AS axis, y AS pos, x0 AS a, mx AS b FROM hh UNION SELECT doc_id, page, 'h', y, mx, x1 FROM hh UNION SELECT doc_id, page, 'v', x, y0, my FROM vv UNION SELECT doc_id, page, 'v', x, my, y1 FROM vv)"""
MERGED = f"""{DRAWN}, k0 AS (SELECT *, coalesce(CAST(pos - lag(pos) OVER w > 3.0 AS INT), 0) AS jump FROM ru WHERE b - a >= 12 WINDOW w AS (PARTITION BY doc_id, page, axis ORDER BY pos, a, b)),
k1 AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page, axis ORDER BY pos, a, b) AS bucket FROM k0),
k2 AS (SELECT *, avg(pos) OVER (PARTITION BY doc_id, page, axis, bucket) AS mid, coalesce(CAST(a > max(b) OVER (PARTITION BY doc_id, page, axis, bucket ORDER BY a, b, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3.0 AS INT), 0) AS nw FROM k1),
k3 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, page, axis, bucket ORDER BY a, b, pos) AS island FROM k2),
sg AS (SELECT doc_id, page, axis, bucket, island, any_value(mid) AS pos, min(a) AS a, max(b) AS b FROM k3 GROUP BY ALL HAVING max(b) - min(a) >= 12)"""


@query("merged_rulings", f"WITH {MERGED} SELECT doc_id, page, axis, round(pos, 4) AS pos, round(a, 4) AS start, round(b, 4) AS \"end\" FROM sg")
def merged_rulings(spark, sf):
    return segments_of(spark, sf).select("doc_id", "page", "axis", *r4("pos", "start", "end"))


@query("ruling_crossings", f"WITH {MERGED} SELECT h.doc_id, h.page, count(*) AS crossings FROM sg h JOIN sg v ON h.doc_id = v.doc_id AND h.page = v.page AND h.axis = 'h' AND v.axis = 'v' AND v.pos BETWEEN h.a - 3 AND h.b + 3 AND h.pos BETWEEN v.a - 3 AND v.b + 3 GROUP BY ALL")
def ruling_crossings(spark, sf):
    return rulings.crossings(segments_of(spark, sf), 3.0).groupBy("doc_id", "page").agg(F.count("*").alias("crossings"))


@query("border_clusters", f"""WITH {MERGED}, p AS (SELECT *, coalesce(CAST(pos - lag(pos) OVER (PARTITION BY doc_id, page, axis ORDER BY pos) > 3.0 AS INT), 0) AS nw FROM sg),
q AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, page, axis ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM p)
SELECT doc_id, page, axis, CAST(cluster AS BIGINT) AS cluster, round(avg(pos), 4) AS position, count(*) AS n FROM q GROUP BY ALL""")
def border_clusters(spark, sf):
    return rulings.cluster(segments_of(spark, sf), ["doc_id", "page", "axis"], "pos", 3.0).select("doc_id", "page", "axis", "cluster", *r4("position"), "n")


def grids_of(spark, sf):
    return rulings.grids(segments_of(spark, sf), pages_of(spark, sf))


@query("table_grids")
def table_grids(spark, sf):
    return grids_of(spark, sf).select("doc_id", "page", "grid", (F.size("rows") - 1).alias("n_rows"), (F.size("cols") - 1).alias("n_cols"), F.round(rulings.closed_ratio(), 4).alias("closed"))


@query("grid_cells")
def grid_cells(spark, sf):
    cell = tables_grid.cells(grids_of(spark, sf))
    texts = tables_grid.cell_texts(cell, layout.span_styles(table(spark, sf, "spans")))
    return cell.join(texts, ["doc_id", "page", "grid", "row", "col"], "left").select("doc_id", "page", "grid", "row", "col", "rowspan", "colspan", F.coalesce("text", F.lit("")).alias("text"))


@query("grid_tables")
def grid_tables(spark, sf):
    return tables_grid.grid_tables(grids_of(spark, sf), layout.span_styles(table(spark, sf, "spans"))).drop("x0", "y0", "x1", "y1")


@query("grid_alignment")
def grid_alignment(spark, sf):
    spans = layout.span_styles(table(spark, sf, "spans"))
    cell = tables_grid.cells(grids_of(spark, sf))
    return tables_grid.column_alignment(tables_grid.cell_texts(cell, spans), tables_grid.cell_alignment(cell, spans))


USABLE = f"uw AS (SELECT DISTINCT * FROM words WHERE {s_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} <> '' AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL)"
VISUAL = f"""{USABLE}, v0 AS (SELECT *, round_even((y0 + y1) / 2, 1) AS cyr FROM uw),
v1 AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM v0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY cyr, x0, word_no)),
v2 AS (SELECT *, CASE WHEN py0 IS NULL THEN 0 WHEN least(y1, py1) - greatest(y0, py0) <= 0 THEN 1 WHEN (least(y1, py1) - greatest(y0, py0)) / least(CASE WHEN y1 - y0 = 0 THEN 1.0 ELSE y1 - y0 END, CASE WHEN py1 - py0 = 0 THEN 1.0 ELSE py1 - py0 END) < 0.5 THEN 1 ELSE 0 END AS nw FROM v1),
vl AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, page ORDER BY cyr, x0, word_no) AS line FROM v2)"""


@query("visual_lines", f"WITH {VISUAL} SELECT doc_id, page, word_no, CAST(line AS BIGINT) AS line FROM vl")
def visual_lines(spark, sf):
    return tables_stream.visual_lines(tables_stream.usable_words(table(spark, sf, "words"))).select("doc_id", "page", "word_no", "line")


@query("word_spaces", f"WITH {VISUAL}, g AS (SELECT doc_id, page, lead(x0) OVER (PARTITION BY doc_id, page, line ORDER BY x0, word_no) - x1 AS gap FROM vl) SELECT doc_id, page, round(coalesce(median(gap) FILTER (gap > 0 AND gap < 40), 2.0), 4) AS space FROM g WHERE gap IS NOT NULL GROUP BY ALL")
def word_spaces(spark, sf):
    return tables_stream.median_spaces(tables_stream.line_gaps(tables_stream.visual_lines(tables_stream.usable_words(table(spark, sf, "words"))))).select("doc_id", "page", *r4("space"))


@query("borderless_tables")
def borderless_tables(spark, sf):
    t = table(spark, sf, "blocks").where("kind = 'table' and y0 is not null").select("doc_id", "page", "x0", "y0", "x1", "y1").distinct()
    tables, _ = tables_stream.stream_tables(tables_stream.usable_words(table(spark, sf, "words"), t))
    return tables.select("doc_id", "page", "run", "n_rows", "n_cols", *r4("fill", "stability"), "misplaced", "confidence")


# --- reading order -------------------------------------------------------------------------------------------------
@query("reading_order", f"WITH {ORDERED} SELECT doc_id, block_id, ord FROM o")
def reading_order_q(spark, sf):
    return ordered_of(spark, sf).select("doc_id", "block_id", "ord")


LINKS = f"""{ORDERED}, nx AS (SELECT *, lead(kind) OVER w AS nk, lead(page) OVER w AS np, lead(style) OVER w AS ns, lead(text) OVER w AS nt, lead(ord) OVER w AS no, lead(block_id) OVER w AS nb, lead(y0) OVER w AS ny0 FROM o WHERE kind <> 'page_break' WINDOW w AS (PARTITION BY doc_id ORDER BY ord))"""


@query("cross_page_paragraphs", f"""WITH {LINKS} SELECT doc_id, ord, no AS next_ord FROM nx WHERE kind = 'paragraph' AND nk = 'paragraph' AND np = page + 1 AND style IS NOT DISTINCT FROM ns
AND {s_strip("coalesce(text, '')")} <> '' AND {s_strip("coalesce(nt, '')")} <> '' AND NOT regexp_matches({s_strip("coalesce(text, '')")}, '[.!?;:»”"'']{WS}*$') AND regexp_matches({s_strip("coalesce(nt, '')")}, '^[a-zàáâãéêíóôõúç(\\[“"'']')""")
def cross_page_paragraphs(spark, sf):
    return reading_order.paragraph_links(ordered_of(spark, sf).where("kind <> 'page_break'"))


@query("stitched_paragraphs")
def stitched_paragraphs(spark, sf):
    return reading_order.stitch_paragraphs(ordered_of(spark, sf).where("kind <> 'page_break'"), True).select("doc_id", "block_id", "ord", "kind", "text", "pieces")


@query("page_breaks", f"""WITH {ORDERED}, q AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS pp FROM o WHERE kind <> 'page_break')
SELECT doc_id, printf('pb%05d', page) AS block_id, page FROM q WHERE pp IS NOT NULL AND pp <> page""")
def page_breaks(spark, sf):
    return reading_order.page_breaks(ordered_of(spark, sf)).where("kind = 'page_break'").select("doc_id", "block_id", "page")


@query("orphan_captions", f"WITH {LINKS} SELECT doc_id, block_id AS figure_id, nb AS caption_id, nt AS caption FROM nx WHERE kind = 'figure' AND nk = 'paragraph' AND np = page AND length(nt) <= 200 AND ns = 'body' AND ny0 - y1 BETWEEN 0 AND 24")
def orphan_captions(spark, sf):
    return reading_order.orphan_captions(ordered_of(spark, sf).where("kind <> 'page_break'"))


@query("caption_nearest")
def caption_nearest(spark, sf):
    b = table(spark, sf, "blocks").distinct()
    return reading_order.nearest_captions(b.where("kind = 'figure'"), b.where("kind in ('paragraph', 'heading')"))


@query("cross_page_tables", f"""WITH b AS (SELECT DISTINCT * FROM blocks WHERE kind = 'table' AND y0 IS NOT NULL AND y1 IS NOT NULL), {PAGES}, pz AS (SELECT DISTINCT doc_id, page, height FROM pg WHERE height IS NOT NULL),
t AS (SELECT b.*, CAST(2 AS INT) AS n_cols, height FROM b JOIN pz USING (doc_id, page)),
e AS (SELECT doc_id, page, arg_max(block_id, row(y1, seq)) AS lb, arg_max(y1, row(y1, seq)) AS ly1, any_value(height) AS h, arg_min(block_id, row(y0, seq)) AS fb, arg_min(y0, row(y0, seq)) AS fy0 FROM t GROUP BY ALL)
SELECT a.doc_id, a.lb AS block_id, n.fb AS next_id, a.page FROM e a JOIN e n ON a.doc_id = n.doc_id AND n.page = a.page + 1 WHERE a.ly1 >= 0.78 * a.h AND n.fy0 <= 0.28 * n.h""")
def cross_page_tables(spark, sf):
    t = table(spark, sf, "blocks").where("kind = 'table'").distinct().withColumn("n_cols", F.lit(2))
    return reading_order.table_links(t, pages_of(spark, sf))


@query("table_chains")
def table_chains(spark, sf):
    t = table(spark, sf, "blocks").where("kind = 'table'").distinct().withColumn("n_cols", F.lit(2))
    return reading_order.chain_tables(t, reading_order.table_links(t, pages_of(spark, sf)))


# --- quality -------------------------------------------------------------------------------------------------------
PRODUCED = "pr AS (SELECT doc_id, page, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS produced FROM (SELECT DISTINCT * FROM blocks) WHERE kind <> 'page_break' GROUP BY ALL)"
COVERAGE = f"{RECURRENT}, {OCR_BLOCKS.replace('rb AS', 'orb AS')}, {PRODUCED}, oc AS (SELECT doc_id, page, CAST(sum(char_count) AS BIGINT) AS ocr_chars FROM orb GROUP BY ALL), bo AS (SELECT doc_id, page, CAST(sum(char_count) AS BIGINT) AS boil FROM rec GROUP BY ALL), ex AS (SELECT doc_id, page, greatest(0, max(coalesce(native_char_count, 0)) + max(coalesce(ocr_chars, 0)) - max(coalesce(boil, 0))) AS expected FROM pg LEFT JOIN oc USING (doc_id, page) LEFT JOIN bo USING (doc_id, page) GROUP BY ALL), cv AS (SELECT doc_id, page, expected, coalesce(produced, 0) AS produced, CASE WHEN expected > 0 THEN coalesce(produced, 0) / expected END AS coverage FROM ex LEFT JOIN pr USING (doc_id, page))"


def produced_of(spark, sf):
    return quality.produced_chars(table(spark, sf, "blocks"))


def recurrent_of(spark, sf):
    """Blocks of running headers and footers."""
    return regions.recurrent_exact(bands_of(spark, sf), n_pages_of(spark, sf))


def coverage_of(spark, sf, recurrent=None, produced=None):
    native = pages_of(spark, sf).groupBy("doc_id", "page").agg(F.max(F.coalesce("native_char_count", F.lit(0))).alias("native"))
    ocr = recognised_of(spark, sf).groupBy("doc_id", "page").agg(F.sum("char_count").alias("ocr_chars"))
    dropped = regions.boilerplate(recurrent_of(spark, sf) if recurrent is None else recurrent).select("doc_id", "page", "boilerplate_chars")
    j = native.join(ocr, ["doc_id", "page"], "left").join(dropped, ["doc_id", "page"], "left").na.fill(0, ["ocr_chars", "boilerplate_chars"])
    expected = j.select("doc_id", "page", F.greatest(F.lit(0), F.col("native") + F.col("ocr_chars") - F.col("boilerplate_chars")).alias("expected"))
    return quality.page_coverage(expected, produced_of(spark, sf) if produced is None else produced)


@query("page_coverage", f"WITH {COVERAGE} SELECT doc_id, page, expected, produced, round(coverage, 6) AS coverage FROM cv")
def page_coverage(spark, sf):
    return coverage_of(spark, sf).select("doc_id", "page", "expected", "produced", F.round("coverage", 6).alias("coverage"))


@query("document_coverage", f"WITH {COVERAGE}, d AS (SELECT doc_id, CAST(sum(expected) AS BIGINT) AS source_chars, CAST(sum(produced) AS BIGINT) AS markdown_chars FROM cv GROUP BY 1), r AS (SELECT *, CASE WHEN source_chars > 0 THEN markdown_chars / source_chars WHEN markdown_chars = 0 THEN 1.0 ELSE 0.0 END AS raw FROM d) SELECT doc_id, source_chars, markdown_chars, round(raw, 4) AS coverage_raw, round(least(1.0, raw), 4) AS coverage FROM r")
def document_coverage(spark, sf):
    return quality.document_coverage(coverage_of(spark, sf))


@query("lossy_pages", f"WITH {COVERAGE} SELECT doc_id, page, expected, produced, round(coverage, 3) AS coverage FROM cv WHERE expected >= 40 AND produced / expected < 0.75")
def lossy_pages(spark, sf):
    return quality.lossy_pages(coverage_of(spark, sf))


@query("worst_lossy_pages", f"WITH {COVERAGE} SELECT doc_id, page, round(coverage, 3) AS coverage FROM cv WHERE expected >= 40 AND produced / expected < 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(coverage, 3), page) <= 20")
def worst_lossy_pages(spark, sf):
    return quality.worst_lossy(quality.lossy_pages(coverage_of(spark, sf))).select("doc_id", "page", "coverage")


@query("empty_pages", f"WITH {ROUTED}, {PRODUCED} SELECT doc_id, page, route FROM rt LEFT JOIN pr USING (doc_id, page) WHERE coalesce(produced, 0) = 0 AND (route <> 'empty' OR needs_ocr)")
def empty_pages(spark, sf):
    return quality.empty_pages(routed_of(spark, sf), produced_of(spark, sf))


SAMPLE = f"""{ROUTED}, sm0 AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, page FROM rt WHERE route IN ('native', 'hybrid'))),
sm AS (SELECT doc_id, page FROM sm0 WHERE i % greatest(1, n // 12) = 0 AND i / greatest(1, n // 12) < 12)"""


@query("sampled_pages", f"WITH {SAMPLE} SELECT doc_id, page FROM sm")
def sampled_pages(spark, sf):
    return quality.sampled_pages(triage.native_pages(routed_of(spark, sf)))


@query("second_opinion", f"""WITH {SAMPLE}, {PRODUCED}, ot AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS other FROM (SELECT DISTINCT * FROM words WHERE text IS NOT NULL) GROUP BY ALL),
j AS (SELECT doc_id, page, other, coalesce(produced, 0) AS produced, greatest(1, other) AS comparable, coalesce(produced, 0) / greatest(1, other) AS ratio FROM sm JOIN ot USING (doc_id, page) LEFT JOIN pr USING (doc_id, page))
SELECT doc_id, page, other, comparable, produced, round(ratio, 3) AS ratio FROM j WHERE comparable >= 40 AND (ratio < 0.8 OR ratio > 1.6)""")
def second_opinion(spark, sf):
    other = table(spark, sf, "words").where("text is not null").distinct().groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("other"))
    none = pages_of(spark, sf).select("doc_id", "page", F.lit(0).cast("long").alias("boilerplate_chars")).distinct()
    return quality.second_opinion(quality.sampled_pages(triage.native_pages(routed_of(spark, sf))), other, produced_of(spark, sf), none)


LEXICAL = """lx AS (SELECT doc_id, unnest(regexp_extract_all(left(text, 60000), '[\\p{L}\\p{Nl}\\p{No}]{2,}')) AS t FROM documents WHERE text IS NOT NULL),
sx AS (SELECT doc_id, t, (length(t) >= 4 AND NOT regexp_matches(t, '[aeiouáàâãéêíóôõúüAEIOUÁÀÂÃÉÊÍÓÔÕÚÜ]')) OR len(list_filter(range(1, length(t) - 2), lambda i: t[i] = t[i + 1] AND t[i] = t[i + 2] AND t[i] = t[i + 3])) > 0
  OR (length(t) >= 5 AND regexp_matches(substr(t, 2), '\\p{Lu}') AND regexp_matches(substr(t, 2), '\\p{Ll}') AND len(list_filter(range(1, length(t)), lambda i: (upper(t[i]) = t[i] AND lower(t[i]) <> t[i]) <> (upper(t[i + 1]) = t[i + 1] AND lower(t[i + 1]) <> t[i + 1]))) >= 3) AS suspect FROM lx),
ls AS (SELECT d.doc_id, count(t) AS tokens, count(*) FILTER (suspect) AS suspect_tokens FROM documents d LEFT JOIN sx USING (doc_id) GROUP BY 1)"""


@query("lexical_sanity", f"WITH {LEXICAL} SELECT doc_id, CAST(tokens AS INT) AS tokens, CAST(suspect_tokens AS INT) AS suspect_tokens, CASE WHEN tokens > 0 THEN round(suspect_tokens / tokens, 4) ELSE 0.0 END AS suspect_ratio FROM ls")
def lexical_sanity(spark, sf):
    return quality.lexical_sanity(table(spark, sf, "documents")).withColumns({c: F.col(c).cast("int") for c in ("tokens", "suspect_tokens")})


@query("doc_verdict", f"""WITH {LEXICAL}, v AS (SELECT doc_id, tokens, suspect_tokens, CASE WHEN tokens > 0 THEN round(suspect_tokens / tokens, 4) ELSE 0.0 END AS suspect_ratio, CASE WHEN coalesce(n_chars, 0) > 0 THEN round(100 * least(1.0, coalesce(length(text), 0) / n_chars), 1) ELSE 100.0 END AS coverage_pct FROM ls JOIN documents USING (doc_id))
SELECT doc_id, CAST(tokens AS INT) AS tokens, suspect_ratio, coverage_pct, CASE WHEN coverage_pct < 85 THEN 'revisar' WHEN tokens >= 200 AND suspect_ratio > 0.06 THEN 'atencao' ELSE 'ok' END AS status FROM v""")
def doc_verdict(spark, sf):
    """Which documents need a person to look at them: lexical sanity and coverage to a verdict."""
    d = table(spark, sf, "documents")
    lex = quality.lexical_sanity(d)
    cov = F.when(F.coalesce("n_chars", F.lit(0)) > 0, F.round(F.least(F.lit(1.0), F.coalesce(F.char_length("text"), F.lit(0)) / F.col("n_chars")) * 100, 1)).otherwise(100.0)
    j = lex.join(d.select("doc_id", cov.alias("coverage_pct")), "doc_id")
    alert = ((F.col("tokens") >= 200) & (F.col("suspect_ratio") > 0.06)).cast("int")
    return j.select("doc_id", F.col("tokens").cast("int").alias("tokens"), "suspect_ratio", "coverage_pct", quality.verdict(F.lit(0), alert, F.col("coverage_pct"), F.lit(0)).alias("status"))


@query("ocr_confidence", f"WITH w AS (SELECT DISTINCT * FROM ocr_words WHERE coalesce(conf, -1) >= 40 AND {s_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} <> ''), p AS (SELECT doc_id, page, avg(conf) AS c FROM w GROUP BY ALL) SELECT doc_id, count(*) AS pages, round(avg(c), 2) AS ocr_mean FROM p GROUP BY 1")
def ocr_confidence(spark, sf):
    return quality.ocr_confidence(table(spark, sf, "ocr_words"))


@query("block_kind_counts", "SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("heading", "paragraph", "list_item", "table", "figure", "footnote")) + " FROM (SELECT DISTINCT * FROM blocks) WHERE kind <> 'page_break' GROUP BY 1")
def block_kind_counts(spark, sf):
    b = table(spark, sf, "blocks").distinct().where("kind <> 'page_break'")
    return b.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("heading", "paragraph", "list_item", "table", "figure", "footnote")])


@query("tables_to_review", "SELECT doc_id, count(*) AS total, count(*) FILTER (needs_review) AS to_review, count(*) FILTER (confidence < 0.65) AS below FROM (SELECT DISTINCT * FROM blocks) WHERE kind = 'table' GROUP BY 1")
def tables_to_review(spark, sf):
    b = table(spark, sf, "blocks").distinct().where("kind = 'table'")
    return b.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("to_review"), F.count_if(F.coalesce(F.col("confidence") < 0.65, F.lit(False))).alias("below"))


def files_images_of(spark, sf):
    """(doc_id, declared, extracted, vector, suppressed): pictures the pages declare, figure blocks that came out, whole-page scans left out."""
    scans = F.sum(((F.col("route") == "ocr") & (F.coalesce("image_count", F.lit(0)) == 1)).cast("long"))
    declared = routed_of(spark, sf).groupBy("doc_id").agg(F.sum(F.coalesce("image_count", F.lit(0))).alias("declared"), scans.alias("suppressed"))
    figures = table(spark, sf, "blocks").distinct().where("kind = 'figure'").groupBy("doc_id").agg(F.count("*").alias("extracted"), F.count_if(F.coalesce("engine", F.lit("")) == "vector").alias("vector"))
    return declared.join(figures, "doc_id", "left").na.fill(0, ["extracted", "vector"])


def second_of(spark, sf, recurrent=None, produced=None):
    other = table(spark, sf, "words").where("text is not null").distinct().groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("other"))
    dropped = regions.boilerplate(recurrent_of(spark, sf) if recurrent is None else recurrent).select("doc_id", "page", "boilerplate_chars")
    return quality.second_opinion(quality.sampled_pages(triage.native_pages(routed_of(spark, sf))), other, produced_of(spark, sf) if produced is None else produced, dropped)


def lexical_of(spark, sf):
    return quality.lexical_sanity(table(spark, sf, "blocks").distinct().where("kind <> 'page_break' and text is not null"))


def ocr_pages_of(spark, sf):
    return quality.ocr_pages(routed_of(spark, sf), table(spark, sf, "ocr_words"))


class Facts(NamedTuple):
    """What warnings, verdict and report all need, computed once."""

    recurrent: DataFrame
    coverage: DataFrame
    lexical: DataFrame
    recognised: DataFrame
    second: DataFrame


def facts_of(spark, sf) -> Facts:
    recurrent, produced = cut(recurrent_of(spark, sf)), cut(produced_of(spark, sf))
    return Facts(recurrent, cut(coverage_of(spark, sf, recurrent, produced)), cut(lexical_of(spark, sf)), cut(ocr_pages_of(spark, sf)), cut(second_of(spark, sf, recurrent, produced)))


def warnings_of(spark, sf, facts: Facts):
    tables = table(spark, sf, "blocks").distinct().where("kind = 'table'")
    return quality.warnings(routed_of(spark, sf), facts.coverage, tables, facts.lexical, facts.recognised, facts.second, files_images_of(spark, sf))


def _branch(code: str, severity: str, ctes: str, rows: str, n: str = "count(*)", group: str = "GROUP BY doc_id") -> str:
    return f"SELECT * FROM (WITH {ctes} SELECT doc_id, '{code}' AS code, '{severity}' AS severity, CAST({n} AS BIGINT) AS n FROM {rows} {group})"


OCR_PAGES = f"""{ROUTED}, pw AS (SELECT doc_id, page, count(*) AS nw, avg(conf) AS c FROM (SELECT DISTINCT * FROM ocr_words) WHERE coalesce(conf, -1) >= 40 AND {s_strip("coalesce(text, '')")} <> '' GROUP BY ALL),
rp AS (SELECT doc_id, page, coalesce(nw, 0) AS nw, c FROM (SELECT DISTINCT doc_id, page FROM rt WHERE route IN ('ocr', 'hybrid')) FULL JOIN pw USING (doc_id, page))"""
SECOND = f"""{RECURRENT}, {SAMPLE.replace(PAGES + ",", "", 1)}, {PRODUCED}, bo AS (SELECT doc_id, page, CAST(sum(char_count) AS BIGINT) AS boil FROM rec GROUP BY ALL), ot AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS other FROM (SELECT DISTINCT * FROM words WHERE text IS NOT NULL) GROUP BY ALL),
sj AS (SELECT doc_id, page, other, coalesce(produced, 0) AS produced, greatest(1, other - coalesce(boil, 0)) AS comparable FROM sm JOIN ot USING (doc_id, page) LEFT JOIN pr USING (doc_id, page) LEFT JOIN bo USING (doc_id, page)),
so AS (SELECT *, produced / comparable AS ratio FROM sj WHERE comparable >= 40 AND (produced / comparable < 0.8 OR produced / comparable > 1.6))"""
BLOCK_LEXICAL = LEXICAL.replace("left(text, 60000)", "text").replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT DISTINCT * FROM blocks) WHERE kind <> 'page_break' AND text IS NOT NULL").replace("FROM documents d", "FROM (SELECT DISTINCT doc_id FROM blocks WHERE kind <> 'page_break' AND text IS NOT NULL) d")
FILE_IMAGES = f"""{ROUTED}, im AS (SELECT doc_id, sum(coalesce(image_count, 0)) AS declared, count(*) FILTER (route = 'ocr' AND coalesce(image_count, 0) = 1) AS suppressed FROM rt GROUP BY 1),
fg AS (SELECT doc_id, count(*) AS extracted, count(*) FILTER (coalesce(engine, '') = 'vector') AS vector FROM (SELECT DISTINCT * FROM blocks) WHERE kind = 'figure' GROUP BY 1),
fi AS (SELECT doc_id, declared, suppressed, coalesce(extracted, 0) AS extracted, coalesce(vector, 0) AS vector FROM im LEFT JOIN fg USING (doc_id))"""
WARNINGS = " UNION ALL ".join(
    [
        _branch("PAGES_EMPTY", "info", ROUTED, "rt WHERE route = 'empty' AND NOT needs_ocr"),
        _branch("OCR_NO_TEXT", "error", OCR_PAGES, "rp WHERE nw = 0"),
        _branch("OCR_LOW_CONFIDENCE", "warning", OCR_PAGES, "rp WHERE nw > 0 AND c < 70"),
        _branch("TABLE_LOW_CONFIDENCE", "warning", "tb AS (SELECT DISTINCT * FROM blocks)", "tb WHERE kind = 'table' AND confidence < 0.65"),
        _branch("PAGE_TEXT_LOSS", "warning", COVERAGE, "cv WHERE expected >= 40 AND produced / expected < 0.75"),
        _branch("PAGE_NO_TEXT", "error", f"{ROUTED}, {PRODUCED}", "rt LEFT JOIN pr USING (doc_id, page) WHERE coalesce(produced, 0) = 0 AND (route <> 'empty' OR needs_ocr)"),
        _branch("EXTRACTOR_DISAGREEMENT", "warning", SECOND, "so"),
        _branch("OCR_QUALITY_SUSPECT", "warning", BLOCK_LEXICAL, "ls WHERE tokens >= 200 AND round(suspect_tokens / tokens, 4) > 0.06", "suspect_tokens", ""),
        _branch("IMAGES_MISSING", "warning", FILE_IMAGES, "fi WHERE declared > suppressed AND greatest(0, extracted - vector) < 0.6 * (declared - suppressed)", "declared", ""),
    ]
)


@query("document_warnings", f"SELECT * FROM ({WARNINGS})")
def document_warnings(spark, sf):
    return warnings_of(spark, sf, facts_of(spark, sf))


@query("second_opinion_net", f"WITH {SECOND} SELECT doc_id, page, other, comparable, produced, round(ratio, 3) AS ratio FROM so")
def second_opinion_net(spark, sf):
    """The second opinion with running headers taken off the other reading."""
    return second_of(spark, sf)


SUMMARY = f"""SELECT doc_id, CASE WHEN errors > 0 OR pct < 85 THEN 'revisar' WHEN alerts > 0 OR to_review > 0 THEN 'atencao' ELSE 'ok' END AS status, pct AS cobertura_texto_pct, errors AS erros, alerts AS avisos,
 concat_ws('; ', CASE WHEN empty > 0 THEN CAST(empty AS INT) || ' página(s) sem texto' END, CASE WHEN to_review > 0 THEN CAST(to_review AS INT) || ' tabela(s) para conferir' END, CASE WHEN ocr_mean < 80 THEN 'OCR com confiança média de ' || CAST(round_even(ocr_mean, 0) AS INT) || '%' END, CASE WHEN suspect_ratio * 100 > 6 THEN printf('%.1f', suspect_ratio * 100) || '% de palavras improváveis' END) AS pendencias
FROM (WITH {COVERAGE} SELECT doc_id, round(100 * round(least(1.0, CASE WHEN sum(expected) > 0 THEN sum(produced) / sum(expected) WHEN sum(produced) = 0 THEN 1.0 ELSE 0.0 END), 4), 1) AS pct FROM cv GROUP BY 1)
LEFT JOIN (SELECT doc_id, count(*) FILTER (severity = 'error') AS errors0, count(*) FILTER (severity = 'warning') AS alerts0, max(n) FILTER (code = 'PAGE_NO_TEXT') AS empty FROM ({WARNINGS}) GROUP BY 1) w USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) FILTER (needs_review) AS to_review FROM (SELECT DISTINCT * FROM blocks) WHERE kind = 'table' GROUP BY 1) t USING (doc_id)
LEFT JOIN ({SQL["ocr_confidence"]}) o USING (doc_id)
LEFT JOIN (WITH {BLOCK_LEXICAL} SELECT doc_id, CASE WHEN tokens > 0 THEN round(suspect_tokens / tokens, 4) ELSE 0.0 END AS suspect_ratio FROM ls) l USING (doc_id),
LATERAL (SELECT coalesce(errors0, 0) AS errors, coalesce(alerts0, 0) AS alerts)"""


def summary_of(spark, sf, facts: Facts):
    """Facts of every file that its verdict and its report need."""
    w = warnings_of(spark, sf, facts).groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("erros"), F.count_if(F.col("severity") == "warning").alias("avisos"), F.max(F.when(F.col("code") == "PAGE_NO_TEXT", F.col("n"))).alias("empty"), F.max(F.when(F.col("code") == "PAGE_TEXT_LOSS", F.col("n"))).alias("lossy"), F.sort_array(F.collect_list(F.struct("code", "severity", "n"))).alias("warnings"))
    j = quality.document_coverage(facts.coverage).join(w, "doc_id", "left").join(tables_to_review(spark, sf), "doc_id", "left")
    j = j.join(quality.ocr_confidence(table(spark, sf, "ocr_words")), "doc_id", "left").join(facts.lexical, "doc_id", "left")
    j = j.na.fill(0, ["erros", "avisos", "empty", "lossy", "to_review", "total", "below", "pages"]).withColumn("pct", F.round(F.col("coverage") * 100, 1))
    status = quality.verdict(F.col("erros"), F.col("avisos"), F.col("pct"), F.col("to_review"))
    return j.withColumn("status", status).withColumn("pendencias", quality.pending(F.col("empty"), F.col("to_review"), F.col("ocr_mean"), F.col("suspect_ratio") * 100))


@query("report_summary", SUMMARY)
def report_summary(spark, sf):
    """Verdict, counts and pending points of every file."""
    return summary_of(spark, sf, facts_of(spark, sf)).select("doc_id", "status", F.col("pct").alias("cobertura_texto_pct"), "erros", "avisos", F.array_join("pendencias", "; ").alias("pendencias"))


@query("report_documents")
def report_documents(spark, sf):
    """The JSON report of every file with all its sections."""
    facts = facts_of(spark, sf)
    j = summary_of(spark, sf, facts)
    b = table(spark, sf, "blocks").distinct()
    per = lambda df, name, *cols: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    tables = per(b.where("kind = 'table'"), "detalhe", F.col("block_id").alias("id"), F.col("page").alias("pagina"), F.col("engine").alias("motor"), F.round("confidence", 3).alias("confianca"), F.coalesce("needs_review", F.lit(False)).alias("revisar"), F.col("review_reason").alias("motivo"))
    heads = regions.discarded(facts.recurrent)
    removed = heads.groupBy("doc_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("band") == k, F.struct("ord", "text")))).alias(k) for k in ("header", "footer")])
    rp = facts.recognised.select("doc_id", "page", F.round("ocr_mean", 2).alias("confianca_ocr"))
    chars = recognised_of(spark, sf).groupBy("doc_id", "page").agg(F.sum("char_count").alias("caracteres_ocr"))
    first = facts.recurrent.groupBy("doc_id", "page").agg(*[F.min_by(F.when(F.col("band") == k, F.col("text")), F.when(F.col("band") == k, F.col("block_no"))).alias(n) for k, n in (("header", "cabecalho"), ("footer", "rodape"))])
    pages = routed_of(spark, sf).join(rp, ["doc_id", "page"], "left").join(chars, ["doc_id", "page"], "left").join(first, ["doc_id", "page"], "left")
    pages = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"), F.sort_array(F.collect_list(F.struct(F.col("page").alias("numero"), F.col("route").alias("rota"), F.col("native_char_count").alias("caracteres_nativos"), "caracteres_ocr", "confianca_ocr", F.col("image_count").alias("imagens"), "cabecalho", "rodape"))).alias("paginas"))
    counts = block_kind_counts(spark, sf).select("doc_id", F.struct("heading", "paragraph", "list_item", "table", "figure", "footnote").alias("blocos"))
    styles = heading_styles(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("level", "style_size", "style_bold"))).alias("niveis_de_titulo"))
    boiler = regions.boilerplate(facts.recurrent).groupBy("doc_id").agg(F.sum("boilerplate_chars").alias("boil"))
    joined = cross_page_paragraphs(spark, sf).groupBy("doc_id").agg(F.count("*").alias("joined"))
    promoted = orphan_captions(spark, sf).groupBy("doc_id").agg(F.count("*").alias("promoted"))
    second = facts.second.groupBy("doc_id").agg(F.count("*").alias("second"))
    engines = b.where("kind = 'table'").groupBy("doc_id", F.coalesce("engine", F.lit("")).alias("engine")).agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("engine", "c"))).alias("motores"))
    for part in (tables, removed, pages, counts, styles, body_style(spark, sf), hyphenation_rate(spark, sf), boiler, joined, promoted, second, engines, files_images_of(spark, sf)):
        j = j.join(part, "doc_id", "left")
    j = j.na.fill(0, ["boil", "joined", "promoted", "second", "declared", "extracted", "vector"])
    pct = lambda c, n: F.round(F.col(c) * 100, n)
    sections = j.select(
        "doc_id", F.col("pct").alias("text_accuracy"), F.col("total").alias("tables_detected"), F.col("extracted").alias("images_extracted"), "warnings", F.lit("2.17").alias("schema_version"),
        F.struct(F.col("doc_id").alias("arquivo"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("bigint").alias("bytes"), F.col("n_pages").alias("paginas"), *[F.lit(None).cast("string").alias(c) for c in ("titulo_pdf", "autor_pdf", "produtor_pdf")], F.concat(T.safe_stem(F.col("doc_id")), F.lit(".md")).alias("arquivo_markdown")).alias("documento"),
        F.struct(pct("coverage", 2).alias("cobertura_texto_pct"), pct("coverage_raw", 2).alias("cobertura_bruta_pct"), F.col("source_chars").alias("caracteres_origem_uteis"), F.col("boil").alias("caracteres_boilerplate_descartados"), F.col("markdown_chars").alias("caracteres_markdown"), F.col("empty").alias("paginas_sem_texto"), F.col("lossy").alias("paginas_com_perda"), F.col("second").alias("segunda_opiniao")).alias("fidelidade"),
        F.struct(F.col("pages").alias("paginas_com_ocr"), F.lit(Options().language).alias("idioma"), F.col("ocr_mean").alias("confianca_media_pct"), pct("suspect_ratio", 2).alias("palavras_suspeitas_pct"), F.col("tokens").alias("tokens_avaliados")).alias("ocr"),
        F.struct("total", F.col("to_review").alias("para_revisar"), F.col("below").alias("abaixo_do_limiar"), F.col("motores").alias("motores_de_reserva"), "detalhe").alias("tabelas"),
        F.struct(F.col("extracted").alias("extraidas"), F.col("declared").alias("declaradas_no_pdf"), F.col("vector").alias("figuras_vetoriais"), F.array().cast("array<string>").alias("arquivos")).alias("imagens"),
        F.struct("blocos", F.struct("body_size", "body_bold").alias("estilo_do_corpo"), "niveis_de_titulo", F.col("dehyphenate").alias("dehifenizacao"), F.col("joined").alias("paragrafos_unidos_entre_paginas"), F.col("promoted").alias("legendas_promovidas"), F.col("header.text").alias("cabecalhos_removidos"), F.col("footer.text").alias("rodapes_removidos")).alias("estrutura"),
        "paginas", F.struct(F.array().cast("array<string>").alias("estagios"), F.struct(*[F.lit(v if not isinstance(v, tuple) else str(v)).alias(k) for k, v in vars(Options()).items()]).alias("opcoes")).alias("execucao"),
        F.struct(F.lit("null").alias("provedor")).alias("ia"), F.struct("status", F.col("pct").alias("cobertura_texto_pct"), "erros", "avisos", "pendencias").alias("resumo"),
    )
    return quality.report_json(sections)


# --- rendering -----------------------------------------------------------------------------------------------------
@query("escaped_texts", f"SELECT DISTINCT doc_id, block_id, regexp_replace(text, '^({WS}*)([#>*+\\-=]|\\d+[.)])({WS})', '\\1\\\\\\2\\3') AS escaped FROM blocks WHERE text IS NOT NULL")
def escaped_texts(spark, sf):
    return table(spark, sf, "blocks").where("text is not null").select("doc_id", "block_id", T.escape_text(F.col("text")).alias("escaped")).distinct()


@query("list_item_lines", f"""WITH i AS (SELECT DISTINCT * FROM blocks WHERE kind = 'list_item'), p AS (SELECT doc_id, block_id, coalesce(ordered, false) AS o, trim(coalesce(marker, '')) AS m, repeat('  ', coalesce(list_level, 0)) AS ind, regexp_extract(trim(coalesce(marker, '')), '^\\(?(\\d{{1,3}})[.)]?$', 1) AS num,
 regexp_replace({s_strip("coalesce(text, '')")}, '^({WS}*)([#>*+\\-=]|\\d+[.)])({WS})', '\\1\\\\\\2\\3') AS t FROM i)
SELECT doc_id, block_id, CASE WHEN o AND num <> '' THEN ind || CAST(num AS INT) || '. ' || t WHEN o THEN rtrim(ind || '- ' || m || ' ' || t) ELSE ind || '- ' || t END AS line FROM p""")
def list_item_lines(spark, sf):
    return table(spark, sf, "blocks").where("kind = 'list_item'").distinct().select("doc_id", "block_id", render.list_item(F.col("text"), F.col("marker"), F.col("ordered"), F.col("list_level")).alias("line"))


@query("nation_table", """SELECT r_name AS title, '| nation | key |' || chr(10) || '| :--- | ---: |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def nation_table(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    per = j.groupBy("r_name").agg(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), rows).alias("rows"))
    return per.select(F.col("r_name").alias("title"), render.table_markdown(F.col("rows"), F.lit(1), F.array(F.lit("left"), F.lit("right"))).alias("markdown"))


@query("markdown_documents")
def markdown_documents(spark, sf):
    return render.documents(reading_order.page_breaks(ordered_of(spark, sf)))


@query("end_footnotes", f"""SELECT doc_id, chr(10) || '---' || chr(10) || chr(10) || '## Notas de rodapé' || chr(10) || chr(10) || string_agg('[^' || page || '-' || coalesce(nullif(trim(marker), ''), '*') || ']: ' || {s_strip("coalesce(text, '')")}, chr(10) ORDER BY page, seq) || chr(10) AS notes FROM (SELECT DISTINCT * FROM blocks) WHERE kind = 'footnote' GROUP BY 1""")
def end_footnotes(spark, sf):
    return render.end_footnotes(table(spark, sf, "blocks").distinct())


@query("safe_filenames", "SELECT DISTINCT source, CASE WHEN coalesce(source, '') = '' THEN 'documento' ELSE source END || '.md' AS name FROM documents")
def safe_filenames(spark, sf):
    return table(spark, sf, "documents").select("source", jobs.markdown_name(F.col("source")).alias("name")).distinct()


# --- guard ---------------------------------------------------------------------------------------------------------
FIELDS = "gb AS (SELECT DISTINCT * FROM blocks), gf AS (SELECT doc_id, lower(f) AS t FROM (SELECT doc_id, text AS f FROM gb WHERE kind IN ('heading', 'paragraph', 'list_item', 'footnote', 'table', 'figure') UNION ALL SELECT doc_id, CASE WHEN kind = 'heading' THEN numbering ELSE marker END FROM gb WHERE kind IN ('heading', 'list_item', 'footnote')) WHERE f IS NOT NULL AND f <> '')"


@query("guard_numbers_words", f"WITH {FIELDS} SELECT doc_id, 'numbers' AS layer, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\d[\\d.,:/]*\\d|\\d')) AS token FROM gf) GROUP BY ALL UNION ALL SELECT doc_id, 'words', token, count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS token FROM gf) GROUP BY ALL")
def guard_numbers_words(spark, sf):
    return guard.fingerprint(table(spark, sf, "blocks"), folded=False).where("layer <> 'chars'")


@query("guard_fingerprint")
def guard_fingerprint(spark, sf):
    return guard.fingerprint(table(spark, sf, "blocks"))


@query("guard_difference", f"""WITH {FIELDS}, w AS (SELECT doc_id, token, count(*) AS b FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\d[\\d.,:/]*\\d|\\d')) AS token FROM gf) GROUP BY ALL),
a AS (SELECT doc_id, token, count(*) AS a FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\d[\\d.,:/]*\\d|\\d')) AS token FROM gb WHERE kind = 'paragraph' AND text IS NOT NULL AND text <> '') GROUP BY ALL)
SELECT doc_id, 'numbers' AS layer, token, greatest(0, coalesce(a, 0) - coalesce(b, 0)) AS added, greatest(0, coalesce(b, 0) - coalesce(a, 0)) AS removed FROM w FULL JOIN a USING (doc_id, token) WHERE coalesce(a, 0) <> coalesce(b, 0)""")
def guard_difference(spark, sf):
    b = table(spark, sf, "blocks")
    numbers = lambda df: guard.fingerprint(df, folded=False).where("layer = 'numbers'")
    return guard.difference(numbers(b), numbers(b.where("kind = 'paragraph'")))


def ops_of(spark, sf):
    """An edit for every block, chosen by its kind and place: merges, promotions, levels, quotations, flags."""
    b = table(spark, sf, "blocks").distinct().where("kind <> 'page_break'")
    o = ordered_of(spark, sf).select("doc_id", "page", "block_id", "kind", "ord")
    from pyspark.sql import Window

    nxt = F.lead("block_id").over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    o = o.withColumn("nb", nxt).join(b.select("doc_id", "block_id", "seq"), ["doc_id", "block_id"])
    k = F.col("seq") % 7
    op = F.when(F.col("kind") == "heading", F.when(k < 3, "set_heading_level").otherwise("demote_to_paragraph")).when(F.col("kind") == "paragraph", F.when(k == 0, "merge_blocks").when(k == 1, "promote_to_heading").when(k == 2, "promote_to_list").when(k == 3, "mark_as_footnote").when(k == 4, "mark_as_quote").otherwise("flag_review")).when(F.col("kind") == "table", "set_table_header_rows").otherwise("reorder")
    ids = F.when(op.isin("merge_blocks", "reorder"), F.array_compact(F.array("block_id", "nb"))).otherwise(F.array("block_id"))
    return o.select("doc_id", F.col("ord").cast("int").alias("op_seq"), op.alias("op"), ids.alias("ids"), F.lit(2).alias("level"), F.lit("*").alias("marker"), F.lit(False).alias("ordered"), F.lit(1).alias("header_rows"), F.lit("conferir").alias("note"), F.lit("estrutura").alias("reason"))


@query("guarded_edits")
def guarded_edits(spark, sf):
    out = guard.guarded_edits(table(spark, sf, "blocks"), ops_of(spark, sf))
    return guard.edit_totals(out)


# --- payloads and windows ------------------------------------------------------------------------------------------
@query("block_payloads")
def block_payloads(spark, sf):
    return payload.payloads(ordered_of(spark, sf), pages_of(spark, sf))


@query("block_windows", f"""WITH {ORDERED}, p AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM o WHERE kind <> 'page_break'),
w AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 120) / 115)) AS INT) + 1)) AS win FROM p) SELECT doc_id, CAST(win AS INT) AS "window", block_id, pos FROM w WHERE pos >= win * 115 AND pos < win * 115 + 120""")
def block_windows(spark, sf):
    return payload.windows(ordered_of(spark, sf))


# --- jobs ----------------------------------------------------------------------------------------------------------
STATES = "ev AS (SELECT DISTINCT * FROM job_events), js AS (SELECT job_id, max(batch_id) AS batch_id, max(doc_id) AS doc_id, arg_max(status, row(seq, event_id)) AS status, coalesce(max(CASE WHEN fraction > 1 THEN 1.0 ELSE fraction END), 0.0) AS progress, min(event_ts) AS created_at, max(event_ts) AS updated_at FROM ev GROUP BY 1)"


def states_of(spark, sf):
    return jobs.job_states(table(spark, sf, "job_events"))


@query("job_states", f"WITH {STATES} SELECT job_id, batch_id, doc_id, status, round(progress, 6) AS progress FROM js")
def job_states(spark, sf):
    return states_of(spark, sf).select("job_id", "batch_id", "doc_id", "status", F.round("progress", 6).alias("progress"))


@query("monotone_progress", "WITH ev AS (SELECT DISTINCT * FROM job_events) SELECT event_id, job_id, seq, round(coalesce(max(CASE WHEN fraction > 1 THEN 1.0 ELSE fraction END) OVER (PARTITION BY job_id ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 6) AS progress FROM ev")
def monotone_progress(spark, sf):
    return jobs.monotone(table(spark, sf, "job_events")).select("event_id", "job_id", "seq", F.round("progress", 6).alias("progress"))


@query("batch_board", f"""WITH {STATES} SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('done', 'failed', 'expired')) AS finished, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, round(avg(progress), 4) AS progress, count(*) FILTER (status IN ('done', 'failed', 'expired')) = count(*) AS ended FROM js WHERE batch_id IS NOT NULL GROUP BY 1""")
def batch_board(spark, sf):
    return jobs.batch_board(states_of(spark, sf))


@query("expired_jobs", f"WITH {STATES}, n AS (SELECT max(event_ts) AS now FROM ev) SELECT job_id FROM js, n WHERE status IN ('done', 'failed') AND epoch_us(now) - epoch_us(updated_at) > 3600000000")
def expired_jobs(spark, sf):
    e = table(spark, sf, "job_events")
    now = e.agg(F.max("event_ts").alias("now"))
    return jobs.expired(states_of(spark, sf).join(F.broadcast(now)), F.col("now")).select("job_id")  # now is one row


@query("batch_folders", "SELECT batch_id, job_id, 'autos' || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS folder FROM (SELECT batch_id, job_id, row_number() OVER (PARTITION BY batch_id ORDER BY job_id) AS k FROM (SELECT DISTINCT batch_id, job_id FROM job_events WHERE batch_id IS NOT NULL))")
def batch_folders(spark, sf):
    f = table(spark, sf, "job_events").where("batch_id is not null").select("batch_id", F.col("job_id").alias("idx"), F.lit("autos.pdf").alias("filename")).distinct()
    return jobs.folder_names(f).select("batch_id", F.col("idx").alias("job_id"), "folder")


@query("batch_admission", """WITH f AS (SELECT DISTINCT source AS batch_id, doc_id AS idx, CASE WHEN text IS NULL THEN 0 ELSE length(text) * 20000 END AS bytes FROM documents WHERE source IS NOT NULL),
a AS (SELECT *, CASE WHEN bytes = 0 THEN 'arquivo vazio' WHEN bytes > 200 * 1048576 THEN 'acima de 200 MB' END AS alone FROM f),
t AS (SELECT *, sum(CASE WHEN alone IS NULL THEN bytes ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM a)
SELECT batch_id, idx, coalesce(alone, CASE WHEN total > 1000 * 1048576 THEN 'lote acima de 1000 MB no total' END) AS reason FROM t""")
def batch_admission(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("idx"), F.lit("autos.pdf").alias("filename"), (F.coalesce(F.char_length("text"), F.lit(0)).cast("long") * 20000).alias("bytes"), F.lit("%PDF-1.7").alias("magic")).distinct()
    return jobs.admission(d).select("batch_id", "idx", "reason")


@query("report_board", f"""WITH {STATES}, rp AS (SELECT DISTINCT doc_id, report_id, resultado_processamento AS j FROM reports WHERE resultado_processamento IS NOT NULL AND json_valid(resultado_processamento)), lr AS (SELECT doc_id, arg_max(j, report_id) AS j FROM rp GROUP BY 1)
SELECT job_id, batch_id, js.doc_id || '.pdf' AS filename, status, coalesce(json_extract_string(j, '$.resumo.status'), CASE WHEN status = 'failed' THEN 'falhou' END) AS report_status, try_cast(json_extract_string(j, '$.text_accuracy') AS DOUBLE) AS coverage,
CAST(try_cast(json_extract_string(j, '$.documento.paginas') AS INT) AS DOUBLE) AS pages, CAST(try_cast(json_extract_string(j, '$.tables_detected') AS INT) AS DOUBLE) AS tables, CAST(try_cast(json_extract_string(j, '$.tabelas.para_revisar') AS INT) AS DOUBLE) AS to_review, CAST(try_cast(json_extract_string(j, '$.images_extracted') AS INT) AS DOUBLE) AS images,
CAST(try_cast(json_extract_string(j, '$.ocr.paginas_com_ocr') AS INT) AS DOUBLE) AS ocr_pages, coalesce(array_to_string(json_extract_string(j, '$.resumo.pendencias[*]'), ' | '), '') AS pending FROM js LEFT JOIN lr USING (doc_id)""")
def report_board(spark, sf):
    board = jobs.report_board(states_of(spark, sf), table(spark, sf, "reports"))
    return board.withColumns({c: F.col(c).cast("double") for c in ("pages", "tables", "to_review", "images", "ocr_pages")})


@query("report_board_csv")
def report_board_csv(spark, sf):
    return jobs.board_csv(jobs.report_board(states_of(spark, sf), table(spark, sf, "reports")))


# --- images --------------------------------------------------------------------------------------------------------
def image_rects_of(spark, sf):
    """Placements of the figure blocks, two pixels a point."""
    b = table(spark, sf, "blocks").where("kind = 'figure' and x0 is not null and y0 is not null and x1 is not null and y1 is not null").distinct()
    return b.select("doc_id", "page", F.col("seq").cast("int").alias("xref"), "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * 2).cast("int").alias("px_w"), ((F.col("y1") - F.col("y0")) * 2).cast("int").alias("px_h"))


@query("image_sizes", """WITH i AS (SELECT DISTINCT doc_id, page, CAST(seq AS INT) AS xref, x0, y0, x1, y1, CAST(trunc((x1 - x0) * 2) AS INT) AS w, CAST(trunc((y1 - y0) * 2) AS INT) AS h FROM blocks WHERE kind = 'figure' AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL)
SELECT doc_id, page, xref, w AS px_w, h AS px_h FROM i WHERE x1 - x0 > 1 AND y1 - y0 > 1 AND ((w = 0 AND h = 0) OR (w >= 24 AND h >= 24 AND w * h >= 2500))""")
def image_sizes(spark, sf):
    return images.size_filter(image_rects_of(spark, sf)).select("doc_id", "page", "xref", "px_w", "px_h")


@query("image_slices")
def image_slices(spark, sf):
    return images.slices(images.suppress_scans(image_rects_of(spark, sf), routed_of(spark, sf)))


@query("vector_figures")
def vector_figures(spark, sf):
    d = table(spark, sf, "words").where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select("doc_id", "page", "x0", "y0", "x1", "y1").distinct()
    return images.vector_figures(d, pages_of(spark, sf), image_rects_of(spark, sf))

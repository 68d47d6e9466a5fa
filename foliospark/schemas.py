"""Table contracts: the positioned records every operator reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

TABLES: dict[str, str] = {
    "pages_info": "doc_id string, page int, width double, height double, native_char_count bigint, text_area_ratio double, image_count bigint, image_area_ratio double, vector_line_count bigint",
    "spans": "doc_id string, page int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, color int, confidence double",
    "words": "doc_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, from_ocr boolean",
    "ocr_words": "doc_id string, page int, text string, conf double, left_px int, top_px int, width_px int, height_px int, block_num int, par_num int, line_num int, word_num int",
    "drawings": "doc_id string, page int, draw_no int, op string, x0 double, y0 double, x1 double, y1 double",
    "rulings": "doc_id string, page int, axis string, pos double, start double, end double",
    "image_rects": "doc_id string, page int, xref int, x0 double, y0 double, x1 double, y1 double, px_w int, px_h int",
    "blocks": "doc_id string, block_id string, page int, seq bigint, kind string, text string, style string, level int, numbering string, marker string, ordered boolean, list_level int, x0 double, y0 double, x1 double, y1 double, source string, engine string, confidence double, needs_review boolean, review_reason string",
    "ops": "doc_id string, op_seq int, op string, ids array<string>, level int, marker string, ordered boolean, header_rows int, note string, reason string",
    "warnings": "doc_id string, code string, severity string, message string, page int, block_id string, detail string",
    "job_events": "event_id bigint, job_id string, batch_id string, doc_id string, seq int, status string, fraction double, event_ts timestamp, received_ts timestamp",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the columns and types of the contract; missing columns become null, extra ones are dropped."""
    from pyspark.sql import functions as F

    out = []
    for col in TABLES[table].split(", "):
        name, kind = col.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)

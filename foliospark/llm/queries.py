"""Queries of the text operators, added to the entry point when this subpackage is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import lookalikes, mojibake, packing, privacy, quality, scans, sentences, splitting, tokens
from foliospark.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


SPAN_KEY = ["doc_id", "page", "block_no", "line_no", "span_no"]


def _span_rows(spans: DataFrame) -> DataFrame:
    item = F.concat_ws(".", *(F.col(c).cast("string") for c in SPAN_KEY[2:]))
    return spans.select(F.lit("spans").alias("tbl"), "doc_id", "page", item.alias("item"), "text")


def _word_rows(words: DataFrame) -> DataFrame:
    return words.select(F.lit("words").alias("tbl"), "doc_id", "page", F.col("word_no").cast("string").alias("item"), "text")


def _lookalike_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int], DataFrame]:
    """Span and word rows, corpus counts of class members, scripts of pages."""
    rows = _span_rows(table(spark, sf_dir, "spans")).unionByName(_word_rows(table(spark, sf_dir, "words")))
    return rows, lookalikes.corpus_counts(rows.select("text")), lookalikes.page_scripts(rows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, counts, pages = _lookalike_parts(spark, sf_dir)
    hits = lookalikes.found(rows, counts, pages)
    garbled = mojibake.affected(_span_rows(table(spark, sf_dir, "spans"))).select("tbl", "doc_id", "page", "item")
    return hits.join(garbled, ["tbl", "doc_id", "page", "item"], "left_anti").select("tbl", "doc_id", "page", "item")


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings are restored first: look-alike forms of garbled characters could not be decoded any more."""
    spans = mojibake.restore(_span_rows(table(spark, sf_dir, "spans")).distinct())
    rows = spans.unionByName(_word_rows(table(spark, sf_dir, "words")).distinct())
    return lookalikes.normalize(rows, lookalikes.corpus_counts(rows.select("text")), lookalikes.page_scripts(rows))


def _personal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").where(F.col("kind").isin("paragraph", "list_item")).select("doc_id", "block_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.items(_personal_blocks(spark, sf_dir), table(spark, sf_dir, "name_parts")).select("doc_id", "block_id", "pii_kind", "start_at").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redact(_personal_blocks(spark, sf_dir).distinct(), table(spark, sf_dir, "name_parts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(table(spark, sf_dir, "ocr_words"), table(spark, sf_dir, "pages_info"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "ocr_words"), table(spark, sf_dir, "pages_info"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.affected(table(spark, sf_dir, "spans").select(*SPAN_KEY, "text")).select(SPAN_KEY).distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.affected(table(spark, sf_dir, "spans").select(*SPAN_KEY, "text")).select(*SPAN_KEY, "text", "repaired", "restorable")


def _prose_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("kind") == "paragraph") & (F.coalesce("style", F.lit("")) != "pre")
    return table(spark, sf_dir, "blocks").where(kept).select("doc_id", "block_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.starts(_prose_paragraphs(spark, sf_dir), table(spark, sf_dir, "abbreviations"))


def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(_prose_paragraphs(spark, sf_dir), table(spark, sf_dir, "abbreviations"))


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    known = {"payload_text_chars": 400, "payload_text_overlap_chars": 40, "window_blocks": 120, "window_overlap_blocks": 5, "container_tokens": 2048}
    rows = table(spark, sf_dir, "size_limits").where("limit_value is not null").groupBy("limit_name").agg(F.max("limit_value").alias("v")).collect()  # a fixed table
    return known | {r["limit_name"]: int(r["v"]) for r in rows}


def p7_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _limits(spark, sf_dir)
    return splitting.text_pieces(table(spark, sf_dir, "blocks"), m["payload_text_chars"], m["payload_text_overlap_chars"])


def p7_block_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _limits(spark, sf_dir)
    return splitting.block_pieces(table(spark, sf_dir, "blocks"), m["window_blocks"], m["window_overlap_blocks"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = p7_text_pieces(spark, sf_dir).where("piece_no = 0").select(F.lit("text").alias("item"), "doc_id", "block_id")
    lists = p7_block_windows(spark, sf_dir).where("piece_no = 0").select(F.lit("blocks").alias("item"), "doc_id", F.lit("").alias("block_id"))
    return texts.unionByName(lists).distinct()


P7_FOUND_SQL = """
WITH b AS (SELECT DISTINCT * FROM blocks)
SELECT DISTINCT 'text' AS item, doc_id, block_id FROM b WHERE length(text) > 400
UNION ALL
SELECT 'blocks', doc_id, '' FROM (SELECT DISTINCT doc_id, block_id FROM b WHERE kind <> 'page_break') GROUP BY doc_id HAVING count(*) > 120
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode_corpus(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", tokens.decode_ids(F.col("ids")).alias("text"))


P8_ROUNDTRIP_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, _limits(spark, sf_dir)["container_tokens"])


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: one row."""
    return packing.fill_report(p9_containers(spark, sf_dir), _limits(spark, sf_dir)["container_tokens"])


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), quality.common_by_language(table(spark, sf_dir, "common_words")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_statistics(spark, sf_dir).where("doc_class <> 'prose'").select("doc_id", "doc_class")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_normalized": p1_normalized, "p2_found": p2_found, "p2_redacted": p2_redacted,
        "p3_found": p3_found, "p3_paragraphs": p3_paragraphs,
        "p5_found": p5_found, "p5_repaired": p5_repaired,
        "p6_found": p6_found, "p6_sentences": p6_sentences,
        "p7_found": p7_found, "p7_text_pieces": p7_text_pieces, "p7_block_windows": p7_block_windows,
        "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_containers": p9_containers, "p9_fill": p9_fill,
        "p10_found": p10_found, "p10_statistics": p10_statistics,
    }


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_FOUND_SQL, "p8_roundtrip": P8_ROUNDTRIP_SQL}

"""Quality report: coverage, lost pages, second opinions, lexical sanity, warnings, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config, Options
from foliospark.functions import text as T


def produced_chars(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, produced): characters of the text blocks of every page; page breaks do not count."""
    return blocks.distinct().where("kind <> 'page_break'").groupBy("doc_id", "page").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("produced"))


def page_coverage(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """expected (doc_id, page, expected) with produced and coverage of the page."""
    j = expected.join(produced, ["doc_id", "page"], "left").na.fill(0, ["produced"])
    return j.withColumn("coverage", F.when(F.col("expected") > 0, F.col("produced") / F.col("expected")))


def document_coverage(per_page: DataFrame) -> DataFrame:
    d = per_page.groupBy("doc_id").agg(F.sum("expected").alias("source_chars"), F.sum("produced").alias("markdown_chars"))
    raw = F.when(F.col("source_chars") > 0, F.col("markdown_chars") / F.col("source_chars")).otherwise(F.when(F.col("markdown_chars") == 0, 1.0).otherwise(0.0))
    return d.withColumn("coverage_raw", F.round(raw, 4)).withColumn("coverage", F.round(F.least(F.lit(1.0), raw), 4))


def lossy_pages(per_page: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return per_page.where((F.col("expected") >= cfg.lossy_least) & (F.col("produced") / F.col("expected") < cfg.lossy_ratio)).select("doc_id", "page", "expected", "produced", F.round("coverage", 3).alias("coverage"))


def worst_lossy(lossy: DataFrame, k: int = 20) -> DataFrame:
    """The k worst lossy pages of every file: a top-k report."""
    return lossy.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("coverage", "page"))).where(F.col("r") <= k).drop("r")


def empty_pages(routed: DataFrame, produced: DataFrame) -> DataFrame:
    j = routed.join(produced, ["doc_id", "page"], "left").na.fill(0, ["produced"])
    return j.where((F.col("produced") == 0) & ~F.col("excluded") & ((F.col("route") != "empty") | F.col("needs_ocr"))).select("doc_id", "page", "route")


def sampled_pages(pages: DataFrame, k: int = 12) -> DataFrame:
    """(doc_id, page) of a systematic sample: every step-th page, the first k; step = max(1, n div k)."""
    w = Window.partitionBy("doc_id").orderBy("page")
    p = pages.select("doc_id", "page").distinct().withColumn("i", F.row_number().over(w) - 1)
    n = p.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / k)).alias("step"))
    return p.join(n, "doc_id").where((F.col("i") % F.col("step") == 0) & (F.col("i") / F.col("step") < k)).select("doc_id", "page")


def second_opinion(sample: DataFrame, other: DataFrame, produced: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Sampled pages where a second reading (doc_id, page, other) and ours differ."""
    key = ["doc_id", "page"]
    j = sample.join(other, key).join(produced, key, "left").join(boilerplate, key, "left").na.fill(0, ["produced", "boilerplate_chars"])
    j = j.withColumn("comparable", F.greatest(F.lit(1), F.col("other") - F.col("boilerplate_chars"))).withColumn("ratio", F.col("produced") / F.col("comparable"))
    return j.where((F.col("comparable") >= 40) & ((F.col("ratio") < 0.8) | (F.col("ratio") > 1.6))).select(*key, "other", "comparable", "produced", F.round("ratio", 3).alias("ratio"))


def lexical_sanity(texts: DataFrame, key: str = "doc_id", text: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    """(key, tokens, suspect_tokens, suspect_ratio) over whole texts; the rows of a key are counted one by one and added up."""
    read = F.left(F.col(text), F.lit(cfg.lexical_sample)) if cfg.lexical_sample else F.col(text)
    d = texts.select(key, F.coalesce(F.regexp_extract_all(read, F.lit(T.TOKEN), F.lit(0)), F.array().cast("array<string>")).alias("t"))
    d = d.select(key, F.size("t").alias("tokens"), F.size(F.filter("t", T.suspect_token)).alias("suspect_tokens"))
    d = d.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tokens", "suspect_tokens")])
    return d.withColumn("suspect_ratio", F.when(F.col("tokens") > 0, F.round(F.col("suspect_tokens") / F.col("tokens"), 4)).otherwise(0.0))


def ocr_confidence(ocr_words: DataFrame, min_conf: float = 40.0) -> DataFrame:
    """(doc_id, pages, ocr_mean): mean of the pages' mean word confidence, in per cent."""
    w = ocr_words.distinct().where((F.coalesce("conf", F.lit(-1.0)) >= min_conf) & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    per = w.groupBy("doc_id", "page").agg(F.avg("conf").alias("c"))
    return per.groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(F.avg("c"), 2).alias("ocr_mean"))


def ocr_pages(routed: DataFrame, ocr_words: DataFrame, min_conf: float = 40.0) -> DataFrame:
    """(doc_id, page, ocr_words, ocr_mean) of every page that was to be recognised or holds recognised words."""
    w = ocr_words.distinct().where((F.coalesce("conf", F.lit(-1.0)) >= min_conf) & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    per = w.groupBy("doc_id", "page").agg(F.count("*").alias("ocr_words"), F.avg("conf").alias("ocr_mean"))
    wanted = routed.where(F.col("route").isin("ocr", "hybrid")).select("doc_id", "page").distinct()
    return wanted.join(per, ["doc_id", "page"], "full").na.fill(0, ["ocr_words"])


def images_missing(declared: Column, extracted: Column, vector: Column, suppressed: Column) -> Column:
    left = F.greatest(F.lit(0), declared - suppressed)
    return (left > 0) & (F.greatest(F.lit(0), extracted - vector) < 0.6 * left)


def verdict(errors: Column, alerts: Column, coverage_pct: Column, tables: Column) -> Column:
    return F.when((errors > 0) | (coverage_pct < 85), "revisar").when((alerts > 0) | (tables > 0), "atencao").otherwise("ok")


def pending(empty: Column, tables: Column, ocr_mean: Column, suspect_pct: Column) -> Column:
    n = lambda c: c.cast("int").cast("string")
    return F.array_compact(
        F.array(
            F.when(empty > 0, F.concat(n(empty), F.lit(" página(s) sem texto"))), F.when(tables > 0, F.concat(n(tables), F.lit(" tabela(s) para conferir"))),
            F.when(ocr_mean < 80, F.concat(F.lit("OCR com confiança média de "), n(F.bround(ocr_mean, 0)), F.lit("%"))),
            F.when(suspect_pct > 6, F.concat(F.format_string("%.1f", suspect_pct), F.lit("% de palavras improváveis"))),
        )
    )


# Warning codes and their severity.
SEVERITY = {
    "OCR_DISABLED": "error", "OCR_SKIPPED": "error", "PAGES_EMPTY": "info", "OCR_LANG_MISSING": "warning", "OCR_PAGE_FAILED": "error", "OCR_NO_TEXT": "error", "OCR_LOW_CONFIDENCE": "warning",
    "TABLE_LOW_CONFIDENCE": "warning", "IMAGE_EXTRACTION_FAILED": "error", "AI_CONSENT_MISSING": "warning", "AI_UNAVAILABLE": "warning", "AI_CALL_FAILED": "warning", "AI_OPERATIONS_REJECTED": "info",
    "AI_CONTENT_DRIFT": "error", "STAGE_FAILED": "error", "PAGE_TEXT_LOSS": "warning", "PAGE_NO_TEXT": "error", "EXTRACTOR_DISAGREEMENT": "warning", "OCR_QUALITY_SUSPECT": "warning", "IMAGES_MISSING": "warning",
}


def warning_rows(rows: DataFrame, code: str, count: str = "n") -> DataFrame:
    """(doc_id, code, severity, n) of rows (doc_id, count)."""
    return rows.select("doc_id", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), F.col(count).cast("bigint").alias("n"))


def _per_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"))


def warnings(routed: DataFrame, per_page: DataFrame, tables: DataFrame, lexical: DataFrame, recognised: DataFrame, second: DataFrame | None = None, images: DataFrame | None = None, failures: DataFrame | None = None, edits: DataFrame | None = None, drifted: DataFrame | None = None, options: Options = Options(), cfg: Config = DEFAULT, ocr_enabled: bool = True, languages: tuple[str, ...] = (), provider_available: bool = True) -> DataFrame:
    """(doc_id, code, severity, n) of every file: one branch per code of the catalogue, united.

    recognised: ocr_pages(); second: second_opinion(); images (doc_id, declared, extracted, vector, suppressed);
    failures (doc_id, stage, page) of stages that broke, page null for a whole file; edits: outcomes of guarded
    edits; drifted (doc_id): files whose content changed by edits.  Branches without their table are left out."""
    produced = per_page.select("doc_id", "page", "produced")
    every = routed.select("doc_id").distinct().withColumn("n", F.lit(1))
    none = every.limit(0)
    failed = lambda cond: none if failures is None else _per_file(failures.where(cond))
    outcome = lambda cond: none if edits is None else _per_file(edits.where(cond))
    wanted = options.edits
    branches: dict[str, DataFrame] = {
        "OCR_DISABLED": none if ocr_enabled else _per_file(routed.where("route = 'ocr'")),
        "OCR_SKIPPED": _per_file(routed.where("needs_ocr")) if options.ocr_mode == "never" else none,
        "PAGES_EMPTY": _per_file(routed.where("route = 'empty' and not excluded and not needs_ocr")),
        "OCR_LANG_MISSING": _per_file(routed.where("needs_ocr").select("doc_id").distinct()) if languages and options.language not in languages else none,
        "OCR_PAGE_FAILED": failed("stage = 'ocr' and page is not null"),
        "OCR_NO_TEXT": _per_file(recognised.where("ocr_words = 0")),
        "OCR_LOW_CONFIDENCE": _per_file(recognised.where((F.col("ocr_words") > 0) & (F.col("ocr_mean") < cfg.ocr_page_conf))),
        "TABLE_LOW_CONFIDENCE": _per_file(tables.where(F.col("confidence") < cfg.table_confidence)),
        "IMAGE_EXTRACTION_FAILED": failed("stage = 'images' and page is not null"),
        "AI_CONSENT_MISSING": every if wanted and not options.edits_consent else none,
        "AI_UNAVAILABLE": every if wanted and options.edits_consent and not provider_available else none,
        "AI_CALL_FAILED": failed("stage = 'edits' and page is null"),
        "AI_OPERATIONS_REJECTED": outcome("outcome = 'rejected'"),
        "AI_CONTENT_DRIFT": none if drifted is None else _per_file(drifted.select("doc_id").distinct()),
        "STAGE_FAILED": failed("stage <> 'edits' and page is null"),
        "PAGE_TEXT_LOSS": _per_file(lossy_pages(per_page, cfg)),
        "PAGE_NO_TEXT": _per_file(empty_pages(routed, produced)),
        "EXTRACTOR_DISAGREEMENT": none if second is None else _per_file(second),
        "OCR_QUALITY_SUSPECT": lexical.where("tokens >= 200 and suspect_ratio > 0.06").select("doc_id", F.col("suspect_tokens").alias("n")),
        "IMAGES_MISSING": none if images is None else images.where(images_missing(F.col("declared"), F.col("extracted"), F.col("vector"), F.col("suppressed"))).select("doc_id", F.col("declared").alias("n")),
    }
    out = None
    for code, rows in branches.items():
        if rows is not none:
            part = warning_rows(rows, code)
            out = part if out is None else out.unionByName(part)
    return out


def report_json(parts: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON text per file of a frame with a column per section."""
    sections = [c for c in parts.columns if c != "doc_id"]
    return parts.select("doc_id", F.to_json(F.struct(*sections)).alias("report"))

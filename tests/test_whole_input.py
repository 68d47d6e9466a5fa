"""Queries judge their whole input: fixtures whose telling rows lie past a prefix, on scanned pages or at the end of a stream."""

import os

import pytest
from pyspark.sql import functions as F

from foliospark.llm import packing
from foliospark.operators import quality
from foliospark.plans import document_queries, stream_queries


@pytest.fixture
def tables(spark, small, tmp_path):
    """A folder of the small tables in which tables(name, rows) replaces one; rows: dicts, other columns are null."""

    def put(name, rows):
        types = spark.read.parquet(f"{small}/{name}.parquet").schema
        path = tmp_path / f"{name}.parquet"
        path.unlink()
        spark.createDataFrame([tuple(r.get(f.name) for f in types) for r in rows], types).write.parquet(str(path))
        return str(tmp_path)

    for f in os.listdir(small):
        (tmp_path / f).symlink_to(f"{small}/{f}")
    return put


def test_garbling_past_a_prefix_is_counted(spark, tables):
    words = ["palavra"] * 100
    rows = [{"doc_id": "d", "block_id": f"b{i}", "page": i, "seq": i, "kind": "paragraph", "text": " ".join(words)} for i in range(1, 91)]
    rows += [{"doc_id": "d", "block_id": f"g{i}", "page": i, "seq": i, "kind": "paragraph", "text": " ".join(["xkcdt"] * 100)} for i in range(91, 101)]
    sf = tables("blocks", rows)
    got = {r["code"]: r["n"] for r in document_queries.QUERIES["document_warnings"](spark, sf).where("doc_id = 'd'").collect()}
    assert got["OCR_QUALITY_SUSPECT"] == 1000


def test_lexical_sanity_reads_the_whole_text(spark):
    d = spark.createDataFrame([("d", "palavra " * 10_000 + "xkcdt " * 1000)], "doc_id string, text string")
    assert quality.lexical_sanity(d).first()[1:] == (11_000, 1000, 0.0909)


def test_native_and_recognised_text_are_united(spark, tables):
    def word(page, block, text, y, **more):
        return {"doc_id": "d", "page": page, "text": text, "conf": 90.0, "left_px": 300, "top_px": y, "width_px": 900, "height_px": 50, "block_num": block, "par_num": 1, "line_num": 1, "word_num": 1, **more}

    def span(page, block, text, y):
        return {"doc_id": "d", "page": page, "block_no": block, "line_no": 0, "span_no": 0, "text": text, "x0": 72.0, "y0": y, "x1": 288.0, "y1": y + 12, "font": "Times", "size": 12.0, "flags": 0, "color": 0, "confidence": 1.0}

    info = {"doc_id": "d", "width": 595.0, "height": 842.0, "native_char_count": 500, "text_area_ratio": 0.3, "image_count": 1}
    tables("pages_info", [{**info, "page": 1, "image_area_ratio": 0.9}, {**info, "page": 2, "native_char_count": 0}, {**info, "page": 3}])
    tables("spans", [span(p, 0, "TRIBUNAL DE JUSTIÇA fls. 7", 30.0) for p in (1, 3)] + [span(1, 4, "1 texto nativo da página", 240.0)])
    words = [word(1, 1, "repetido", 1000), word(1, 2, "anexo", 2000), word(1, 2, "colado", 2000, left_px=1250, word_num=2), word(2, 1, "TRIBUNAL DE JUSTICA fls. 8", 125), word(2, 2, "2 nota", 1500), word(2, 3, "ruído", 1800, conf=10.0)]
    sf = tables("ocr_words", words)
    run = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in document_queries.QUERIES[name](spark, sf).where("doc_id = 'd'").collect())
    assert run("typed_blocks", "page", "block_no", "text") == [(1, 0, "TRIBUNAL DE JUSTIÇA fls. 7"), (1, 4, "1 texto nativo da página"), (1, 6, "anexo colado"), (2, 0, "TRIBUNAL DE JUSTICA fls. 8"), (2, 1, "2 nota"), (3, 0, "TRIBUNAL DE JUSTIÇA fls. 7")]
    assert (2, "2", "nota") in run("footnote_split", "page", "marker", "text") and (1, "1", "texto nativo da página") in run("footnote_split", "page", "marker", "text")
    assert run("header_footer_fuzzy", "page", "block_no") == [(1, 0), (2, 0), (3, 0)]


def test_sessions_open_at_the_end_come_out(spark, small):
    got = stream_queries.QUERIES["stream_sessions"](spark, small)
    e = spark.read.parquet(f"{small}/job_events.parquet").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    want = e.groupBy("job_id", F.session_window("event_ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n")
    assert want.count() > 0 and sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_roman_markers_are_listed(spark, tables):
    sf = tables("documents", [{"doc_id": 1, "text": "ii) dois\n- ponto\niv. quatro\n3) três\nsem marca"}])
    got = sorted(tuple(r) for r in document_queries.QUERIES["list_markers"](spark, sf).collect())
    assert got == [(1, 0, "ii)", True), (1, 1, "-", False), (1, 2, "iv.", True), (1, 3, "3)", True)]


def test_a_length_goes_into_the_shortest_pack():
    assert {r.pattern for r in packing.plan({7: 1, 6: 1, 2: 1}, 10)} == {((7, 1),), ((6, 1), (2, 1))}


def test_every_warning_code_has_its_branch(spark):
    """Each code of the catalogue comes out for the file built for it."""
    from foliospark.config import Options
    from foliospark.operators import quality

    df = spark.createDataFrame
    routed = df([("d", 1, "ocr", True, False), ("d", 2, "empty", False, False), ("d", 3, "native", False, False)], "doc_id string, page int, route string, needs_ocr boolean, excluded boolean")
    per_page = df([("d", 1, 100, 0, 0.0), ("d", 3, 100, 10, 0.1)], "doc_id string, page int, expected bigint, produced bigint, coverage double")
    tables = df([("d", 0.2)], "doc_id string, confidence double")
    lexical = df([("d", 300, 60, 0.2)], "doc_id string, tokens bigint, suspect_tokens bigint, suspect_ratio double")
    recognised = df([("d", 1, 0, None), ("d", 4, 5, 55.0)], "doc_id string, page int, ocr_words bigint, ocr_mean double")
    images = df([("d", 5, 1, 0, 0)], "doc_id string, declared bigint, extracted bigint, vector bigint, suppressed bigint")
    failures = df([("d", "ocr", 1), ("d", "images", 2), ("d", "edits", None), ("d", "semantics", None)], "doc_id string, stage string, page int")
    edits = df([("d", "rejected"), ("d", "applied")], "doc_id string, outcome string")
    one = df([("d",)], "doc_id string")
    call = lambda **kw: {r["code"]: (r["severity"], r["n"]) for r in quality.warnings(routed, per_page, tables, lexical, recognised, one, images, failures, edits, one, **kw).collect()}
    got = call(options=Options(ocr_mode="never", edits=True, language="por"), ocr_enabled=False, languages=("eng",))
    got |= call(options=Options(edits=True, edits_consent=True), provider_available=False)
    assert {k: v[0] for k, v in got.items()} == quality.SEVERITY
    assert got["PAGE_NO_TEXT"][1] == 1 and got["OCR_QUALITY_SUSPECT"][1] == 60 and got["AI_OPERATIONS_REJECTED"][1] == 1
    assert set(call()) >= {"PAGES_EMPTY", "OCR_NO_TEXT", "OCR_LOW_CONFIDENCE"} and "OCR_SKIPPED" not in call()

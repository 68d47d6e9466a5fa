"""Rulings, grids, merged cells and borderless tables against plain folds and small fixtures."""

import random

from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators import images, layout, reading_order, rulings, tables_grid, tables_stream


def fold_segments(raw, snap, least):
    """The sequential statement of merging: buckets of near positions, touching strokes fused."""
    segs = sorted({(p, min(a, b), max(a, b)) for p, a, b in raw if abs(b - a) >= least})
    out, bucket = [], []

    def flush():
        at = sum(s[0] for s in bucket) / len(bucket)
        strokes = sorted((s[1], s[2]) for s in bucket)
        start, end = strokes[0]
        for a, b in strokes[1:]:
            if a <= end + snap:
                end = max(end, b)
            else:
                out.append((at, start, end))
                start, end = a, b
        out.append((at, start, end))

    for s in segs:
        if bucket and s[0] - bucket[-1][0] > snap:
            flush()
            bucket = []
        bucket.append(s)
    if bucket:
        flush()
    return sorted((round(p, 6), a, b) for p, a, b in out if b - a >= least)


def test_merge_segments_equals_fold(spark):
    rng = random.Random(7)
    pages, rows = {}, []
    for page in range(40):
        raw = [(rng.randrange(0, 40) * 1.0, float(s := rng.randrange(0, 120)), float(s + rng.randrange(0, 60))) for _ in range(rng.randrange(1, 25))]
        pages[page] = raw
        rows += [("d", page, "h", *r) for r in raw]
    df = spark.createDataFrame(rows, "doc_id string, page int, axis string, pos double, start double, end double")
    got = {}
    for r in rulings.merge_segments(df).collect():
        got.setdefault(r["page"], []).append((round(r["pos"], 6), r["start"], r["end"]))
    for page, raw in pages.items():
        assert sorted(got.get(page, [])) == fold_segments(raw, 3.0, 12.0)


def ruled(n, m, skip_h=(), skip_v=()):
    """Borders of an n by m grid with 40 point cells; skipped strokes are (border, cell)."""
    rows = [("d", 1, "h", 40.0 * i, 40.0 * j, 40.0 * (j + 1)) for i in range(n + 1) for j in range(m) if (i, j) not in skip_h]
    rows += [("d", 1, "v", 40.0 * j, 40.0 * i, 40.0 * (i + 1)) for j in range(m + 1) for i in range(n) if (j, i) not in skip_v]
    return rows


RULING = "doc_id string, page int, axis string, pos double, start double, end double"


def test_merged_cells(spark):
    segs = rulings.merge_segments(spark.createDataFrame(ruled(3, 3, skip_h=[(2, 0)], skip_v=[(1, 0), (2, 0)]), RULING))
    grid = rulings.grids(segs)
    assert grid.count() == 1
    c = {(r["row"], r["col"]): (r["rowspan"], r["colspan"]) for r in tables_grid.cells(grid).collect()}
    assert c[(0, 0)] == (1, 3) and c[(0, 1)] == (0, 0) and c[(0, 2)] == (0, 0)
    assert c[(1, 0)] == (2, 1) and c[(2, 0)] == (0, 0) and c[(1, 1)] == (1, 1)
    assert grid.select(rulings.closed_ratio().alias("r")).first()["r"] > 0.5


def test_small_grids_and_frames_are_left_out(spark):
    segs = rulings.merge_segments(spark.createDataFrame(ruled(1, 1), RULING))
    assert rulings.grids(segs).count() == 0
    full = rulings.merge_segments(spark.createDataFrame(ruled(3, 3), RULING))
    page = spark.createDataFrame([("d", 1, 121.0, 121.0)], "doc_id string, page int, width double, height double")
    assert rulings.grids(full, page).count() == 0


def test_grid_text_alignment_and_confidence(spark):
    segs = rulings.merge_segments(spark.createDataFrame(ruled(3, 2), RULING))
    cell = [("Nome", 2, 10), ("Valor", 42, 10), ("um", 2, 50), ("1,00", 60, 50), ("dois", 2, 90), ("2,00", 60, 90)]
    rows = [("d", 1, i, 0, 0, t, float(x), float(y), float(x + 15), float(y + 10), "F", 10.0, 0, 0, 1.0) for i, (t, x, y) in enumerate(cell)]
    spans = layout.span_styles(spark.createDataFrame(rows, "doc_id string, page int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, color int, confidence double"))
    grid = rulings.grids(segs)
    t = tables_grid.grid_tables(grid, spans).first()
    assert (t["n_rows"], t["n_cols"], t["header_rows"], t["merged"]) == (3, 2, 1, False) and t["confidence"] >= 0.8
    cells = tables_grid.cells(grid)
    align = {r["col"]: r["align"] for r in tables_grid.column_alignment(tables_grid.cell_texts(cells, spans), tables_grid.cell_alignment(cells, spans)).collect()}
    assert align == {0: "left", 1: "left"} or align[0] == "left"


WORDS = "doc_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, from_ocr boolean"


def test_borderless_table(spark):
    rows, k = [], 0
    for i in range(5):
        for x, t in ((50, "item"), (200, "abc"), (350, f"{i},00")):
            rows.append(("d", 1, k, t, float(x), 100.0 + 14 * i, float(x + 40), 110.0 + 14 * i, 1.0, False))
            k += 1
    rows.append(("d", 1, k, "parágrafo", 50.0, 300.0, 90.0, 310.0, 1.0, False))
    tables, cells = tables_stream.stream_tables(tables_stream.usable_words(spark.createDataFrame(rows, WORDS)))
    t = tables.first()
    assert (t["n_rows"], t["n_cols"], t["misplaced"]) == (5, 3, 0) and t["confidence"] == 0.88
    assert {(r["row"], r["col"]): r["text"] for r in cells.collect()}[(4, 2)] == "4,00"


def test_two_lines_are_no_table_and_empty_input(spark):
    rows = [("d", 1, i, "x", 50.0 + 200 * (i % 2), 100.0 + 14 * (i // 2), 60.0 + 200 * (i % 2), 110.0 + 14 * (i // 2), None, None) for i in range(4)]
    assert tables_stream.stream_tables(tables_stream.usable_words(spark.createDataFrame(rows, WORDS)))[0].count() == 0
    assert tables_stream.stream_tables(tables_stream.usable_words(spark.createDataFrame([], WORDS)))[0].count() == 0


def chain_fixture(spark, n_pages, gap=None):
    tables = [("d", f"t{p}", p, p, 2, 650.0 if p != gap else 300.0, 780.0 if p != gap else 400.0) for p in range(1, n_pages + 1)]
    t = spark.createDataFrame([(d, b, p, s, c, 20.0 if p > 1 else y0, y1) for d, b, p, s, c, y0, y1 in tables], "doc_id string, block_id string, page int, seq int, n_cols int, y0 double, y1 double")
    pages = spark.createDataFrame([("d", p, 842.0) for p in range(1, n_pages + 1)], "doc_id string, page int, height double")
    return t, pages


def test_table_chains(spark):
    for n in (2, 3, 5, 8):
        t, pages = chain_fixture(spark, n)
        got = {r["chain_id"] for r in reading_order.chain_tables(t, reading_order.table_links(t, pages)).collect()}
        assert got == {"t1"}
    t, pages = chain_fixture(spark, 4, gap=2)  # page 2 ends in the middle: its table takes no continuation
    got = sorted(r["chain_id"] for r in reading_order.chain_tables(t, reading_order.table_links(t, pages)).collect())
    assert got == ["t1", "t1", "t3", "t3"]


def test_fallback_rows(spark):
    d = spark.createDataFrame([([["a", " b "], ["c", None], ["", ""]], 90.0), ([["a"]], None)], "rows array<array<string>>, acc double")
    got = [r["c"] for r in d.select(tables_grid.fallback_confidence(F.col("rows"), F.col("acc")).alias("c")).collect()]
    assert got == [0.84, None]


def test_image_folds():
    strips = [(0, 0, 100, 10), (0, 11, 100, 20), (0, 21, 100, 30), (200, 0, 300, 30)]
    assert images.group_slices(strips) == [0, 0, 0, 1]
    assert images.cluster_drawings([(0, 0, 10, 10), (15, 0, 25, 10), (200, 200, 210, 210)]) == [0, 0, 1]


def test_config_from_env(monkeypatch):
    monkeypatch.setenv("FOLIOSPARK_SNAP", "5")
    monkeypatch.setenv("FOLIOSPARK_PAGE_MARKERS", "false")
    assert Config.from_env().snap == 5.0 and Config.from_env().page_markers is False

"""Regions, semantics, order, rendering, guard and jobs on small fixtures."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.operators import guard, jobs, reading_order, regions, render, semantics
from foliospark.schemas import TABLES, conform

BLOCK = TABLES["blocks"]


def blocks(spark, rows):
    """rows: dicts of block columns; the rest is null."""
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    base = {"doc_id": "d", "page": 1, "kind": "paragraph", "style": "body", "confidence": 1.0}
    return spark.createDataFrame([tuple({**base, "seq": i, "block_id": f"b{i}", **r}.get(n) for n in names) for i, r in enumerate(rows)], BLOCK)


def test_indel_ratio():
    assert regions.indel_ratio("abcd", "abxd") == 75.0
    assert regions.indel_ratio("", "") == 100.0
    assert regions.indel_ratio("autos nº #", "autos nº #") == 100.0


def test_fuzzy_groups_take_the_first_match():
    keys = ["tribunal de justiça #", "tribunal de justica #", "outra coisa bem longa", "tribunal de justiça ##"]
    assert regions.first_match_groups(keys, 88.0) == [0, 0, 1, 0]


def test_fuzzy_recurrence(spark):
    rows = [("d", p, 0, t, 10, 10.0, 10.0, 200.0, 20.0) for p, t in enumerate(["TRIBUNAL DE JUSTIÇA fls. 1", "TRIBUNAL DE JUSTICA fls. 2", "TRIBUNAL DE JUSTIÇA fls. 3"], 1)]
    b = spark.createDataFrame(rows, "doc_id string, page int, block_no int, text string, char_count int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", p, 595.0, 842.0) for p in (1, 2, 3)], "doc_id string, page int, width double, height double")
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    bands = regions.band_blocks(b, pages)
    assert regions.recurrent_fuzzy(bands, n).count() == 3
    assert regions.recurrent_exact(bands, n).count() == 2  # two of three pages are 0.67
    single = n.withColumn("pages", F.lit(1))
    assert regions.recurrent_fuzzy(bands, single).count() == 0


LINE = "doc_id string, page int, block_no int, line_no int, text string, size double, font string, bold_ratio double, italic_ratio double, confidence double, x0 double, y0 double, x1 double, y1 double, stripped string, n_chars int, is_bold boolean, is_italic boolean"


def lines(spark, rows):
    out = []
    for i, (block, text, size, bold, x0, y0) in enumerate(rows):
        out.append(("d", 1, block, i, text, size, "F", float(bold), 0.0, 1.0, x0, y0, x0 + 6.0 * len(text), y0 + size, text.strip(), len(text.strip()), bold, False))
    return spark.createDataFrame(out, LINE)


def test_headings_lists_and_paragraphs(spark):
    body = "texto corrido do corpo do documento com muitas palavras na mesma linha"
    l = lines(spark, [(0, "1. DOS FATOS", 14.0, True, 56.0, 60.0), (1, body, 10.0, False, 56.0, 90.0), (1, body, 10.0, False, 56.0, 104.0), (2, "a) primeiro pedido da parte", 10.0, False, 56.0, 140.0), (3, body, 10.0, False, 56.0, 170.0)])
    pages = spark.createDataFrame([("d", 1, 595.0, 842.0)], "doc_id string, page int, width double, height double")
    got = {r["block_no"]: r for r in semantics.classify(l, pages).collect()}
    assert (got[0]["kind"], got[0]["level"], got[0]["numbering"], got[0]["text"]) == ("heading", 1, "1", "DOS FATOS")
    assert (got[2]["kind"], got[2]["marker"], got[2]["text"]) == ("list_item", "a)", "primeiro pedido da parte")
    assert got[1]["kind"] == "paragraph" and got[1]["text"] == body + " " + body


def test_footnotes(spark):
    l = lines(spark, [(0, "sem marca", 8.0, False, 56.0, 700.0), (0, "1. primeira nota", 8.0, False, 56.0, 710.0), (0, "continua", 8.0, False, 56.0, 720.0), (0, "[2] segunda", 8.0, False, 56.0, 730.0)])
    got = [(r["marker"], r["text"]) for r in semantics.footnotes(l).orderBy("note_no").collect()]
    assert got == [("*", "sem marca"), ("1", "primeira nota continua"), ("2", "segunda")]


def test_stitching(spark):
    rows = [{"text": "o autor requer o paga-", "page": 1, "x0": 1.0, "y0": 1.0}, {"text": "mento da dívida e", "page": 2, "x0": 1.0, "y0": 1.0}, {"text": "das custas.", "page": 3, "x0": 1.0, "y0": 1.0}]
    o = reading_order.reading_order(blocks(spark, rows))
    one = [r["text"] for r in reading_order.stitch_paragraphs(o, True).orderBy("ord").collect()]
    assert one == ["o autor requer o pagamento da dívida e", "das custas."]
    chained = reading_order.stitch_paragraphs(o, True, chain=True).collect()
    assert [r["text"] for r in chained] == ["o autor requer o pagamento da dívida e das custas."] and chained[0]["pieces"] == [1, 2, 3]
    done = reading_order.reading_order(blocks(spark, [{**rows[0], "text": "fim."}, rows[1]]))
    assert reading_order.stitch_paragraphs(done, True).count() == 2


def test_captions(spark):
    rows = [{"kind": "figure", "x0": 10.0, "y0": 100.0, "x1": 200.0, "y1": 200.0}, {"text": "Figura 1 - planta", "x0": 10.0, "y0": 210.0, "x1": 100.0, "y1": 220.0}, {"text": "Figura 2: longe", "x0": 10.0, "y0": 300.0, "x1": 100.0, "y1": 310.0}, {"text": "Foto 3. acima", "x0": 10.0, "y0": 80.0, "x1": 100.0, "y1": 90.0}]
    b = blocks(spark, rows)
    got = reading_order.nearest_captions(b.where("kind = 'figure'"), b.where("kind <> 'figure'")).collect()
    assert [(r["caption_id"], r["distance"]) for r in got] == [("b3", 10.0)]  # a tie of 10 goes to the later text


def test_table_markdown(spark):
    d = spark.createDataFrame([([["a", "b|c"], ["1"]], 1), ([["a", "b"], ["c", "d"], ["1", "2"]], 2), ([["x", "y"]], 1)], "rows array<array<string>>, h int")
    got = [r["m"] for r in d.select(render.table_markdown(F.col("rows"), F.col("h"), F.array(F.lit("left"), F.lit("right"))).alias("m")).collect()]
    assert got[0] == "| a | b\\|c |\n| :--- | ---: |\n| 1 |  |"
    assert got[1] == "| a<br>c | b<br>d |\n| :--- | ---: |\n| 1 | 2 |"
    assert got[2] == "|  |  |\n| :--- | ---: |\n| x | y |"


def test_list_items_keep_their_marker(spark):
    d = spark.createDataFrame([("x", "3.", True, 0), ("x", "c)", True, 1), ("x", "-", False, 0), (None, None, None, None)], "t string, m string, o boolean, l int")
    assert [r["i"] for r in d.select(render.list_item(F.col("t"), F.col("m"), F.col("o"), F.col("l")).alias("i")).collect()] == ["3. x", "  - c) x", "- x", "- "]


def test_documents(spark):
    b = blocks(spark, [{"kind": "heading", "level": 2, "text": "Fatos", "numbering": "1", "x0": 1.0, "y0": 1.0}, {"text": "- não é lista", "x0": 1.0, "y0": 2.0}, {"kind": "list_item", "marker": "a)", "ordered": True, "list_level": 0, "text": "um", "x0": 1.0, "y0": 3.0}, {"kind": "list_item", "marker": "b)", "ordered": True, "list_level": 0, "text": "dois", "x0": 1.0, "y0": 4.0}, {"text": "fim", "style": "quote", "page": 2, "x0": 1.0, "y0": 1.0, "needs_review": True, "review_reason": "x"}])
    got = render.documents(reading_order.page_breaks(reading_order.reading_order(b))).first()["markdown"]
    assert got == "## 1 Fatos\n\n\\- não é lista\n\n- a) um\n- b) dois\n\n<!-- página 2 -->\n\n<!-- REVISAR: x -->\n\n> fim\n"


@pytest.mark.parametrize(
    "gone, new, want",
    [("trabalha dor", "trabalhador", True), ("a b", "abx", False), ("x", "", False), ("", "x", False), ("foo foo", "foofoo", True), ("foo", "foofoo", False), ("", "", True)],
)
def test_dehyphenation_is_the_only_excuse(gone, new, want):
    assert guard.explainable(Counter(gone.split()), Counter(new.split())) is want


def test_guard_sees_transposed_amounts(spark):
    before = guard.fingerprint(blocks(spark, [{"text": "pagar R$ 1.234,00 a João"}]))
    after = guard.fingerprint(blocks(spark, [{"text": "pagar R$ 1.243,00 a João"}]))
    diff = guard.difference(before, after)
    assert {r["token"] for r in diff.where("layer = 'numbers'").collect()} == {"1.234,00", "1.243,00"}
    assert guard.preserved(diff).first()["preserved"] is False
    assert "numbers" in guard.summary(diff).first()["summary"]
    hyphen = guard.difference(guard.fingerprint(blocks(spark, [{"text": "traba- lho"}])), guard.fingerprint(blocks(spark, [{"text": "trabalho"}])))
    assert guard.preserved(hyphen).first()["preserved"] is True
    folded = guard.difference(guard.fingerprint(blocks(spark, [{"text": "STRASSE ﬁm"}])), guard.fingerprint(blocks(spark, [{"text": "straße fim"}])))
    assert folded.count() == 0


OPS = TABLES["ops"]


def test_guarded_edits(spark):
    b = blocks(spark, [{"text": "primeira par-"}, {"text": "te do texto"}, {"text": "nota"}, {"kind": "heading", "text": "Fatos", "numbering": "1.", "level": 1}, {"kind": "list_item", "text": "um", "marker": "a)"}])
    op = lambda i, name, ids, **k: ("d", i, name, ids, k.get("level"), k.get("marker"), k.get("ordered"), k.get("header_rows"), "n", "r")
    ops = spark.createDataFrame([op(0, "merge_blocks", ["b0", "b1"]), op(1, "mark_as_footnote", ["b2"], marker="*"), op(2, "demote_to_paragraph", ["b3"]), op(3, "set_heading_level", ["nada"], level=2), op(4, "mark_as_quote", ["b0"]), op(5, "promote_to_list", ["b2"], ordered=False), op(6, "reorder", ["b3", "b2"]), op(7, "flag_review", ["b0"])], OPS)
    out = guard.guarded_edits(b, ops).collect()
    outcome = {r["op_seq"]: r["outcome"] for r in out if r["outcome"]}
    assert outcome == {0: "applied", 1: "rejected", 2: "applied", 3: "failed", 4: "applied", 5: "applied", 6: "applied", 7: "applied"}
    state = {r["block_id"]: r for r in out if r["block_id"]}
    assert state["b0"]["text"] == "primeira parte do texto" and state["b0"]["style"] == "quote" and state["b0"]["needs_review"]
    assert state["b1"]["removed"] and state["b3"]["text"] == "1. Fatos" and state["b3"]["seq"] == 2 and state["b2"]["seq"] == 3


def test_jobs(spark):
    e = spark.createDataFrame([(1, "j", "b", "d", 0, "queued", 0.0), (2, "j", "b", "d", 1, "running", 0.6), (3, "j", "b", "d", 2, "running", 0.4), (4, "j", "b", "d", 3, "done", None), (4, "j", "b", "d", 3, "done", None)], "event_id bigint, job_id string, batch_id string, doc_id string, seq int, status string, fraction double").withColumn("event_ts", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    assert [r["progress"] for r in jobs.monotone(e).orderBy("seq").collect()] == [0.0, 0.6, 0.6, 0.6]
    s = jobs.job_states(e)
    board = jobs.batch_board(s).first()
    assert (board["total"], board["done"], board["progress"], board["ended"]) == (1, 1, 0.6, True)
    old = jobs.expired(s, F.lit("2025-01-01 01:00:01").cast("timestamp"))
    assert old.count() == 1 and jobs.expired(s, F.lit("2025-01-01 00:59:00").cast("timestamp")).count() == 0
    assert jobs.orphan_batches(s, old).count() == 1


def test_names_and_admission(spark):
    f = spark.createDataFrame([("b", 1, "peticao.pdf"), ("b", 2, "Peticao.pdf"), ("b", 3, "peticao-2.pdf"), ("b", 4, None)], "batch_id string, idx int, filename string")
    names = [r["folder"] for r in jobs.folder_names(f).orderBy("idx").collect()]
    assert len({n.lower() for n in names}) == 4 and names[0] == "peticao" and names[3] == "documento"
    mb = 1024 * 1024
    a = spark.createDataFrame([("b", 1, "a", 0, "%PDF-1"), ("b", 2, "b", 5, "xx"), ("b", 3, "c", 201 * mb, "%PDF-1"), *[("b", i, "d", 190 * mb, "%PDF-1") for i in range(4, 11)]], "batch_id string, idx int, filename string, bytes bigint, magic string")
    got = [r["reason"] for r in jobs.admission(a).orderBy("idx").collect()]
    assert got[:3] == ["arquivo vazio", "não é um PDF", "acima de 200 MB"] and got[3:8] == [None] * 5 and got[8:] == ["lote acima de 1000 MB no total"] * 2


def test_conform(spark):
    d = spark.createDataFrame([("d", "1", "x")], "doc_id string, page string, extra string")
    assert [f.dataType.simpleString() for f in conform(d, "pages_info").schema[:2]] == ["string", "int"]

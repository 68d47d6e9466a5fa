"""Literal cases of the string and geometry operators."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {v[1]}" for k, v in cols.items())
    return spark.createDataFrame([tuple(v[0] for v in cols.values())], schema).select(expr.alias("r")).first()["r"]


def text(spark, fn, value):
    return one(spark, fn(F.col("t")), t=(value, "string"))


@pytest.mark.parametrize(
    "value, want",
    [("a) o autor", ("a)", True, "o autor")), ("- item", ("-", False, "item")), ("1. Dos fatos", ("1.", True, "Dos fatos")), ("(3) x", ("(3)", True, "x")), ("iv) y", ("iv)", True, "y")), ("xxxix) z", ("xxxix)", True, "z")), ("texto comum", None), ("1.000 reais", None), ("", None), (None, None)],
)
def test_list_marker(spark, value, want):
    got = text(spark, T.list_marker, value)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "lines, dehyphenate, want",
    [(["trabalha-", "dor"], True, "trabalhador"), (["trabalha-", "dor"], False, "trabalha-dor"), (["sócio-", "Administrador"], True, "sócio-Administrador"), (["uma", "linha "], True, "uma linha"), ([], True, ""), (["só"], True, "só")],
)
def test_join_lines(spark, lines, dehyphenate, want):
    assert one(spark, T.join_lines(F.col("a"), F.lit(dehyphenate)), a=(lines, "array<string>")) == want


@pytest.mark.parametrize("value, want", [("R$ 1.250,00", True), ("12%", True), ("-3", True), ("12a", False), ("", False), (None, False), ("R$", False)])
def test_looks_numeric(spark, value, want):
    assert text(spark, T.looks_numeric, value) is want


@pytest.mark.parametrize("value, want", [("1-3,7", [1, 2, 3, 7]), ("5-3", []), ("3, 3,1", [1, 3]), ("0,2", [2]), ("a-b", None), ("", [])])
def test_page_list(spark, value, want):
    assert text(spark, T.page_list, value) == want


@pytest.mark.parametrize(
    "value, want",
    [("C:\\autos\\Petição.pdf", "Petição"), ("con.pdf", "documento"), ("", "documento"), (None, "documento"), ('a<b>:"c".pdf', "abc"), ("nome . .pdf", "nome"), ("x" * 200 + ".pdf", "x" * 120)],
)
def test_safe_stem(spark, value, want):
    assert text(spark, T.safe_stem, value) == want


@pytest.mark.parametrize("value, want", [("bcdf", True), ("casa", False), ("aaaab", True), ("cOnTrAtO", True), ("Contrato", False), ("CONTRATO", False)])
def test_suspect_token(spark, value, want):
    assert text(spark, T.suspect_token, value) is want


def test_escapes(spark):
    assert text(spark, T.escape_text, "- não é lista") == "\\- não é lista"
    assert text(spark, T.escape_text, "1. não é lista") == "\\1. não é lista"
    assert text(spark, T.escape_cell, "a|b\r\nc   d") == "a\\|b<br>c d"
    assert text(spark, T.collapse_blank_lines, "\n\na  \n\n\n\nb\n\n") == "a\n\nb\n"
    assert text(spark, T.yaml_escape, 'x  "y"') == 'x \\"y\\"'
    assert text(spark, T.strip_front_matter, "---\na: 1\n---\ncorpo") == "corpo"
    assert text(spark, T.recurrence_key, "Fls.  12\u00a0de 30") == "fls. # de #"


def test_provider_operations(spark):
    assert text(spark, T.provider_operations, '{"result": "```json\\n{\\"operations\\": [{\\"op\\": \\"x\\"}]}\\n```"}') == '[{"op":"x"}]'
    assert text(spark, T.provider_operations, '{"is_error": true, "result": "no"}') == "[]"
    assert text(spark, T.provider_operations, 'ok: {"operations": []} fim') == "[]"
    assert text(spark, T.provider_operations, "nada") == "[]"


def boxes(spark, a, b):
    return spark.createDataFrame([(*map(float, a), *map(float, b))], "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")


def test_boxes(spark):
    d = boxes(spark, (0, 0, 10, 10), (5, 5, 15, 15))
    r = d.select(G.intersection("a_", "b_").alias("i"), G.iou("a_", "b_").alias("u"), G.contained("a_", "b_", 0.25).alias("c"), G.vertical_overlap("a_", "b_").alias("v"), *G.union("a_", "b_")).first()
    assert (r["i"], r["c"], r["v"], r["x0"], r["x1"]) == (25.0, True, 0.5, 0.0, 15.0) and abs(r["u"] - 25 / 175) < 1e-9
    touching = boxes(spark, (0, 0, 10, 10), (10, 0, 20, 10)).select(G.intersection("a_", "b_").alias("i")).first()
    assert touching["i"] == 0.0
    flat = boxes(spark, (0, 5, 10, 5), (0, 0, 10, 10)).select(G.vertical_overlap("a_", "b_").alias("v"), G.contained("a_", "b_").alias("c")).first()
    assert flat["v"] == 0.0 and flat["c"] is False

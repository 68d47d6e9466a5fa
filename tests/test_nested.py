"""Nested records: plans, keys and every odd shape."""

import json

import pytest

from foliospark.operators import nested

SCHEMA = "report_id bigint, extra string, resultado_processamento string"


def reports(spark, values):
    return spark.createDataFrame([(i, "x", v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], SCHEMA)


def children(df):
    return sorted((r["report_id"], r["child"], r["parent_pos"], r["pos"]) for r in nested.report_children(df).collect())


def test_shapes(spark):
    page = {"numero": 1}
    got = children(
        reports(
            spark,
            [
                {"paginas": [page, None, page], "tabelas": {"total": 1, "detalhe": [{"id": "t"}]}, "warnings": [{"code": "A", "detail": {"paginas": [1, None, 3]}}]},
                {"paginas": page, "tabelas": [{"id": "t"}, None], "warnings": json.dumps([None, {"code": "B", "detail": json.dumps({"paginas": [{"page": 1}]})}])},
                {"paginas": json.dumps([page]), "tabelas": {"id": "só", "linhas": 2}, "warnings": None},
                {"tabelas": {"total": 3, "detalhe": None}, "warnings": {"code": "C", "detail": {}}},
                '{"paginas": [{"numero": 1',
                None,
                "",
                "3",
                {},
            ],
        )
    )
    assert got == sorted(
        [
            (0, "paginas", -1, 0), (0, "paginas", -1, 2), (0, "tabelas", -1, 0), (0, "warnings", -1, 0), (0, "warning_pages", 0, 0), (0, "warning_pages", 0, 2),
            (1, "paginas", -1, 0), (1, "tabelas", -1, 0), (1, "warnings", -1, 1), (1, "warning_pages", 1, 0),
            (2, "paginas", -1, 0), (2, "tabelas", -1, 0), (3, "warnings", -1, 0),
        ]
    )


def test_duplicates_and_empty_table(spark):
    df = reports(spark, [{"paginas": [{"numero": 1}]}])
    assert children(df.unionAll(df)) == [(0, "paginas", -1, 0)]
    assert children(df.limit(0)) == []


def test_foreign_keys_and_plan(spark):
    df = reports(spark, [{"warnings": [{"code": "A", "detail": {"tokens": 5, "paginas": [{"page": 9, "x": {"y": 1}}]}}]}])
    rows, plan = nested.report_tables(df)
    assert plan["warnings.detail.paginas"].parent == "warnings" and "detail.tokens" in plan["warnings"].columns and "x.y" in plan["warnings.detail.paginas"].columns
    child = nested.as_table(rows, "report_id", plan["warnings.detail.paginas"]).first()
    parent = nested.as_table(rows, "report_id", plan["warnings"]).first()
    assert child["parent_id"] == parent["row_id"] and child["page"] == "9" and parent["detail_tokens"] == "5"


def test_shared_elements_have_one_table(spark):
    """Optional fields do not part an element; two of one name in one row keep different ids."""
    records = [{"billing": {"address": {"street": "A", "city": "X"}}, "shipping": {"address": {"street": "B", "city": "Y", "note": "n"}}, "total": 3}]
    df = reports(spark, records)
    plan = nested.plan_tables(nested.schema_graph(df, "resultado_processamento"))
    assert set(plan) == {"", "billing.address"} and plan["billing.address"].paths == ("billing.address", "shipping.address")
    assert plan["billing.address"].columns == ("city", "note", "street") and plan[""].columns == ("total",)
    rows = nested.flatten(df, "report_id", "resultado_processamento", plan)
    got = nested.as_table(rows, "report_id", plan["billing.address"]).orderBy("street").collect()
    assert [(r["street"], r["city"], r["note"]) for r in got] == [("A", "X", None), ("B", "Y", "n")] and len({r["row_id"] for r in got}) == 2


@pytest.mark.parametrize("depth", [3, 200])
def test_recursive_elements_refer_to_their_own_table(spark, depth):
    record = {"v": depth, "w": 0}
    for i in reversed(range(depth)):
        record = {"v": i, "w": 0, "node": record} if i else {"id": 1, "node": record}
    df = reports(spark, [record])
    plan = nested.plan_tables(nested.schema_graph(df, "resultado_processamento"))
    assert set(plan) == {"", "node"} and plan["node"].parents == ("", "node") and plan["node"].columns == ("v", "w")
    rows = nested.as_table(nested.flatten(df, "report_id", "resultado_processamento", plan), "report_id", plan["node"]).collect()
    assert sorted(int(r["v"]) for r in rows) == list(range(1, depth + 1))
    ids = {r["row_id"] for r in rows}
    assert sum(r["parent_tbl"] == "node" and r["parent_id"] in ids for r in rows) == depth - 1


def test_lists_of_themselves(spark):
    leaf = {"name": "c", "size": 1, "parts": []}
    df = reports(spark, [{"parts": [{"name": "a", "size": 3, "parts": [{"name": "b", "size": 2, "parts": [leaf, leaf]}]}]}])
    plan = nested.plan_tables(nested.schema_graph(df, "resultado_processamento"))
    rows = nested.flatten(df, "report_id", "resultado_processamento", plan).where("tbl = 'parts'").collect()
    assert set(plan) == {"", "parts"} and len(rows) == 4 and {r["pos"] for r in rows} == {0, 1}

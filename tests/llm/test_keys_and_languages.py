"""Null and repeated keys, languages without word lists, parameters that cannot work."""

import pytest

pytest.importorskip("foliospark.llm.queries")

from foliospark.llm import packing, privacy, quality, sentences, splitting  # noqa: E402

BLOCK = "doc_id string, block_id string, text string"
KEYLESS = [(None, None, "Contato por ana@mail.example.org. Decido."), ("d", "b", "Escreva a rui@mail.example.org. Sim."), ("d", "b", "Nada consta. O réu saiu."), ("d", None, "Ligue para (72) 97016-6648. Pronto.")]


def test_null_and_repeated_keys_lose_nothing(spark):
    df = spark.createDataFrame([*KEYLESS, KEYLESS[0]], BLOCK)
    parts = spark.createDataFrame([("Ana", "given")], "part_text string, role string")
    got = {(r["doc_id"], r["block_id"], r["pii_kind"]) for r in privacy.items(df, parts).collect()}
    assert got == {(None, None, "email"), ("d", "b", "email"), ("d", None, "phone")}
    red = [r["text"] for r in privacy.redact(df, parts).collect()]
    assert len(red) == 5 and not any("@" in t or "97016" in t for t in red) and "Nada consta. O réu saiu." in red
    ab = spark.createDataFrame([("pt", "art.")], "lang string, abbrev string")
    rows = sentences.sentences(df, ab).collect()
    assert len(rows) == 8 and {r["sentence"] for r in rows if r["block_id"] == "b"} == {"Escreva a rui@mail.example.org.", "Sim.", "Nada consta.", "O réu saiu."}


def test_script_of_a_text_does_not_hide_its_items(spark):
    df = spark.createDataFrame([("d", "1", "Пишите на ivan.petrov@mail.example.org"), ("d", "2", "тел. (72) 97016-6648")], BLOCK)
    parts = spark.createDataFrame([("Ana", "given")], "part_text string, role string")
    assert {(r["block_id"], r["pii_kind"]) for r in privacy.items(df, parts).collect()} == {("1", "email"), ("2", "phone")}


def test_prose_of_a_language_without_word_list_is_prose(spark):
    words = "sąd uznał że świadek złożył zeznania przed świtem i wrócił do domu gdy deszcz ustał nad rzeką a dzieci spały spokojnie w małym pokoju".split()
    texts = [" ".join(words[i % 7 :] + words[: i % 7]).capitalize() + ". " + " ".join(words[i % 5 : 15]).capitalize() + "." for i in range(40)]
    rows = [(i, t, "pl") for i, t in enumerate(texts)] + [(100, "- " + "\n- ".join(words), "pl"), (101, None, "pl"), (102, "", None)]
    got = {r["doc_id"]: r for r in quality.report(spark.createDataFrame(rows, "doc_id int, text string, lang string"), {"pt": ["de", "que"]}).collect()}
    assert {got[i]["doc_class"] for i in range(40)} == {"prose"} and got[0]["lang_group"] == "pl"
    assert got[101]["doc_class"] == got[102]["doc_class"] == "prose"


@pytest.mark.parametrize("limit, overlap", [(10, 10), (10, 12), (10, -1)])
def test_overlap_must_leave_room(limit, overlap):
    with pytest.raises(ValueError):
        splitting.split_text("x" * 50, limit, overlap)


def test_containers_cover_every_item(spark):
    sizes = [(i, n) for i, n in enumerate([5, 7, 9, 100, 3, 3, 64, 64, 64, 250, 0, None, 1] * 40)]
    out = packing.pack(spark.createDataFrame(sizes, "doc_id int, n_tokens int"), 100)
    per_item = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert per_item == {i: n or 0 for i, n in sizes}
    used = {r["container_id"]: r["n"] for r in out.groupBy("container_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    # no fewer will do: 120 of 64 stand alone, 40 + 80 are full, 40 remainders of 50 pair up
    assert max(used.values()) <= 100 and len(used) == 260
    assert out.groupBy("doc_id", "piece_no").count().where("count > 1").count() == 0

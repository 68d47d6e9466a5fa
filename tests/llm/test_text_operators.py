"""The text operators on small fixtures, brute force and round trips."""

import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("foliospark.llm.queries")

from foliospark.llm import lookalikes, mojibake, packing, privacy, quality, scans, sentences, splitting, tokens  # noqa: E402

ROW = "doc_id string, page int, item string, text string, form string"


# --- look-alikes ---------------------------------------------------------------------------------------------------
def test_classes_are_transitive():
    where = {m: r for r, ms in lookalikes.classes().items() for m in ms}
    assert where["a"] == where["ａ"] == where["а"] and where["o"] == where["о"] == where["ο"]
    assert where["é"] == where["é"] and where["fi"] == where["ﬁ"] and where["K"] == where["K"]
    assert where[" "] == where[" "] == where["　"] and where["​"] == where["﻿"]
    assert "º" not in where or where["º"] != where.get("o")


@pytest.fixture(scope="module")
def rewriter():
    return lookalikes.Rewriter(*lookalikes.representatives({}))


@pytest.mark.parametrize(
    "text, want",
    [
        ("ｃａｒｔａ", "carta"), ("publicação", "publicação"), ("aрós", "após"), ("R‎$", "R$"), ("nº 1ª m²", "nº 1ª m²"), ("“a” – b", "“a” – b"), ("Только шум", "Только шум"),
        ("και", "και"), ("利率为1，金额！", "利率为1，金额！"), ("４，２", "4,2"), ("a b", "a b"), ("ﬁm", "fim"), ("", ""), ("Тoлько", "Только"),
    ],
)
def test_rewrite(rewriter, text, want):
    assert rewriter.settle(text, "LATIN") == want
    assert rewriter.settle(want, "LATIN") == want


def test_lookalikes_in_every_row(spark):
    rows = [("d", 1, "1", "ｃasa", "x"), ("d", 1, "1", "ｃasa", "x"), ("d", 1, "2", None, "x"), ("d", 1, "3", "", "x"), ("d", 1, "4", "casa", "x"), ("d", 2, "1", "а", "x"), ("r", 1, "1", "а", "x"), ("r", 1, "2", "слышал только шум", "x"), ("d", None, "9", "x​" * 5000, None)]
    df = spark.createDataFrame(rows, ROW)
    got = {(r["doc_id"], r["page"], r["item"]) for r in lookalikes.found(df).collect()}
    assert got == {("d", 1, "1"), ("d", 2, "1"), ("d", None, "9")}  # the lone letter follows its page
    norm = lookalikes.normalize(df)
    assert norm.columns == df.columns and norm.count() == len(rows)
    assert norm.where("item = '9'").first()["text"] == "x" * 5000
    assert lookalikes.found(df.limit(0)).count() == 0


# --- encodings -----------------------------------------------------------------------------------------------------
CLEAN = ["A apelação do Exmo. Sr. relator versa sobre a revisão (v. fls. 250/7).", "“Não houve acordo”, anotou a ré; nº 1ª m².", "Das Gebäude wurde für 5,70 % verkauft, außerdem.", "Истец просит вернуть залог.", "Μάρτυρας άκουσε μόνο θόρυβο.", "证人说：“我没看见。”", "SÃO CONDIÇÕES DO LEILÃO", "IRMÃ SEGURADA – NOÇÕES"]


CORRECT = """Besançon, Île-de-France : l’Œuvre d’Étienne, où Noël naquit à L’Haÿ-les-Roses.
Kraków, Łódź i Gdańsk: zażółć gęślą jaźń. Święta Ćma ŻÓŁW ŹDŹBŁO.
Příliš žluťoučký kůň úpěl ďábelské ódy. Škoda, Čeněk, Říp, ÚŘAD ŽIŽKOV.
Őszinte köszönet a hűséges vevőknek; árvíztűrő tükörfúrógép, ÁRVÍZTŰRŐ.
Niğde’de şiir, ağaç ve İstanbul’dan ığdır; ÇOĞUNLUK ŞİŞLİ.
Mulțumesc pentru știrea despre București, Iași și Brașov; în țară. ŞTEFAN CEL MARE, Ţara Moţilor.
Щоб їжак не з’їв ґаву, Євген її сховав. Вік, Війна, Її.
Љубав, Ђорђе, ћирилица и џез у Нишу. Ўзбекістан, беларуская мова.
Nguyễn Thị Phượng ở thành phố Hồ Chí Minh, Việt Nam; đường Lý Thường Kiệt.
Þórður á Ísafirði, Ægir og Ðrífa. Blåbærsyltetøy på Ærø, Åse og Øystein.
Äiti söi öljyä; Õhtu jõuab Tõrva. Šiauliai, Žemaitija, ąčęėįšųūž. Rīga, ķēniņš, ģimene.
Weiß, Straße, Großmutter, Fußball, Maßregel, STRAßE, „Ärger“ über Übermut.
Garantizó el niño: «¿Qué pasó?» ¡Olé! L’Hospitalet de l’Infant, col·legi, paral·lel.
Foo® and Bar™ cost 50¢, £5, ¥100 or €3; x² + y³ ≤ 4 ± 0.5, 20 °C, µm, 5 µg, ½ cup, a – b — c…
“MANHû disse a IRMÃ–madre em ALEMÃ… Já é amanhã. “Não.” ‘Sim.’ nº 1ª 2º §5 ¶ 7
├── src
│   └── main.py ─┬─ ok ═╗
Η Αθήνα είναι πρωτεύουσα; α, β και γ. Ώρα Έλλης. 北京大学，T恤 A座！ 「はい。」 ข้อความ हिन्दी عربي، نص؟
Irish: na hÉireann agus nÉirinn; Welsh: tŷ, ŵyn; Maori: Māori, whānau; Hawaiian: Kaʻū.
Ünal İpek, Żółkiewski, Dvořák, Ångström, Čapek, Ñandú, Ïle, Ÿ, Æon and naïve café coöperation.
Déjà-vu à Orléans, ça va ? Là-bas, être ou ne pas être. Ô Dieu ! À bientôt. DÉJÀ VU, ÇA VA, PÂQUES, MAÎTRE""".split("\n")


@pytest.mark.parametrize("text", [*CLEAN, *CORRECT, *[w for line in CORRECT for w in line.split(" ") if not w.isascii()], "\n".join(CORRECT)])
def test_correct_text_is_never_touched(text):
    assert mojibake.repair(text)[1] == text
    if text in (*CLEAN, *CORRECT) and "Irish" not in text:  # prefixes before capitals look like evidence, but no reading is cheaper
        assert mojibake.repair(text) == (0, text, 0)


@pytest.mark.parametrize("layers", [1, 2, 3, 5])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
@pytest.mark.parametrize("text", ["A devolução do réu às 3 horas não", "Kraków, Łódź i Gdańsk", "Ще не вмерла Україна", "日本語の文書"])
def test_any_number_of_layers(text, wrong, layers):
    table, garbled = {b: c for c, b in mojibake._tables(wrong).items()}, text
    for _ in range(layers):
        garbled = "".join(table[b] for b in garbled.encode("utf-8"))
    assert mojibake.repair(garbled)[1:] == (text, 0)


def test_correct_rows_of_many_languages_are_not_affected(spark):
    df = spark.createDataFrame(list(enumerate(CORRECT)), "k int, text string")
    assert mojibake.affected(df).count() == 0
    back = mojibake.restore(df.union(df).unionByName(spark.createDataFrame([(99, "imÃ³vel"), (98, None)], "k int, text string")))
    assert back.count() == 2 * len(CORRECT) + 2 and back.where("k = 99").first()["text"] == "imóvel"


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "iso8859-2"])
@pytest.mark.parametrize("text", CLEAN[:2])
def test_round_trip(text, wrong):
    table = {b: c for c, b in mojibake._tables(wrong).items()}
    garbled = "".join(table[b] for b in text.encode("utf-8"))
    before, fixed, after = mojibake.repair(garbled)
    assert before > 0 and after == 0 and fixed == text


def test_nested_and_partial_layers():
    text = "O réu pediu a devolução"
    twice = text.encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252")
    assert mojibake.repair(twice)[1] == text
    assert mojibake.repair("a ré pediu a devolução do imÃ³vel")[1] == "a ré pediu a devolução do imóvel"


def test_affected_rows(spark):
    df = spark.createDataFrame([(1, "imÃ³vel", "z"), (1, "imÃ³vel", "z"), (2, None, "z"), (3, "", None), (4, "loca��o", "z"), (5, "locação", "z")], "k int, text string, repaired2 string")
    got = {r["k"]: (r["repaired"], r["restorable"]) for r in mojibake.affected(df).collect()}
    assert got == {1: ("imóvel", True), 4: ("loca��o", False)}
    assert mojibake.affected(df.limit(0)).count() == 0


# --- personal data -------------------------------------------------------------------------------------------------
BLOCK = "doc_id string, block_id string, text string, words string"


def people(spark):
    given = ["Amarildo", "Lucrécia", "Tércio", "Dorotéia", "Isolda", "Marfisa", "Odilo", "Jacira"]
    family = ["Ventosa", "Bragantim", "Brisaque", "Monfalim", "Granjelo", "Olivarte"]
    rows, i = [], 0
    for g in given:
        for s in family:
            rows.append(("d", f"n{i}", f"A conta está em nome de {g} {s}. O réu contratou a Cia. Tramontana no município de Dom Valdomar.", None))
            i += 1
    return rows, spark.createDataFrame([("Amarildo", "given"), ("Lucrécia", "given"), ("Tércio", "given"), ("Ventosa", "surname"), ("Bragantim", "surname"), ("Brisaque", "surname"), ("Tramontana", "surname"), ("Valdomar", "surname"), (None, None)], "part_text string, role string")


def test_personal_items(spark):
    rows, parts = people(spark)
    extra = [
        ("d", "a", "Contato pelo número (72) 97016-6648 ou por odilo_b+x (at) contato.example.net.", None),
        ("d", "b", "Consta do cadastro: Isolda Granjelo, RG 960.122.138-70, tel.: 39-98726-8819.", None),
        ("d", "c", "A vistoria na Rua Dona Perpétua, nº 12, casa 2 foi feita. CNPJ 20.789.157/0001-15, autos nº 7749393-54.2024.0.00.4385, Lei nº 9.832/1993.", None),
        ("d", "e", None, None), ("d", "f", "", None), ("d", "g", "Usou-se a chave art@inciso.", None), ("d", "h", "Notice was served on Ms. Marfisa Olivarte at 123 Quay Avenue, Greyford.", None),
    ]
    df = spark.createDataFrame([*rows, *rows[:3], *extra], BLOCK)
    got = {}
    for r in privacy.items(df, parts).collect():
        got.setdefault(r["block_id"], set()).add((r["pii_kind"], r["start_at"]))
    assert all(got[f"n{i}"] == {("name", 24)} for i in range(48))
    assert got["a"] == {("phone", 20), ("email", 43)}
    assert got["b"] == {("name", 20), ("id_number", 40), ("phone", 62)}
    assert got["c"] == {("address", 14)}
    assert got["h"] == {("name", 25), ("address", 45)}
    assert not {"e", "f", "g"} & set(got)
    red = {r["block_id"]: r["text"] for r in privacy.redact(df.distinct(), parts).collect()}
    assert red["b"] == "Consta do cadastro: [NAME], RG [ID_NUMBER], tel.: [PHONE]." and red["e"] is None
    assert privacy.items(df.limit(0), parts).count() == 0


# --- sentences -----------------------------------------------------------------------------------------------------
PAR = "doc_id string, block_id string, text string, token string"


def split(spark, *texts):
    df = spark.createDataFrame([("d", f"b{i}", t, "x") for i, t in enumerate(texts)], PAR)
    ab = spark.createDataFrame([("pt", "art."), ("de", "z. B."), ("pt", None)], "lang string, abbrev string")
    out = {f"b{i}": [] for i in range(len(texts))}
    for r in sentences.sentences(df, ab).orderBy("block_id", "sentence_no").collect():
        out[r["block_id"]].append(r["sentence"])
    return list(out.values())


def test_sentences(spark):
    cases = {
        "A testemunha declarou: “Não vi. Cheguei depois!” e saiu. Decido.": ["A testemunha declarou: “Não vi. Cheguei depois!” e saiu.", "Decido."],
        "Nos termos do art. 320 da Lei. O Exmo. Sr. relator votou": ["Nos termos do art. 320 da Lei.", "O Exmo. Sr. relator votou"],
        "Respondeu: “Quem abriu?” Intimem-se.": ["Respondeu: “Quem abriu?”", "Intimem-se."],
        "A perita mediu 1,74 m². Foi em 12.3.2009... O réu contratou a Ventorra S.A. O autor não.Que se cumpra!": ["A perita mediu 1,74 m².", "Foi em 12.3.2009...", "O réu contratou a Ventorra S.A.", "O autor não.", "Que se cumpra!"],
        "Der Zinssatz lag bei 5,70 %, d. h. z. B. nicht bei 1 %. So entschieden.": ["Der Zinssatz lag bei 5,70 %, d. h. z. B. nicht bei 1 %.", "So entschieden."],
        "证人说：“我没看见。我听见。”然后离开。请立即执行！": ["证人说：“我没看见。我听见。”然后离开。", "请立即执行！"],
        "被告は「知らない。」と述べた。理由があるか？": ["被告は「知らない。」と述べた。", "理由があるか？"],
        "दीवार गिर गई। क्या सूचना मिली?": ["दीवार गिर गई।", "क्या सूचना मिली?"],
        "هل تسلم المفتاح؟ انهار الجدار.": ["هل تسلم المفتاح؟", "انهار الجدار."],
        "Παρέλαβε κανείς κλειδιά; Μάρτυρας άκουσε.": ["Παρέλαβε κανείς κλειδιά;", "Μάρτυρας άκουσε."],
        "ผู้เช่าชดใช้เงิน 4 บาท ผู้ขายไม่เคยส่งมอบกุญแจ": ["ผู้เช่าชดใช้เงิน 4 บาท", "ผู้ขายไม่เคยส่งมอบกุญแจ"],
        "  \n ": [], "sem ponto": ["sem ponto"],
    }
    assert split(spark, *cases) == list(cases.values())


def test_sentence_starts_nulls_and_duplicates(spark):
    ab = spark.createDataFrame([], "lang string, abbrev string")
    df = spark.createDataFrame([("d", "a", "Um. Dois.", "x"), ("d", "a", "Um. Dois.", "x"), ("d", "b", None, None), (None, "c", "Só.", "x"), ("d", "e", "a" * 20000 + ". B", "x")], PAR)
    got = sorted(((r["doc_id"] or "", r["block_id"], r["start_at"]) for r in sentences.starts(df, ab).collect()))
    assert got == [("", "c", 0), ("d", "a", 0), ("d", "a", 4), ("d", "e", 0), ("d", "e", 20002)]
    assert sentences.starts(df.limit(0), ab).count() == 0


# --- splitting -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["Uma frase curta. " * 60, "x" * 1234, "palavra " * 200, "\n\n".join(["linha " * 20] * 9), "利率为三。" * 300, "á" * 900])
def test_pieces_fit_cover_and_overlap(text):
    pieces = splitting.split_text(text, 400, 40)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(e - s <= 400 for s, e in pieces)
    assert all(b[0] == a[1] - 40 for a, b in zip(pieces, pieces[1:]))


def test_cuts_fall_on_strong_boundaries():
    text = ("uma frase de exemplo com palavras. " * 10).strip() + "\n\n" + ("outra frase aqui. " * 18).strip()
    cut = splitting.split_text(text, 400, 40)[0][1]
    assert text[:cut].endswith("\n\n")


def test_merging_equals_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))]
        strengths = [rng.random() for _ in sizes[1:]]
        groups = [[i] for i in range(len(sizes))]
        while True:  # the weakest boundary whose sides still fit
            fits = [(strengths[g[-1]], k) for k, (g, h) in enumerate(zip(groups, groups[1:])) if sum(sizes[i] for i in g + h) + 2 <= 20]
            if not fits:
                break
            k = min(fits)[1]
            groups[k : k + 2] = [groups[k] + groups[k + 1]]
        assert splitting.merge_segments(sizes, strengths, 20, 2) == [(g[0], g[-1] + 1) for g in groups]


def test_block_windows_cover_every_block(spark):
    n = 9001
    df = spark.range(n).select(F.lit("d").alias("doc_id"), F.format_string("b%05d", "id").alias("block_id"), F.col("id").alias("seq"), F.when(F.col("id") % 37 == 0, "heading").when(F.col("id") % 11 == 0, "page_break").otherwise("paragraph").alias("kind"), F.lit(1).alias("level"), F.lit("x").alias("text"))
    few = spark.range(120).select(F.lit("e").alias("doc_id"), F.col("id").cast("string").alias("block_id"), F.lit(None).cast("long").alias("seq"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit("x").alias("text"))
    got = splitting.block_pieces(df.unionByName(few).unionByName(few), 120, 5).orderBy("piece_no").collect()
    total = df.where("kind <> 'page_break'").count()
    assert {r["doc_id"] for r in got} == {"d"} and got[0]["start_pos"] == 0 and got[-1]["end_pos"] == total
    assert all(r["n_blocks"] <= 120 for r in got) and all(b["start_pos"] == a["end_pos"] - 5 for a, b in zip(got, got[1:]))
    assert splitting.block_pieces(df.limit(0), 120, 5).count() == 0


def test_long_texts_only(spark):
    df = spark.createDataFrame([("d", "a", "x " * 300, 1), ("d", "a", "x " * 300, 1), ("d", "b", "x" * 400, 1), ("d", "c", None, 1)], "doc_id string, block_id string, text string, piece int")
    got = splitting.text_pieces(df, 400, 40).collect()
    assert {r["block_id"] for r in got} == {"a"} and len(got) == len({r["piece_no"] for r in got})


# --- tokens and packing --------------------------------------------------------------------------------------------
TEXTS = [None, "", " ", "Olá, mundo!", "don't  stop\n\n", "a" * 3000, "👩‍⚖️ ⚖️", "<|endoftext|>", "你好。", "x1 y　z", "\r\n\t\x1c", "½²ª", "aaaa" * 700]


def reference(texts):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [enc.encode_ordinary(t) if t else [] for t in texts]


def test_tokens_equal_the_library_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, pos int, piece string")
    ids = tokens.encode_corpus(df)
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)
    back = {r["doc_id"]: r["t"] for r in ids.select("doc_id", tokens.decode_ids(F.col("ids")).alias("t")).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint")
    return packing.pack(df, capacity)


def test_packing_places_every_token_once(spark):
    import random

    rng = random.Random(5)
    sizes = [0, None, 5000, 2048, 2049, *[rng.choice([3, 7, 200, 700, 1100, 1500]) for _ in range(800)], *[700] * 400]
    rows = packed(spark, sizes, 2048).collect()
    used = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(s or 0 for s in sizes)
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
    assert set(per) == set(range(len(sizes)))
    assert all(len(p) == 1 for d, p in per.items() if (sizes[d] or 0) <= 2048)
    assert sorted(per[2]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    bins = []
    for n in sorted((r["n_tokens"] for r in rows if r["n_tokens"]), reverse=True):  # first fit decreasing
        k = next((k for k, b in enumerate(bins) if b + n <= 2048), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(used) <= 1.02 * len(bins) + 1


def test_packing_of_nothing(spark):
    assert packed(spark, [], 10).count() == 0
    assert [r["container_id"] for r in packed(spark, [0, 0], 10).collect()] == [0, 0]


def test_plan_keeps_the_histogram():
    hist = {1: 1000, 3: 50, 7: 77, 10: 5}
    runs = packing.plan(hist, 10)
    placed = {}
    for r in runs:
        assert sum(n * k for n, k in r.pattern) <= 10
        for n, k in r.pattern:
            placed[n] = placed.get(n, 0) + k * r.count
    assert placed == hist


# --- quality -------------------------------------------------------------------------------------------------------
def test_classes(spark):
    prose = "O autor requereu a revisão do contrato, nos termos do art. 359 da Lei. A ré alegou que não houve entrega das chaves no local. Decido que o pedido é procedente em parte, com base na prova. "
    rows = [(i, prose * (1 + i % 3), "pt") for i in range(40)]
    rows += [
        (100, "\n".join(f"- {x} de {y} {i}" for i, (x, y) in enumerate(zip("a certidão|o laudo|a ata|o termo|a planilha|o recibo|a procuração|o extrato|o contrato|a escritura".split("|") * 2, "matrícula vistoria assembleia entrega cálculo quitação banco caixa locação venda bens prova obra imóvel multa juros posse folha prazo dano".split()))), "pt"), (101, "Data;Valor;Qtd.\n" + "\n".join(f"0{i}/02/2020;{i};-" for i in range(1, 9)), "pt"), (102, "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 9, None),
        (103, "clique AGORA " * 40, "pt"), (104, "xbmd rlqj gnvwv dfd vgbt lfxz bcrpf jbzdw hklz mpft " * 4, "PT"), (105, "\\%_[ {||*<=+_>} ¬ @[~>] & " * 8, "und"), (106, None, None), (107, "", "pt"), (108, "  ", "pt"), (109, prose.upper(), "pt-BR"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    common = {"pt": ["o", "a", "de", "do", "da", "que", "em", "no", "não", "é", "com", "das", "os"]}
    got = {r["doc_id"]: r for r in quality.report(df, common).collect()}
    kinds = {k: v["doc_class"] for k, v in got.items()}
    assert all(kinds[i] == "prose" for i in [*range(40), 106, 107, 108, 109])
    assert [kinds[i] for i in range(100, 106)] == ["list", "table", "table", "junk", "junk", "junk"]
    assert got[106]["word_count"] == 0 and got[106]["distance"] is None
    far = got[100]
    parts = [far[f"from_{f}"] for f in quality.FEATURES]
    assert abs(sum(parts) - far["distance"] ** 2) < 1e-6 * far["distance"] ** 2
    assert quality.report(df.limit(0), common).count() == 0


# --- scanned pages -------------------------------------------------------------------------------------------------
OCR = "doc_id string, page int, text string, conf double, left_px int, top_px int, width_px int, height_px int, block_num int, par_num int, line_num int, word_num int, noise string"


def scanned(pages):
    """pages: page -> [(top, text)] with a block per line group."""
    rows = []
    for (doc, page), lines in pages.items():
        for i, (top, text) in enumerate(lines):
            x = 230
            for k, w in enumerate(text.split(" "), 1):
                rows.append((doc, page, w, 40.0 if w in ("|", ",,") else 92.0, x, top, 20 * len(w), 40, 1 if top < 300 else 2 if top < 3200 else 3, 1, i + 1, k, None))
                x += 20 * len(w) + 20
    return rows


def test_scan_noise(spark):
    body = ["a testemunha declarou que a certidão de matrícula", "foi juntada pela vice-presidente do conselho e pela"]
    pages = {}
    for p in range(1, 13):
        lines = [(88, "Autos nº 5388929-83.2010"), *[(330 + 50 * i, t) for i, t in enumerate(body)], (3347, f"fls. {50 + p}")]
        pages[("d", p)] = lines
    pages[("d", 3)][0] = (88, "Aut0s nº 5388929-83.2010")
    pages[("d", 4)][1:3] = [(330, "a testemunha declarou que a certi-"), (380, "dão de matrícula | foi juntada pela vice-"), (430, "presidente do conselho dEcLaRoU mat^rícula")]
    df = spark.createDataFrame(scanned(pages), OCR)
    extra = spark.createDataFrame([("d", 4, None, None, None, None, None, None, 2, 1, 99, 1, None), (None, None, "x", -1.0, 1, 1, 1, 1, 1, 1, 1, 1, None)], OCR)
    got = {}
    for r in scans.found(df.unionByName(extra).unionByName(df.limit(20))).collect():
        got.setdefault(r["noise"], set()).add((r["page"], r["block_num"], r["line_num"], r["word_num"]))
    assert {(p, 1, 1, w) for p in range(1, 13) for w in (1, 2, 3)} == got["header"]
    assert len(got["page_number"]) == 24
    assert got["hyphen"] == {(4, 2, 2, 6)}
    assert {(4, 2, 3, 4)} == got["speck"]
    assert got["misread"] == {(4, 2, 4, 4), (4, 2, 4, 5)}
    whole = scans.paragraphs(df).collect()
    assert len(whole) == 1 and whole[0]["page"] == 1  # every page goes on in the next: nothing is lost on the way
    assert "certidão de matrícula foi juntada pela vice-presidente" in whole[0]["text"] and whole[0]["text"].count("testemunha") == 12
    assert scans.found(df.limit(0)).count() == 0


def test_page_numbers_run_on_and_cut_words_cross_pages(spark):
    body = ["a testemunha declarou que a certidão de matrícula", "foi juntada pela vice-presidente do conselho"]
    pages = {("d", p): [(88, f"Recibo {40 + p}"), *[(330 + 50 * i, t) for i, t in enumerate(body)]] for p in range(1, 7)}
    pages[("d", 3)][0] = (88, "Recibo 77")  # another number at the same place does not run on
    pages[("d", 5)] += [(430, "a matrí-")]
    pages[("d", 6)][1] = (330, "cula que a testemunha declarou")
    pages[("e", 1)] = [(88, "Recibo 12"), (330, body[0])]  # no page to run on to
    df = spark.createDataFrame(scanned(pages), OCR)
    got = {}
    for r in scans.found(df).collect():
        got.setdefault((r["doc_id"], r["noise"]), set()).add((r["page"], r["line_num"], r["word_num"]))
    assert {p for p, _, _ in got[("d", "page_number")]} >= {1, 2, 4, 5, 6}
    assert ("e", "page_number") not in got
    assert (5, 4, 2) in got[("d", "hyphen")]
    assert "a matrícula que a testemunha" in " ".join(r["text"] for r in scans.paragraphs(df).where("doc_id = 'd'").collect())


def test_corrections(spark):
    v = spark.createDataFrame([("recibo", 500), ("rccibo", 2), ("autora", 90), ("autoro", 60), ("deterrninou", 1), ("determinou", 80), ("de", 900)], "word string, n bigint")
    got = {r["word"]: (r["meant"], r["sure"]) for r in scans.corrections(v).collect()}
    assert got["rccibo"] == ("recibo", True) and got["deterrninou"] == ("determinou", True) and "autoro" not in got


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_queries_run_on_small_tables(spark, small, name):
    df = llm.queries()[name](spark, small)
    assert df.count() > 0


def test_sql_of_text_queries(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("blocks", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in llm.oracle_sql().items():
        got, want = llm.queries()[name](spark, small).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values)), name

"""Problem 6: sentence boundaries in many languages and scripts.

Document-centred disambiguation.  Every paragraph is scanned once for places
where a sentence may end.  Places that are clear are settled at once; a full
stop after a possible abbreviation waits for evidence: what the same token
does where it is unambiguous elsewhere in its document, then in the corpus,
then the given table of abbreviations.  A token followed by small letters or
commas is an abbreviation; one that also ends texts can end sentences; one
that never ends a text although it is common can not.  Capitalised words seen
inside sentences, in the document or else in the corpus, count as names, which
keeps initials and names together.

Scripts have their own rules: ideographic and Indic stops, the Greek question
mark, Arabic stops, spaces between Thai clauses.  Quoted and bracketed text
never splits the sentence around it.

Defined results: null and blank texts have no sentence; equal rows count once;
null keys are keys like others, and two texts under one key are two texts;
offsets count code points from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut, lookup_join

FINAL_SHARE = 0.05
NEVER_FINAL_LEAST = 20

# Abbreviations of the languages at hand, kept for corpora too small to show them.
ABBREVIATIONS = """art arts fls fl inc cf doc docs sr sra srs dr dra exmo exma mm cia tel v eng téc tab p pág págs pp n no nº núm ex ej av avda r rod
mr mrs ms st vs e.g i.e etc ltd ltda abs bl ca vgl d.h z.b gem exp ref lic prof dña hon fig vol ed op cit jr ст стр напр т.е т.д ул г άρθρ σελ κ ص م""".split()
FINAL_CAPABLE = sorted("etc Ltda Ltd S.A S.L Co Inc Cía GmbH AG LTDA т.д".split())
UNITS = set("bloco block casa apto lote letra item flat unit suite piso planta ala torre puerta".split())
OPEN, CLOSE = "“„«「『‹", "”»」』›"
SEPARATE = "。！？।॥"


PAIRED = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "(": ")", '"': '"', "（": "）", "[": "]"}
TERMINAL = ".!?…؟" + SEPARATE
LETTERS_SHORT = 6  # longer tokens need most of their occurrences as evidence


def _scan():
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re as plain

        import regex as re

        word_back = re.compile(r"(?r)(?:(?:(?<![\p{L}\p{M}])\p{L}\.){1,4})?[\p{L}\p{M}\p{N}@²³º\-]+")
        last_word = re.compile(r"(?r)\S+")
        word_next = re.compile(r"[\p{L}\p{M}\p{N}]+")
        word = re.compile(r"(?<![\p{L}\p{M}.@])\p{Lu}[\p{L}\p{M}]+")
        greek, thai, has_thai = re.compile(r"\p{Greek}"), re.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})"), plain.compile("[\u0e00-\u0e7f]")
        opener, stop, ender = plain.compile(r'[“„«「『‹"(（\[]'), plain.compile(rf"[{TERMINAL}۔;]"), plain.compile(rf"[{TERMINAL}]+")
        dotted = re.compile(r"(?r)(?<![\p{L}\p{M}\p{N}.@])((?:\p{L}[\p{M}]*\.)*\p{L}[\p{L}\p{M}]*)")
        dot = plain.compile(r"\.(?![\wªº.])\s*")

        def guarded(text: str) -> tuple[bytearray, dict[int, int]]:
            """Marks what stands in quotes or brackets; where each quote closes. A bracket that does not close in its paragraph guards nothing."""
            inside, closes = bytearray(len(text)), {}
            n, at = len(text), 0
            while m := opener.search(text, at):
                i, c = m.start(), m[0]
                js = [j for e in PAIRED[c] if (j := text.find(e, i + 1)) >= 0]
                if js:
                    j = min(js)
                    if c in "([（" and "\n\n" in text[i:j]:
                        j = i
                elif c in OPEN:
                    j = text.find("\n", i)
                    j = n - 1 if j < 0 else j
                else:
                    j = i
                inside[i:j] = b"\1" * (j - i)
                closes[j] = i
                at = j + 1
            return inside, closes

        def places(text: str) -> list[tuple]:
            """(start, settled, token, before, next word, kind) of every place a sentence may start after."""
            out = []
            n = len(text)
            inside, closes = guarded(text)
            is_greek = ";" in text and bool(greek.search(text))
            first = n - len(text.lstrip())
            out.append((first, True, None, None, None, None))
            if has_thai.search(text):
                for m in thai.finditer(text):
                    if not inside[m.start()]:
                        out.append((m.end(), True, None, None, None, None))
            spots = {m.start() for m in stop.finditer(text)} | set(closes)
            done = 0
            for i in sorted(spots):
                if i < done:
                    continue
                c = text[i]
                if inside[i] or not (c in TERMINAL or c == "۔" or (c == ";" and is_greek and i and greek.match(text[i - 1])) or (i in closes and i and text[i - 1] in TERMINAL)):
                    if not (i in closes and i > 1 and text[i - 1] == " " and text[i - 2] in ".!?…"):
                        continue
                more = ender.match(text, i + 1)
                j = more.end() if more else i + 1
                done = j
                run = text[i:j]
                quoted = i in closes
                k = j
                while k < n and text[k].isspace():
                    k += 1
                if k >= n:
                    break
                nxt, gap = text[k], k > j
                if nxt in SEPARATE or nxt in CLOSE or nxt in ")],;:":
                    continue
                if run[-1] in SEPARATE or (quoted and text[i - 1] in SEPARATE):
                    if not quoted or "\n" in text[j:k]:
                        out.append((k, True, None, None, None, None))
                    continue
                caseless = nxt.isalpha() and not nxt.isupper() and not nxt.islower()
                kind = "D" if nxt.isdigit() else "U" if nxt.isupper() or caseless else "L" if nxt.islower() else "Q"
                if kind == "L" or (kind == "Q" and (nxt in "-–—/%°ªº²&=_" or not gap and nxt not in OPEN + "¿¡§") and not (nxt in "–—-" and "\n" in text[j:k])):
                    continue
                if not gap:
                    after = text[k + 1 : k + 2]
                    if kind == "D" or (kind == "U" and not (after.islower() or after.isspace() or caseless)):
                        continue
                if quoted or run != ".":
                    out.append((k, True, None, None, None, None))
                    continue
                back = word_back.match(text, 0, i)
                token = back[0].lstrip("-") if back else ""
                if not gap and kind == "U" and len(token) == 1 and token.isalpha():
                    continue
                if not token or token[-1].isdigit() or "@" in token or token[-1] in "²³º":
                    out.append((k, True, None, None, None, None))
                else:
                    pre = last_word.search(text, 0, i - len(token))
                    w = word_next.match(text, k)
                    out.append((k, False, token, pre[0].casefold() if pre else "", w[0] if w and len(token) == 1 else "", kind))
            return out

        def evidence(text: str, out: dict[str, list[int]]) -> None:
            """Adds to token -> [followed by small letter or comma, ends the text, other]; ^capitalised word -> [.., .., .., starts, inside]."""
            n = len(text)
            for m in dot.finditer(text):
                t = dotted.match(text, 0, m.start())
                if t is None:
                    continue
                e = out.setdefault(t[1], [0, 0, 0, 0, 0])
                nxt = text[m.end()] if m.end() < n else ""
                if not nxt:
                    e[1] += 1
                elif nxt.islower() or nxt in ",;:":
                    e[0] += 1
                elif nxt not in "”»“)」":
                    e[2] += 1
            for m in word.finditer(text):
                i, w = m.start(), m[0]
                before = text[max(0, i - 3) : i].rstrip(" ")
                if not before or before[-1] in "!?\n":
                    out.setdefault("^" + w, [0, 0, 0, 0, 0])[3] += 1
                elif before[-1].islower() or before[-1] == ",":
                    out.setdefault("^" + w, [0, 0, 0, 0, 0])[4] += 1

        for pdf in batches:
            found: list[tuple] = []
            seen: dict[str | None, dict[str, list[int]]] = {}
            for doc, block, tid, text in zip(pdf["doc_id"], pdf["block_id"], pdf["tid"], pdf["text"]):
                spots = places(text)
                found.append((False, doc, block, tid, [p[0] for p in spots if p[1]], None, None, None, None, None, 0, 0, 0, 0, 0))
                found += [(False, doc, block, tid, None, p[0], *p[2:], 0, 0, 0, 0, 0) for p in spots if not p[1]]
                evidence(text, seen.setdefault(doc, {}))
            found += [(True, doc, None, 0, None, None, t, None, None, None, *e) for doc, tokens in seen.items() for t, e in tokens.items()]
            yield pd.DataFrame(found, columns=SCANNED_COLUMNS)

    return scan


SCANNED = "evidence boolean, doc_id string, block_id string, tid bigint, settled array<int>, start_at int, token string, before string, next string, kind string, low int, fin int, cap int, starts int, mid int"
SCANNED_COLUMNS = [c.split(" ")[0] for c in SCANNED.split(", ")]
PLACE = ["doc_id", "block_id", "tid", "start_at"]


def _texts(paragraphs: DataFrame) -> DataFrame:
    """Distinct texts; tid tells texts of one key apart."""
    return paragraphs.where(F.col("text").rlike("(?U)\\S")).select("doc_id", "block_id", "text").distinct().withColumn("tid", F.xxhash64("text"))


def _starts(texts: DataFrame, abbreviations: DataFrame) -> DataFrame:
    scanned = cut(texts.mapInPandas(_scan(), SCANNED))
    places = scanned.where("not evidence")
    settled = places.where("settled is not null").select(*PLACE[:3], F.explode("settled").alias("start_at"))
    sums = [F.sum(c).alias(c) for c in ("low", "fin", "cap", "starts", "mid")]
    open_ = places.where("settled is null").select(*PLACE, "token", "before", "next", "kind")
    in_doc = cut(scanned.where("evidence").groupBy("doc_id", "token").agg(*sums))
    corpus = in_doc.groupBy("token").agg(*sums).withColumn("n", F.col("low") + F.col("fin") + F.col("cap") + F.col("starts") + F.col("mid"))
    # only tokens that are asked for are kept: the others are most of the corpus
    asked = open_.select("token").unionByName(open_.select(F.concat(F.lit("^"), "next").alias("token"))).distinct()
    corpus = cut(corpus.join(asked, "token", "left_semi"))
    listed = abbreviations.select(F.regexp_replace(F.regexp_replace(F.lower(F.col("abbrev")), "\\s", ""), "\\.$", "").alias("token")).where("token <> ''").withColumn("listed", F.lit(True)).distinct()

    of_token = in_doc.where("token not like '^%' and low + fin > 0").select(F.col("doc_id").alias("__d"), F.col("token").alias("__t"), F.col("low").alias("doc_low"), F.col("fin").alias("doc_fin"))
    open_ = open_.join(of_token, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("token") == F.col("__t")), "left").drop("__d", "__t").na.fill(0, ["doc_low", "doc_fin"])
    of_next = in_doc.where("token like '^%' and mid > 0").select(F.col("doc_id").alias("__d"), F.expr("substring(token, 2)").alias("__t"), F.col("starts").alias("doc_starts"), F.col("mid").alias("doc_mid"))
    open_ = open_.join(of_next, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("next") == F.col("__t")), "left").drop("__d", "__t").na.fill(0, ["doc_starts", "doc_mid"])
    open_ = cut(open_)  # a lookup reads its left side twice
    stats = corpus.where("token not like '^%'").select("token", "n", "low", "fin", "cap")
    open_ = lookup_join(open_, stats, "token", "n", "left").na.fill(0, ["low", "fin", "cap", "n"])
    open_ = cut(open_.withColumnRenamed("n", "n_token"))
    words = corpus.where("token like '^%'").select(F.expr("substring(token, 2)").alias("next"), "n", F.col("starts").alias("w_starts"), F.col("mid").alias("w_mid"))
    open_ = lookup_join(open_, words, "next", "n", "left").na.fill(0, ["w_starts", "w_mid"])
    open_ = open_.withColumn("__low", F.lower("token")).join(listed.withColumnRenamed("token", "__low"), "__low", "left")

    single = F.char_length("token") == 1
    long_ = F.char_length("token") > LETTERS_SHORT
    known = F.coalesce("listed", F.lit(False)) | F.lower("token").isin(ABBREVIATIONS)
    never_final = (F.col("fin") == 0) & (F.col("cap") >= NEVER_FINAL_LEAST) & (F.char_length("token") <= 5)
    mostly = (F.col("low") >= 2) & (F.col("low") * 2 > F.col("n_token"))  # long words end sentences; they need a majority
    abbreviation = known | F.when(long_, mostly).otherwise((F.col("doc_low") > 0) | (F.col("low") >= 2) | never_final) | F.col("token").isin(FINAL_CAPABLE)
    ends = F.col("fin") + F.col("cap")
    final = F.when(ends >= NEVER_FINAL_LEAST, F.col("fin") >= FINAL_SHARE * ends).otherwise(F.col("token").isin(FINAL_CAPABLE) | ((F.col("doc_fin") > 0) & ~known))
    unit = F.col("before").isin(sorted(UNITS)) | F.col("before").rlike("\\d\\.?[ºª]$")
    in_corpus = (F.col("w_starts") > 3 * F.col("w_mid")) & (F.col("w_starts") > 0)
    starter = F.when(F.col("doc_mid") > 0, F.col("doc_starts") > 3 * F.col("doc_mid")).otherwise(in_corpus)
    boundary = F.when(single, unit | ((F.col("kind") == "U") & starter & ~known)).when(abbreviation, final).otherwise(F.lit(True))
    return settled.unionByName(open_.where(boundary).select(*PLACE)).distinct()


def starts(paragraphs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(doc_id, block_id, start_at): one row per sentence of paragraphs (doc_id, block_id, text).

    abbreviations: (abbrev), a fixed table."""
    return _starts(_texts(paragraphs), abbreviations).drop("tid").distinct()


def sentences(paragraphs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(doc_id, block_id, sentence_no, start_at, end_at, sentence) in order, white space at the ends removed."""
    source = _texts(paragraphs)
    key = ["doc_id", "block_id", "tid"]
    found = _starts(source, abbreviations).groupBy(*key).agg(F.sort_array(F.collect_list("start_at")).alias("at")).select(*[F.col(c).alias(f"__{c}") for c in key], "at")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("block_id").eqNullSafe(F.col("__block_id")) & (F.col("tid") == F.col("__tid"))
    texts = source.join(found, same).drop(*[f"__{c}" for c in key])
    rows = texts.select("doc_id", "block_id", "text", F.posexplode("at").alias("sentence_no", "start_at"), "at")
    end = F.coalesce(F.get("at", F.col("sentence_no") + 1), F.char_length("text"))
    raw = F.substring("text", F.col("start_at") + 1, end - F.col("start_at"))
    trimmed = F.regexp_replace(raw, "(?U)\\s+$", "")
    return rows.select("doc_id", "block_id", "sentence_no", "start_at", (F.col("start_at") + F.char_length(trimmed)).alias("end_at"), trimmed.alias("sentence"))

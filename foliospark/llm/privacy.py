"""Problem 2: personal data in running text, found and replaced by typed placeholders.

Information-theoretic sanitisation.  Shapes only propose candidates; how
strongly a candidate reveals a person is estimated from co-occurrences over
the corpus, and candidates above the disclosure thresholds are generalised to
their placeholder.

* Names: a capitalised word counts as part of personal names when the known
  name parts stand beside it far more often than beside an average word
  (pointwise mutual information) and with many different partners (entropy).
* Numbers whose shape is not told apart (eleven digits in a row): the words
  before them and the place of a mobile digit are weighed by their log-odds
  among the phones and identity numbers of unmistakable shape.
* Every kind: what stands beside a candidate discloses nothing if it always
  holds the same few fillers, as with firms, places, streets, buildings and
  hot lines: the entropy of the fillers of that context is far below that of
  as many different people.

All statistics are grouped sums over the whole corpus; frequent words and
contexts are joined through a fixed-size broadcast, the others by shuffle.

Defined results: null and blank texts hold no items; equal rows count once;
null keys are keys like others, and two texts under one key are two texts; an
item inside a longer one (a name in an address or email) is not repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut, lookup_join

PMI_BITS = 1.0
BASE_AT_MOST = 0.125
PARTNER_BITS = 1.5
CONTEXT_BITS = 2.5
CONTEXT_SHARE = 0.5
CONTEXT_LEAST = 8

# Shapes of candidates.
EMAIL_AT = r"@|\s?\(at\)\s?|\s?\[at\]\s?|\s?\[arroba\]\s?|\s?\(arroba\)\s?"
EMAIL_LOCAL, EMAIL_DOMAIN = r"(?r)[\p{L}\d][\p{L}\d._%+\-]*", r"[\p{L}\d\-]+(?:\.[\p{L}\d\-]+)+"
PHONE = [
    r"\+\d{1,3}\s?\(\d{2,3}\)\s?\d{3,5}[\s.\-]?\d{4}",
    r"\+55\s\d{2}\s\d{4,5}[\s\-]?\d{4}",
    r"\+44\s\d{2,4}\s\d{3,4}\s\d{3,4}",
    r"\+\d{1,3}(?:[\s\-]\d{2,5}){2,4}",
    r"\(0xx\d{2}\)\s?\d{4,5}[\s.\-]?\d{4}",
    r"\(\d{2,3}\)\s?\d{3,5}[\s.\-]\d{4}",
    r"(?<![\d.,/\-])\d{2}[\s\-]9?\d{4}[\s.\-]\d{4}",
    r"(?<![\d.,/\-])\d{3}-\d{3}-\d{4}",
]
IDENTITY = [
    r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    r"\d{3}[ ]\d{3}[ ]\d{3}[ ]\d{2}",
    r"\d{3}\.\d{5}\.\d{2}-\d",
    r"\d{2}\.\d{3}\.\d{3}-[\dXx]",
    r"\d{3}-\d{2}-\d{4}",
    r"\d{2}-\d{4}-\d{3}",
    r"[A-Z]{2}\d{6,7}",
]
BARE = r"(?<![\d.,/\-\p{L}])\d{11}(?![\d/\-\p{L}]|[.,]\d)"
STREET_WORDS = r"(?:Rua|R\.|Avenida|Av\.|Avda\.|Praça|Pça\.|Travessa|Tv\.|Alameda|Al\.|Rod\.|Rodovia|Estrada|Estr\.|Largo|Calle|C/|Plaza|Pza\.|Paseo|Rue|Boulevard|Place)\s"
HOUSE_WORDS = r"Street|Road|Lane|Avenue|Row|Close|Square|Drive|Court|Place|Terrace|Way|Walk|Hill|Quay|St\.|Rd\.|Ave\."
STREET = "(?:" + STREET_WORDS + r"+(?:\p{Lu}|d[aeo]s?\s|de\s+l[ao]s?\s|del\s)[\p{L}.\s]+?(?:,|\s|,\s?)\s*(?:n\.?\s?[º°o]?\.?\s*)?\d{1,5}\b)"
HOUSE_FIRST = r"(?<![\d.,/\-])\d{1,5}\s(?:\p{Lu}[\p{Ll}’']+\s){1,3}(?:Street|Road|Lane|Avenue|Row|Close|Square|Drive|Court|Place|Terrace|Way|Walk|Hill|Quay|St\.|Rd\.|Ave\.)(?!\p{L})"
ADDRESS_TAIL = r"(?:,\s(?:fundos|casa\s\d+|apto\s\d+|bloco\s\w+|bajo|\d\.º\s\w|[Ff]lat\s\w+|[Uu]nit\s\w+)|,\s(?:Bairro|Vila)\s(?:\p{Lu}\p{L}+\s?)+|,\sCEP\s\d{5}-\d{3}|\s-\s\p{Lu}\p{L}+(?:\s\p{Lu}\p{L}+)*)*"
ELEMENT = r"(?:\p{Lu}\p{Ll}+(?:[’']\p{L}+)?(?![\p{L}\-])|\p{Lu}{2,}(?![\p{L}\-])|\p{Lu}\.(?=[\s.,;)]))"
NAME = rf"(?<![\p{{L}}\-@.]){ELEMENT}(?:\s+(?:(?:d[aeo]s?|D[AEO]S?|von|van|del|DEL|y|e la)\s+)?{ELEMENT})*(?:,\s{ELEMENT}(?:\s+(?:d[aeo]s?\s+)?{ELEMENT})*\s+\p{{Lu}}\.)?"


TOKEN = r"[\p{L}\p{M}]+|[^\s\p{L}\p{M}]"


def _extract():
    """mapInPandas function: (doc_id, block_id, tid, text) -> candidates of fixed shape and candidate name runs."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re as plain

        import regex as re

        at, local, domain = plain.compile(EMAIL_AT), re.compile(EMAIL_LOCAL), re.compile(EMAIL_DOMAIN)
        digits, long_digits = plain.compile(r"[0-9]"), plain.compile(r"[0-9(+][0-9\s().\-]{6,}[0-9Xx]|[A-Z]{2}[0-9]{6}|\(0xx")
        bare, has_street, has_house = re.compile(BARE), plain.compile(STREET_WORDS), plain.compile(HOUSE_WORDS)
        phone = re.compile("(?:" + "|".join(PHONE) + r")(?![\d]|[\-/]\d)")
        identity = re.compile(r"(?<![\p{L}\d.,/\-])(?:" + "|".join(IDENTITY) + r")(?![\d/]|[\-.]\d)")
        street, house = re.compile(STREET + ADDRESS_TAIL), re.compile(HOUSE_FIRST)
        name, element = re.compile(NAME), re.compile(ELEMENT)
        before2, after2 = re.compile(rf"(?r)(?:({TOKEN})\s*)?({TOKEN})\s*"), re.compile(rf"\s*({TOKEN})(?:\s*({TOKEN}))?")
        cue2 = re.compile(r"(?r)(?:([\p{L}\p{M}ºª°]+)[^\p{L}\p{M}ºª°\d\n]*)?([\p{L}\p{M}ºª°]+)[^\p{L}\p{M}ºª°\d\n]*")
        title = re.compile(r"(?r)(?:\b(?:Sr|Sra|Srta|Dr|Dra|Mr|Mrs|Ms|Mme|Exmo|Exma|Prof)\.?|D\.ª|Dña\.|Herrn?|Frau|M\.)\s+")

        def cues(text: str, start: int) -> tuple[str, str]:
            """Last word before start, and the last two."""
            m = cue2.match(text, 0, start)
            if m is None:
                return "", ""
            return m[2].casefold(), f"{(m[1] or '').casefold()} {m[2].casefold()}"

        def fixed(text: str) -> list[tuple[str, int, int]]:
            out: list[tuple[str, int, int]] = []

            def add(kind: str, p) -> None:
                for m in p.finditer(text):
                    a, b = m.start(), m.end()
                    if all(b <= x or a >= y for _, x, y in out):
                        out.append((kind, a, b))

            for m in at.finditer(text):
                before, after = local.match(text, 0, m.start()), domain.match(text, m.end())
                if before and after and all(after.end() <= x or before.start() >= y for _, x, y in out):
                    out.append(("email", before.start(), after.end()))
            if not digits.search(text):
                return out
            if has_street.search(text):
                add("address", street)
            if has_house.search(text):
                add("address", house)
            if long_digits.search(text):
                add("id_number", identity)
                add("phone", phone)
                add("number", bare)
            return out

        for pdf in batches:
            rows = []
            for doc, block, tid, text in zip(pdf["doc_id"], pdf["block_id"], pdf["tid"], pdf["text"]):
                items = fixed(text)
                for k, a, b in items:
                    one, two = cues(text, a)
                    value = text[a:b].casefold()
                    number = "".join(filter(str.isdigit, value)) if k in ("phone", "id_number", "number") else ""
                    rows.append((doc, block, tid, k, a, b, None, None, None, one, two, value, len(number) >= 11 and number[-9] == "9", False))
                for m in name.finditer(text):
                    start, end = m.start(), m.end()
                    if any(start < b and a < end for _, a, b in items):
                        continue
                    parts = [(e.start() + start, e.end() + start, e[0].casefold()) for e in element.finditer(m[0])]
                    j = start - 1
                    while j >= 0 and text[j].isspace():
                        j -= 1
                    opening = j < 0 or text[j] in ".!?…:“\"«•–-" or "\n" in text[max(0, start - 2) : start]
                    if len(parts) < 2:  # no name by itself, but it counts as a word beside or without a partner
                        titled = bool(opening and title.match(text, 0, start))
                        rows.append((doc, block, tid, "name", start, end, [parts[0][2]] if parts else [], None, None, "", "", None, opening and not titled, titled))
                        continue
                    titled = bool(title.match(text, 0, start))
                    left, right = before2.match(text, 0, start), after2.match(text, end)
                    left = " ".join(x.casefold() for x in left.groups() if x) if left else ""
                    right = " ".join(x.casefold() for x in right.groups() if x) if right else ""
                    rows.append((doc, block, tid, "name", start, end, [p[2] for p in parts], [p[0] for p in parts], [p[1] for p in parts], left, right, None, opening and not titled, titled))
            yield pd.DataFrame(rows, columns=EXTRACTED_COLUMNS)

    return extract


EXTRACTED = "doc_id string, block_id string, tid bigint, pii_kind string, start_at int, end_at int, words array<string>, starts array<int>, ends array<int>, left string, right string, value string, flag boolean, titled boolean"
EXTRACTED_COLUMNS = [c.split(" ")[0] for c in EXTRACTED.split(", ")]
ITEM = ["doc_id", "block_id", "tid", "start_at", "end_at"]


def _entropy(rows: DataFrame, key: str, filler: str) -> DataFrame:
    """(key, n, bits): occurrences of key and the entropy of what fills it."""
    pairs = rows.groupBy(key, filler).agg(F.count("*").alias("c"))
    return pairs.groupBy(key).agg(F.sum("c").alias("n"), (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("bits"))


def _dull(rows: DataFrame, key: str, filler: str) -> DataFrame:
    """(key, n): contexts that always hold the same few fillers and so disclose nobody."""
    stats = _entropy(rows, key, filler)
    return stats.where((F.col("n") >= CONTEXT_LEAST) & (F.col("bits") < F.least(F.lit(CONTEXT_BITS), CONTEXT_SHARE * F.log2("n")))).select(key, "n")


def name_words(runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(word, n): words that disclose a person, by co-occurrence with the known name parts.

    seeds: (word), a fixed table."""
    at = runs.select(F.col("flag").alias("opening"), F.posexplode("words").alias("i", "word"), "words").where("word not like '%.'")
    near = F.array_compact(F.array(F.when(F.col("i") > 0, F.get("words", F.col("i") - 1)), F.get("words", F.col("i") + 1)))
    pairs = at.select("word", (F.col("opening") & (F.col("i") == 0)).alias("first"), F.explode_outer(near).alias("partner"))
    pairs = pairs.join(seeds.select(F.col("word").alias("partner"), F.lit(True).alias("seed")).distinct(), "partner", "left")
    pairs = pairs.groupBy("word", F.when(F.col("seed"), F.col("partner")).alias("partner")).agg(F.count("*").alias("c"), F.count_if(~F.col("first")).alias("inside"))
    known = F.col("partner").isNotNull()
    k = F.sum(F.when(known, F.col("c")).otherwise(0))
    bits = F.log2(k) - F.sum(F.when(known, F.col("c") * F.log2("c")).otherwise(0.0)) / k
    counts = cut(pairs.groupBy("word").agg(F.sum("c").alias("n"), k.alias("k"), F.sum("inside").alias("inside"), F.when(k > 0, bits).alias("bits")))
    base = counts.agg((F.sum("k") / F.sum("n")).alias("base")).first()["base"]  # one number
    bound = F.lit(min(base or BASE_AT_MOST, BASE_AT_MOST))
    learned = counts.where((F.col("k") > 1) & (F.log2((F.col("k") / F.col("n")) / bound) >= PMI_BITS) & (F.col("bits") >= PARTNER_BITS) & (F.col("inside") * 10 > F.col("n")))
    return learned.select("word", "n").unionByName(seeds.select("word").join(counts.select("word", "n"), "word")).groupBy("word").agg(F.max("n").alias("n"))


def _row_key() -> Column:
    """Never null, one value for each text of each key."""
    part = lambda c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(c, F.lit("")))
    return F.concat_ws("\x1f", part("doc_id"), part("block_id"), F.hex("tid"), F.col("start_at"))


def names(runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """ITEM rows of personal names among the candidate runs."""
    known = cut(name_words(runs, seeds))
    several = runs.where(F.size("words") >= 2).withColumn("rid", _row_key())
    words = several.select("rid", F.posexplode("words").alias("i", "word")).where("word not like '%.'")
    hits = lookup_join(words, known, "word", "n").groupBy("rid").agg(F.collect_set("i").alias("hits"))
    marks = F.array_join(F.transform("words", lambda w, i: F.when(w.like("%."), "i").when(F.array_contains("hits", i), "f").otherwise("-")), "")
    marked = several.join(hits, "rid").withColumn("marks", marks)
    island = lambda i: F.regexp_extract(F.substring("marks", i + 1, F.length("marks")), "^[fi]+", 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.substring("marks", i + 1, F.lit(1)) != "-") & ((i == 0) | (F.substring("marks", i, F.lit(1)) == "-")))
    ranges = F.filter(F.transform(begins, lambda i: F.struct(i.alias("a"), (i + F.length(island(i)) - 1).alias("b"), island(i).contains("f").alias("full"))), lambda r: (r["b"] > r["a"]) & r["full"])
    run = marked.select("*", F.explode(ranges).alias("r")).select(
        "doc_id", "block_id", "tid", F.get("starts", "r.a").alias("start_at"), F.get("ends", "r.b").alias("end_at"), (F.col("titled") & (F.col("r.a") == 0)).alias("titled"),
        F.array_join(F.slice("words", F.col("r.a") + 1, F.col("r.b") - F.col("r.a") + 1), " ").alias("filler"),
        F.when(F.col("r.a") > 0, F.get("words", F.col("r.a") - 1)).otherwise(F.col("left")).alias("left"),
        F.when(F.col("r.b") + 1 < F.size("words"), F.get("words", F.col("r.b") + 1)).otherwise(F.col("right")).alias("right"),
    )
    run = cut(run)
    for side in ("left", "right"):
        dull = cut(_dull(run, side, "filler").withColumnRenamed("n", f"dull_{side}"))
        run = cut(lookup_join(run, dull, side, f"dull_{side}", "left"))  # a lookup reads its left side twice
    return run.where(F.col("titled") | (F.col("dull_left").isNull() & F.col("dull_right").isNull())).select(*ITEM)


def told_apart(fixed: DataFrame) -> DataFrame:
    """fixed with pii_kind number resolved to phone or id_number by log-odds of its context among the unmistakable ones."""
    sure = fixed.where("pii_kind in ('phone', 'id_number')")
    phone, number = F.count_if(F.col("pii_kind") == "phone"), F.count_if(F.col("pii_kind") == "id_number")
    odds = lambda a, b: F.log2((a + 0.5) / (b + 0.5))
    total = sure.agg(phone.alias("p"), number.alias("i"), F.count_if((F.col("pii_kind") == "phone") & F.col("flag")).alias("pf"), F.count_if((F.col("pii_kind") == "id_number") & F.col("flag")).alias("if")).first()  # one row
    yes = log2((total["pf"] + 0.5) / (total["p"] + 1)) - log2((total["if"] + 0.5) / (total["i"] + 1))
    no = log2((total["p"] - total["pf"] + 0.5) / (total["p"] + 1)) - log2((total["i"] - total["if"] + 0.5) / (total["i"] + 1))
    prior = log2((total["p"] + 0.5) / (total["i"] + 0.5))
    score = F.when(F.col("flag"), yes).otherwise(no) + prior
    open_ = fixed.where("pii_kind = 'number'")
    for side in ("left", "right"):  # the last word, and the last two
        stats = cut(sure.where(F.col(side) != "").groupBy(side).agg((odds(phone, number) - prior).alias(f"odds_{side}"), F.count("*").alias(f"n_{side}")))
        open_ = lookup_join(open_, stats, side, f"n_{side}", "left").drop(f"n_{side}")
        score = score + F.coalesce(f"odds_{side}", F.lit(0.0))
    judged = open_.withColumn("pii_kind", F.when(score > 0, "phone").otherwise("id_number")).select(fixed.columns)
    return fixed.where("pii_kind <> 'number'").unionByName(judged)


def _items(texts: DataFrame, name_parts: DataFrame) -> DataFrame:
    found = cut(texts.mapInPandas(_extract(), EXTRACTED))
    seeds = name_parts.select(F.lower("part_text").alias("word")).where("word is not null").distinct()
    fixed = cut(told_apart(found.where("pii_kind <> 'name'").select(*ITEM, "pii_kind", "left", "right", "value", "flag")).withColumn("context", F.concat_ws(" ", "pii_kind", "right")))
    dull = cut(_dull(fixed, "context", "value").withColumnRenamed("n", "dull"))
    fixed = lookup_join(fixed, dull, "context", "dull", "left").where("dull is null").select(*ITEM, "pii_kind")
    return fixed.unionByName(names(found.where("pii_kind = 'name'"), seeds).withColumn("pii_kind", F.lit("name")))


def _texts(blocks: DataFrame) -> DataFrame:
    """Distinct texts that may hold an item; tid tells texts of one key apart."""
    held = blocks.where(F.col("text").rlike("[\\p{Lu}\\p{Lt}\\p{Nd}@]|\\(at\\)|arroba"))
    return held.select("doc_id", "block_id", "text").distinct().withColumn("tid", F.xxhash64("text")).select("doc_id", "block_id", "tid", "text")


def items(blocks: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(doc_id, block_id, pii_kind, start_at, end_at) of blocks (doc_id, block_id, text); offsets in code points."""
    return _items(_texts(blocks), name_parts).select("doc_id", "block_id", "pii_kind", "start_at", "end_at").distinct()


def redact(blocks: DataFrame, name_parts: DataFrame) -> DataFrame:
    """blocks with text where every item is replaced by its placeholder, such as [NAME]; other columns unchanged."""
    spans = _items(_texts(blocks), name_parts).groupBy("doc_id", "block_id", "tid").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "pii_kind"))).alias("__items"))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("block_id").alias("__b"), F.col("tid").alias("__t"), "__items")
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start_at"] - acc["at"]), F.lit("["), F.upper(x["pii_kind"]), F.lit("]")).alias("out"), x["end_at"].alias("at")
    )
    done = F.aggregate("__items", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    joined = blocks.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("block_id").eqNullSafe(F.col("__b")) & (F.xxhash64("text") == F.col("__t")), "left")
    return joined.withColumn("text", F.when(F.col("__items").isNull() | F.col("text").isNull(), F.col("text")).otherwise(done)).select(blocks.columns)

"""Problem 3: noise in text recognised from scanned pages, and continuous paragraphs without it.

* Running headers and footers: lines at the page edge that recur, digits
  masked, on pages of their file (or at the edges of several files); a
  misread copy is found by its edit distance to a recurring line of the file.
* Page numbers: number phrases on edge lines whose numbers run on over the
  pages of the file.  Where a file has no neighbouring page to run on to, only
  an unmistakable phrase counts (a label, dashes, brackets, a line of its own).
* Cut words: a line's last word is joined with the next line's first, also
  over the end of a page, when the corpus vocabulary knows the joined word, and
  kept apart when it knows the hyphenated one (compounds) or the parts are
  numbers.
* Misread words: impossible shapes (signs, repeated letters or changing case
  inside a word, digits among letters and the reverse), and rare words one
  typical confusion away from a far more frequent word of the corpus.
* Specks: tokens of signs only whose kind is read with low confidence over
  the corpus, or closing signs that close nothing.

The words of a page are brought together once; everything within lines and
pages is done in two passes over these rows.  Only facts meet over the corpus:
edge lines of a file, words, pairs of adjacent words.  Corpus counts leave out
cut words, headers and page numbers.

Defined results: null and blank words are no noise; equal rows count once; a
word in several kinds is reported once, in the order header, page_number,
speck, hyphen, misread; unknown page heights count as A4.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.runtime import cut, lookup_join

DPI = 300.0
A4_POINTS = 842.0
BAND = 0.08
FILES_LEAST = 3
NEAR = 0.2
RATIO = 5
SURE_RATIO = 20
KNOWN = 4
SPECK_CONF = 60.0
PAGE = ["doc_id", "page"]
LINE = [*PAGE, "block_num", "par_num", "line_num"]
WORD = [*LINE, "word_num"]
SEP = "\x1f"

# What recognition takes for what (seen, meant).
CONFUSIONS = """o a|a o|v u|u v|b h|h b|l i|i l|f t|t f|c e|e c|cl d|d cl|rn m|m rn|f e|y v|v y|n u|u n|0 o|1 l|1 i|5 s|8 b|9 g|6 b|q g|g q|c o|o c|g ç|c ç|ç c|é e|e é|í i|i í|ó o|o ó|ã a|a ã|á a|a á|nn m|m nn|ii u|vv w|w vv|l t|t l|l 1|â ã|ã â|ri n|n ri|6 é|in m|m in|j i|i j|s 5|z 2|k h|h k|r n|n r|rn n|lı h|li h|h li|p n|D O|O D"""
SKIP = r"@|\(at\)|\[arroba\]|://|=[0-9]"
CUT_SIGNS = "-–¬="
LABELS = ["fls", "folha", "pag", "pagina", "p", "page", "pp", "seite", "hoja", "feuille"]


def _pages(words: DataFrame, pages: DataFrame | None) -> DataFrame:
    """One row per page: toks in reading order and the page height in pixels."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    tok = F.struct("block_num", "par_num", "line_num", "word_num", F.coalesce("text", F.lit("")).alias("text"), zero("left_px").alias("left"), (zero("left_px") + zero("width_px")).alias("right"), F.coalesce("conf", F.lit(-1.0)).alias("conf"), F.col("top_px").alias("top"))
    rows = words.select(*PAGE, tok.alias("tok")).groupBy(*PAGE).agg(F.sort_array(F.collect_list("tok")).alias("toks"))
    if pages is None:
        return cut(rows.withColumn("height", F.lit(A4_POINTS * DPI / 72)))
    heights = pages.where("height > 0").groupBy(*PAGE).agg((F.max("height") * DPI / 72).alias("height"))
    return cut(rows.join(heights, PAGE, "left").na.fill(A4_POINTS * DPI / 72, ["height"]))


TOK = ["block_num", "par_num", "line_num", "word_num", "text", "left", "right", "conf", "top"]
Tok = tuple  # in the order of TOK
B, P, L, N, TEXT, LEFT, RIGHT, CONF, TOP = range(9)


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _read(batch: pa.RecordBatch, names: list[str] = TOK) -> Iterator[tuple[dict[str, Any], list[list[Tok]]]]:
    """(other columns, lines of distinct tokens) of every page of a batch; names: the fields of a token that are needed, in the order of TOK."""
    toks = batch.column("toks")
    flat = toks.flatten()
    every = list(zip(*(_values(flat.field(c)) for c in names)))
    other = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "toks"}
    at = 0
    for i, n in enumerate(toks.value_lengths().to_pylist()):
        lines: list[list[Tok]] = []
        last, key = None, None
        for t in every[at : at + n]:
            if t == last:
                continue
            if t[:3] != key:
                line: list[Tok] = []
                lines.append(line)
                key = t[:3]
            line.append(t)
            last = t
        at += n
        yield {c: v[i] for c, v in other.items()}, lines


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in spec.split(", ")])


EDGE = "kind string, doc_id string, page int, block_num int, par_num int, line_num int, slot int, norm string, head array<int>, number array<int>, value int, sure boolean, word_num int, sign string, conf double"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> edge lines (page-number words, the rest as a masked line) and tokens of signs only."""
    import unicodedata

    import regex as re

    schema = _arrow(EDGE)
    folded = str.maketrans("01l|5869vytfhecaoumn", "oiiisbbguvftbccoounn")
    look = str.maketrans("0O1Il|5S8B69", "ooiiiissbbgg")
    digit = str.maketrans("OolIiSsBZz", "0011155822")
    number = re.compile(r"[\[(]?[\dOolISsBZz^~'.]{1,6}(?:/[\dOolISsBZz^~'.]{1,6})?[\])]?\.?$")
    word, letters2, repeated = re.compile(r"[\p{L}\p{N}]"), re.compile(r"\p{L}{2}"), re.compile(r"(.)\1{2,}")
    marks, masks, plain = re.compile(r"\p{M}|[^\p{L}\d|]"), re.compile(r"[\dOolIS]+"), re.compile(r"[^\p{L}\d]")

    @lru_cache(maxsize=100_000)
    def skeleton(t: str) -> str:
        """What is left of a word when typical misreadings are folded together."""
        if not letters2.search(t):
            return masks.sub("#", t)
        t = marks.sub("", unicodedata.normalize("NFD", t.lower()))
        t = repeated.sub(r"\1", t.replace("cl", "d").replace("rn", "m").replace("ri", "n"))
        return t.translate(folded)

    def is_number(t: str) -> bool:
        return bool(number.fullmatch(t)) and (any(c.isdigit() for c in t) or all(c in "OolISsBZz[]()/" for c in t) and len(t) > 1)

    @lru_cache(maxsize=100_000)
    def label(t: str) -> str:
        t = plain.sub("", t).lower().translate(look)
        t = repeated.sub(r"\1", t)
        for x in LABELS:
            y = x.translate(look)
            if t == y or t == y.replace("á", "a") or t.replace("á", "a") == y:
                return x
            if len(y) > 2 and abs(len(t) - len(y)) <= 1 and sum(a != b for a, b in zip(t.replace("á", "a"), y)) + abs(len(t) - len(y)) <= 1:
                return x
        return ""

    def suffix(toks: list[Tok]) -> tuple[int, int, bool]:
        """(index of the first word of the page number at the end of the line, index of its number, whether the phrase is unmistakable)."""
        n = len(toks)
        t = [x[TEXT] for x in toks]
        if n >= 4 and is_number(t[-1]) and is_number(t[-3]) and len(t[-2]) <= 4 and label(t[-4]):
            return n - 4, n - 3, True
        if n >= 3 and t[-1] in "-–—" and t[-3] in "-–—" and is_number(t[-2]):
            return n - 3, n - 2, True
        if n >= 2 and is_number(t[-1]) and label(t[-2]):
            return n - 2, n - 1, True
        bare = n >= 2 and len(t[-1]) <= 4 and any(c.isdigit() for c in t[-1]) and not t[-1].endswith(".") and t[-2].lower() not in ("nº", "n.", "no.", "de")
        if n >= 1 and is_number(t[-1]) and (n == 1 or t[-1][0] in "[(" or bare or toks[-1][LEFT] - toks[-2][RIGHT] > 80):
            return n - 1, n - 1, n == 1 or t[-1][0] in "[("
        return n, n, False

    def value(t: str) -> int:
        t = plain.sub("", t.split("/")[0]).translate(digit)
        return int(t) if t.isascii() and t.isdigit() else -1

    for batch in batches:
        rows = []
        for page, lines in _read(batch):
            height = page["height"]
            for line in lines:
                tops = [t[TOP] for t in line if t[TOP] is not None]
                toks = [t for t in line if t[TEXT].strip()]
                at = len(toks)
                key = (page["doc_id"], page["page"], *line[0][:3])
                if tops and ((top := min(tops)) < BAND * height or top > (1 - BAND) * height):
                    at, where, sure = suffix(toks)
                    norm = " ".join(skeleton(t[TEXT]) for t in toks[:at])
                    rows.append(("edge", *key, top // 40, norm, [t[N] for t in toks[:at]], [t[N] for t in toks[at:]], value(toks[where][TEXT]) if at < len(toks) else -1, sure, None, None, None))
                rows += [("sign", *key, None, None, None, None, None, None, t[N], t[TEXT], t[CONF]) for t in toks[:at] if not word.search(t[TEXT])]
        yield _batch(rows, schema)


def _marks(edges: DataFrame) -> DataFrame:
    """(LINE, nums, noise): headers, page numbers and specks by kind, one row per line and noise."""
    edge = edges.where("kind = 'edge'")
    heads = edge.where(F.size("head") > 0)
    per_file = heads.groupBy("doc_id", "norm").agg(F.countDistinct("page").alias("pages"))
    anchors = per_file.where("pages >= 2").select("doc_id", "norm")
    common = per_file.groupBy("norm").agg(F.count("*").alias("files")).where(F.col("files") >= FILES_LEAST)
    sure = heads.join(anchors, ["doc_id", "norm"], "left_semi")
    other = heads.join(anchors, ["doc_id", "norm"], "left_anti")
    shared = lookup_join(other, common, "norm", "files").drop("files")
    anchor_slots = sure.select("doc_id", "slot", F.col("norm").alias("anchor")).distinct()
    close = F.levenshtein("norm", "anchor") <= F.greatest(F.lit(1), F.floor(NEAR * F.length("anchor")))
    forms = other.select("doc_id", "norm", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot")).distinct()
    like = forms.join(anchor_slots, ["doc_id", "slot"]).where(close).select("doc_id", "norm").distinct()
    near = other.join(like, ["doc_id", "norm"], "left_semi")
    headers = cut(sure.select(*LINE, "head").unionByName(shared.select(*LINE, "head")).unionByName(near.select(*LINE, "head")).distinct())

    # numbers that run on: the distance between number and page is the same on several pages of the file
    counted = edge.where(F.size("number") > 0).withColumn("off", F.when(F.col("value") >= 0, F.col("value") - F.col("page")))
    runs = counted.where("off is not null").groupBy("doc_id", "off").agg(F.countDistinct("page").alias("run")).where("run >= 2")
    numbered = counted.join(runs, ["doc_id", "off"], "left").join(headers.select(*LINE, F.lit(True).alias("after_header")), LINE, "left")
    numbers = numbered.where(F.col("sure") | F.col("run").isNotNull() | F.coalesce("after_header", F.lit(False))).select(*LINE, F.col("number").alias("nums"), F.lit("page_number").alias("noise"))

    signs = edges.where("kind = 'sign'").select(*WORD, "sign", "conf")
    kinds = signs.where("conf >= 0").groupBy("sign").agg(F.count("*").alias("n"), F.avg("conf").alias("mean")).where((F.col("mean") < SPECK_CONF) & (F.col("sign") != "»"))
    specks = lookup_join(signs, kinds, "sign", "n").groupBy(*LINE).agg(F.collect_set("word_num").alias("nums")).withColumn("noise", F.lit("speck"))
    return headers.select(*LINE, F.col("head").alias("nums"), F.lit("header").alias("noise")).unionByName(numbers).unionByName(specks)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) -> (word, n, meant): words one typical confusion away."""
    pairs = [tuple(x.split(" ")) for x in CONFUSIONS.split("|")]
    for pdf in batches:
        rows = []
        for w, n in zip(pdf["word"], pdf["n"]):
            out = set()
            for seen, meant in pairs:
                i = w.find(seen)
                while i >= 0:
                    out.add(w[:i] + meant + w[i + len(seen) :])
                    i = w.find(seen, i + 1)
            for i, c in enumerate(w):  # a sign read into the word
                if not c.isalnum() and c != "-" and 0 < i < len(w) - 1:
                    out.add(w[:i] + w[i + 1 :])
            if any(c.isdigit() for c in w):
                for table in (("0156899", "olsbggq"), ("01", "oi")):
                    out.add(w.translate(str.maketrans(*table)))
            out.discard(w)
            rows += [(w, int(n), c) for c in out]
        yield pd.DataFrame(rows, columns=["word", "n", "meant"])


def corrections(vocabulary: DataFrame) -> DataFrame:
    """(word, n, meant): words of the vocabulary (word, n) one confusion away from a far more frequent one; several rows a word."""
    rare = vocabulary.where(F.col("word").rlike("\\p{L}") & (F.char_length("word") >= 3) & ~F.col("word").rlike("[ªº]"))
    tried = rare.mapInPandas(_candidates, "word string, n bigint, meant string")
    known = vocabulary.where(F.col("n") >= KNOWN).select(F.col("word").alias("meant"), F.col("n").alias("m"))
    hits = tried.join(known, "meant").where(F.col("m") >= RATIO * F.col("n"))
    gender = F.regexp_replace("word", "[aoãâ]s?$", "") == F.regexp_replace("meant", "[aoãâ]s?$", "")
    sure = (F.char_length("word") >= 6) & (F.col("m") >= SURE_RATIO * F.col("n")) & ~gender
    return hits.select("word", "n", "meant", "m", sure.alias("sure"))



FACT = "kind string, doc_id string, page int, block_num int, par_num int, line_num int, word_num int, word string, before string, after string, sign string, next_block int, next_par int, next_line int, next_word int"


def _shapes():
    """Function: whether a word has a shape that no correct text has."""
    import regex as re

    c = re.compile
    skip, url = c(SKIP), c(r"://")
    many, crosses, alnum = c(r"([\p{L}\-,;:()“”%$])\1{3,}"), c(r"^[xX]+\W*$|://|=[0-9]"), c(r"[\p{L}\p{N}]")
    turn = c(r"\p{Ll}\p{Lu}")
    digit, latin, letter = c("[0-9]"), c("[A-Za-z]"), c(r"\p{L}")
    codes = c(r"[²³]|^\(?0xx|^\W*\p{Lu}{2}[0-9]{5,}\W*$")
    numeric, closing = c(r"^[^A-Za-z]*(?:[OolISsBZzg][^A-Za-z]*)+$"), c(r"[.)”]\p{Lu}$")
    lettered = c(r"\p{L}[0156899]\p{L}|\p{L}{2}[0156899]\W*$|^\W*[0156899]\p{L}{3}")
    runs, amounts, lone = c(r"([0-9])\1{3,}"), c(r"^\W*[0-9.]+,[0-9]|[0-9][ºª%]|^[0-9]+/[0-9]+/[0-9]+"), c(r"^[OlIS],[0-9]+\W*$")

    @lru_cache(maxsize=200_000)
    def misread(t: str) -> bool:
        if t.isalpha() and (t.islower() or t.istitle() or t.isupper()):  # nearly all words
            return bool(many.search(t))
        if ("^" in t or "~" in t) and len(t) > 1 and alnum.search(t) and not url.search(t):
            return True
        if many.search(t) and alnum.search(t) and not crosses.search(t):
            return True
        skipped = bool(skip.search(t))
        turns = len(turn.findall(t))
        if turns and (not skipped or turns > 2):
            return True
        if skipped:
            return False
        d, a = len(digit.findall(t)), len(latin.findall(t))
        if d and a and not codes.search(t):
            if numeric.search(t) and d > a and not closing.search(t):
                return True
            if d == 1 and "ª" not in t and "º" not in t and lettered.search(t) and len(letter.findall(t)) >= 2:
                return True
        return bool((runs.search(t) and amounts.search(t)) or lone.search(t))

    return misread


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with marks -> t tokens with their neighbours, e words cut at line ends, f first words of pages, x words known to be noise."""
    import regex as re

    schema, misread = _arrow(FACT), _shapes()
    skip, trim = re.compile(SKIP), re.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
    odd, nothing = re.compile(r"[\^~']"), (None,) * 5

    @lru_cache(maxsize=200_000)
    def core(t: str) -> str:
        return t.lower() if t.isalnum() else trim.sub("", t).lower()

    def cut_off(t: str) -> bool:
        return t[-1] in CUT_SIGNS and t[-2:-1].isalpha()

    @lru_cache(maxsize=200_000)
    def skipped(t: str) -> bool:
        return bool(skip.search(t))

    for batch in batches:
        rows: list[tuple] = []
        for page, lines in _read(batch, TOK[:5]):
            doc, number = page["doc_id"], page["page"]
            body, closing = _body(lines, page["marks"])
            rows += [("x", doc, number, *t[:4], None, None, None, "speck", None, None, None, None) for t in closing]
            if body:
                rows.append(("f", doc, number, *body[0][0][:4], body[0][0][TEXT], None, None, None, None, None, None, None))
            for i, toks in enumerate(body):
                first, last = toks[0], toks[-1]
                nxt = body[i + 1][0] if i + 1 < len(body) else None
                ended = cut_off(last[TEXT]) and (nxt is None or nxt[TEXT][0].isalpha())
                continued = i > 0 and cut_off(body[i - 1][-1][TEXT]) and first[TEXT][0].isalpha()
                cores = [core(t[TEXT]) for t in toks]
                around = ["", *cores, ""]
                for j in range(int(continued), len(toks) - int(ended)):
                    if cores[j] and not skipped(toks[j][TEXT]):
                        rows.append(("t", doc, number, *toks[j][:4], cores[j], around[j], around[j + 2], *nothing))
                rows += [("x", doc, number, *t[:4], None, None, None, "misread", None, None, None, None) for t in toks if misread(t[TEXT])]
                if ended:
                    left = odd.sub("", core(last[TEXT][:-1]))
                    rows.append(("e", doc, number, *last[:4], left, None, nxt[TEXT] if nxt else None, last[TEXT][-1], *(nxt[:4] if nxt else (None, None, None, None))))
        yield _batch(rows, schema)


def _body(lines: list[list[Tok]], marks: list | None) -> tuple[list[list[Tok]], list[Tok]]:
    """(lines without marked and blank words, closing signs that close nothing); empty lines are left out."""
    gone = {(m["block_num"], m["par_num"], m["line_num"], n) for m in marks or () for n in m["nums"]}
    body, closing, opened = [], [], 0
    for line in lines:
        toks = []
        for t in line:
            if t[:4] in gone or not t[TEXT].strip():
                continue
            if t[TEXT] == "»" and opened <= 0:
                closing.append(t)
                continue
            opened += t[TEXT].count("«") - t[TEXT].count("»")
            toks.append(t)
        if toks:
            body.append(toks)
    return body, closing


def _with_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    per_page = marks.groupBy(*PAGE).agg(F.collect_list(F.struct(*LINE[2:], "nums", "noise")).alias("marks"))
    return pages.join(per_page, PAGE, "left")


def confirmed(suspects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Suspects (WORD, before, word, after, meant, sure) whose neighbours go with what was meant far more often than with the word.

    pairs: (key, c) counts of adjacent words over the corpus; key is both words around SEP."""
    asked = [("before", "meant"), ("before", "word"), ("meant", "after"), ("word", "after")]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when((F.col(a) != "") & (F.col(b) != ""), F.concat_ws(SEP, a, b)).otherwise("").alias("key")) for i, (a, b) in enumerate(asked)]))
    rows = lookup_join(suspects.withColumn("q", each).select(*suspects.columns, "q.i", "q.key"), pairs, "key", "c", "left")
    counts = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("c"))), F.lit(0)).alias(f"c{i}") for i in range(4)]
    out = rows.groupBy(*WORD, "before", "word", "after", "meant", "sure").agg(*counts)
    fits = lambda good, bad: (F.col(good) >= 2) & (F.col(good) >= RATIO * F.col(bad))
    alone = (F.col("before") == "") & (F.col("after") == "")
    return out.where(F.col("sure") | fits("c0", "c1") | fits("c2", "c3") | alone)


def analyse(words: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(noise (WORD, noise, meant), the rows of all pages)."""
    whole = _pages(words, pages)
    edges = cut(whole.mapInArrow(_edges, EDGE))
    marks = cut(_marks(edges))
    facts = cut(_with_marks(whole, marks).mapInArrow(_facts, FACT))
    tokens = facts.where("kind = 't'").select(*WORD, "before", "word", "after")
    vocabulary = cut(tokens.groupBy("word").agg(F.count("*").alias("n")))

    # a word cut at the end of a page goes on with the first word of the next
    firsts = facts.where("kind = 'f'").select("doc_id", (F.col("page") - 1).alias("page"), F.struct("block_num", "par_num", "line_num", "word_num", "word").alias("f"))
    ends = facts.where("kind = 'e'").join(firsts, PAGE, "left")
    following = F.when(F.col("next_word").isNull() & F.col("f.word").rlike("^\\p{Ll}"), F.struct((F.col("page") + 1).alias("page"), F.col("f.block_num"), F.col("f.par_num"), F.col("f.line_num"), F.col("f.word_num"), F.col("f.word").alias("text")))
    following = following.otherwise(F.struct("page", F.col("next_block").alias("block_num"), F.col("next_par").alias("par_num"), F.col("next_line").alias("line_num"), F.col("next_word").alias("word_num"), F.col("after").alias("text")))
    right = F.lower(F.regexp_replace(F.coalesce("nx.text", F.lit("")), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    ends = ends.withColumn("nx", following).withColumn("right", right).select(*WORD, F.col("word").alias("left"), F.concat("word", "right").alias("joined"), F.concat("word", F.lit("-"), "right").alias("hyphenated"), "sign", "nx")
    ends = cut(ends)

    # one row per word: its count, the count of compounds it begins, the likeliest word it is a misreading of
    every = vocabulary.unionByName(ends.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    wrong = cut(corrections(every))
    none = F.lit(None).cast("struct<n:bigint,m:bigint,meant:string>")
    stems = vocabulary.where(F.col("word").contains("-")).select(F.substring_index("word", "-", 1).alias("word"), F.lit(0).cast("long").alias("n"), F.col("n").alias("n_stem"), none.alias("best"))
    meant = wrong.select("word", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_stem"), F.struct("n", "m", "meant").alias("best"))
    known = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_stem"), none.alias("best")).unionByName(stems).unionByName(meant)
    known = cut(known.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_stem").alias("n_stem"), F.max_by("best.meant", F.struct("best.m", "best.meant")).alias("meant")).withColumn("weight", F.col("n") + F.col("n_stem")))
    asked = ends.select(*ends.columns, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("word")) for k in ("joined", "hyphenated", "left")])).alias("q")).select(*ends.columns, "q.k", "q.word")
    got = lookup_join(asked, known, "word", "weight", "left")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    judged = cut(got.groupBy(*ends.columns).agg(*[F.coalesce(of(k, c), F.lit(0)).alias(f"{k}_{c}") for k, c in (("joined", "n"), ("hyphenated", "n"), ("left", "n"), ("left", "n_stem"))], of("joined", "meant").alias("joined_meant")))
    known_whole = (F.col("joined_n") > 0) | (F.col("hyphenated_n") > 0)
    is_cut = F.when(known_whole, F.col("joined_n") >= F.col("hyphenated_n")).otherwise(F.col("sign").isin("¬", "=", "–") | (F.col("left_n_stem") <= F.col("left_n") / 20) | (F.col("left_n_stem") == 0))
    hyphens = judged.where(is_cut & ~((F.col("sign") == "-") & F.coalesce(F.col("nx.text").rlike("@|arroba"), F.lit(False))))

    bad = wrong.groupBy("word").agg(F.max("n").alias("n"), F.collect_set(F.struct("meant", "sure")).alias("meants"))
    suspects = cut(lookup_join(tokens, bad, "word", "n").select(*WORD, "before", "word", "after", F.inline("meants")))
    pairs = tokens.where("before <> ''").groupBy(F.concat_ws(SEP, "before", "word").alias("key")).agg(F.count("*").alias("c")).where("c >= 1")
    by_vocabulary = confirmed(suspects, cut(pairs)).select(*WORD, "meant")
    second = judged.where("joined_meant is not null and nx.word_num is not null and substring(joined, 1, length(left)) = substring(joined_meant, 1, length(left))")
    second = second.select("doc_id", "nx.page", "nx.block_num", "nx.par_num", "nx.line_num", "nx.word_num", F.expr("substring(joined_meant, length(left) + 1)").alias("meant"))
    null = F.lit(None).cast("string")
    noises = [
        marks.select(*LINE, F.explode("nums").alias("word_num"), "noise", null.alias("meant")),
        facts.where("kind = 'x'").select(*WORD, F.col("sign").alias("noise"), null.alias("meant")),
        hyphens.select(*WORD, F.lit("hyphen").alias("noise"), null.alias("meant")),
        by_vocabulary.unionByName(second).select(*WORD, F.lit("misread").alias("noise"), "meant"),
    ]
    all_ = noises[0].unionByName(noises[1]).unionByName(noises[2]).unionByName(noises[3])
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(["header", "page_number", "speck", "hyphen", "misread"]) for x in (F.lit(k), F.lit(i))]), F.col("noise"))
    return all_.groupBy(*WORD).agg(F.min_by("noise", rank).alias("noise"), F.max("meant").alias("meant")), whole


def found(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(WORD, noise) of every noisy word."""
    return analyse(words, pages)[0].drop("meant")


PARAGRAPH = "doc_id string, page int, block_num int, par_num int, text string"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with all noise -> their paragraphs; a cut at the end of a paragraph stays marked."""
    import regex as re

    schema = _arrow(PARAGRAPH)
    inside, stray = re.compile(r"[\p{L}\p{N}].*[\p{L}\p{N}]", re.S), re.compile(r"(?<=[\p{L}\p{N}])[\^~](?=[\p{L}\p{N}])")
    joint, compound = re.compile("\x01\\s?(?=.)", re.S), re.compile(r"(?<=\p{L}-)\s(?=\p{Ll})")

    def cased(meant: str, seen: str) -> str:
        """meant in the case of what was seen."""
        if sum(c.isupper() for c in seen) > sum(c.islower() for c in seen):
            return meant.upper()
        return meant[:1].upper() + meant[1:] if seen[0].isupper() else meant

    for batch in batches:
        rows = []
        for page, lines in _read(batch, TOK[:5]):
            noise = {(m["block_num"], m["par_num"], m["line_num"], m["word_num"]): (m["noise"], m["meant"]) for m in page["marks"] or ()}
            paragraphs: dict[tuple, list[str]] = {}
            for line in lines:
                out = []
                for t in line:
                    kind, meant = noise.get(t[:4], (None, None))
                    text = t[TEXT]
                    if kind in ("header", "page_number", "speck") or not text.strip():
                        continue
                    if kind == "misread" and meant is not None:
                        m = inside.search(text)
                        text = text[: m.start()] + cased(meant, m[0]) + text[m.end() :] if m else text
                    else:
                        text = stray.sub("", text)
                    out.append(text[:-1] + "\x01" if kind == "hyphen" else text)
                if out:
                    paragraphs.setdefault(line[0][:2], []).append(" ".join(out))
            rows += [(page["doc_id"], page["page"], *key, compound.sub("", joint.sub("", " ".join(parts)))) for key, parts in paragraphs.items()]
        yield _batch(rows, schema)


def paragraphs(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, block_num, par_num, text): paragraphs without noise, cut words joined, misreadings mended.

    A paragraph that goes on at the top of the next page takes that page's first paragraph with it, over any number of pages."""
    noise, whole = analyse(words, pages)
    per_page = noise.groupBy(*PAGE).agg(F.collect_list(F.struct(*WORD[2:], "noise", "meant")).alias("marks"))
    per = whole.drop("height").join(per_page, PAGE, "left").mapInArrow(_write, PARAGRAPH)
    w = Window.partitionBy("doc_id", "page")
    order = F.struct("block_num", "par_num")
    per = cut(per.withColumn("is_first", order == F.min(order).over(w)).withColumn("is_last", order == F.max(order).over(w)))
    first_ = per.where(F.col("is_first") & F.col("text").rlike("^\\p{Ll}")).select("doc_id", (F.col("page") - 1).alias("page"), F.col("text").alias("tail"), F.col("is_last").alias("only"))
    open_ = per.where(F.col("is_last") & ~F.col("text").rlike("[.!?…:;]['\"”»)]*$")).select(*LINE[:4])
    links = cut(open_.join(first_, ["doc_id", "page"]))
    # a continuation that fills its page and stays open carries on: one chain, one paragraph
    pages_ = Window.partitionBy("doc_id").orderBy("page")
    joined = F.coalesce((F.lag("page").over(pages_) == F.col("page") - 1) & F.lag("only").over(pages_), F.lit(False))
    chain = links.withColumn("chain", F.sum((~joined).cast("int")).over(pages_))
    whole = chain.groupBy("doc_id", "chain").agg(F.min_by(F.struct(*LINE[1:4]), "page").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "tail"))), lambda x: x["tail"]), " ").alias("tail"))
    whole = whole.select("doc_id", "head.*", "tail")
    moved = links.select("doc_id", (F.col("page") + 1).alias("page")).withColumn("is_first", F.lit(True))
    kept = per.join(moved, ["doc_id", "page", "is_first"], "left_anti")
    text = F.regexp_replace(F.concat_ws(" ", "text", "tail"), "\u0001\\s?(?=.)", "")
    return kept.join(whole, LINE[:4], "left").select(*LINE[:4], F.regexp_replace(text, "\u0001$", "-").alias("text"))

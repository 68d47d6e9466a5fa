"""Problem 10: per-document text statistics, and which documents are not prose.

Per language the mean and covariance of prose are estimated robustly: starting
from documents of plain shape, documents far from the current estimate are
left out and the estimate is made again, until it no longer moves
(concentration steps).  A document's distance from the prose of its language
is its Mahalanobis distance over all statistics; the part each statistic has
in the squared distance is reported, and the parts say what kind of outlier it
is: list, table or junk.  An outlier counts as a list or table only if most of
its text is.

The statistics of a text are taken in one pass over Arrow batches: characters
by a histogram, tokens by their remembered shape, lines one by one.  Native
higher-order functions run the same tests interpreted for every token and cost
six times as much.

Languages are whatever the rows say (two-letter codes); missing ones are
guessed from script and frequent words.  A language without a list of frequent
words is not measured by their share.  Statistics of short texts are noisy, so
each is drawn towards the language's mean by PRIOR_WORDS words; languages with
few documents lean on all languages together by PRIOR_DOCS documents.

Defined results: null, empty and blank texts have 0 words, null distances and
class prose; equal texts get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut, spread

FEATURES = ["common_share", "wordlike_share", "symbol_share", "punct_line_share", "log_word_len", "distinct_share", "list_share", "table_share"]
PRIOR_WORDS = 12.0
PRIOR_DOCS = 30.0
RIDGE = 4e-4
SETTLED = 1e-3
KEEP_BELOW = 20.0
OUTLIER_ABOVE = 45.0

# Shapes of lines and words; white space is ASCII, digits are ASCII.
S_ = " \\t\\n\\x0b\\f\\r"
MARKER = rf"[{S_}]*(?:[-*+•–·◦▪‣]|\(?[0-9]{{1,3}}[.)]|\(?\p{{L}}[.)]|\(?[ivxIVX]{{1,5}}[.)])[{S_}]+[^{S_}]"
INNER_STOP = rf"[.!?…]['\"”»)]*[{S_}]+\p{{Lu}}|[。！？।]."
END = rf"[.!?…。！？।؟;:]['\"”“»)」』\]]*[{S_}]*$"
STOP = rf"[.!?…。！？।؟](?=['\"”“»)」』{S_}]|$)"
CLOSED = rf"[.!?…。！？।؟]['\"”»)]*[{S_}]*$"
SENTENCE_END = rf"[!?…]['\"”»)]*[{S_}]*$|\p{{L}}{{2}}\.['\"”»)]*[{S_}]*$"
ABBREVIATED = rf"[{S_}]*\(?[A-Za-z0-9_]{{1,4}}\.[{S_}]"
WORD = r"[(\[\"“”«„¿¡'‘>#*_]*[\p{L}\p{M}]++(?:[-’'./]?[\p{L}\p{M}]++)*+[.ºª]?[.,;:!?)\]\"”»…'’*_]*$"
NUMBER = r"[(\[+§$€£R*_]*[0-9][0-9.,/:%ºª°²()\-–x]*[.,;:!?)\]\"”»…*_]*$|[§$€£&–—=|#>*%_\-]+$|R\$$|[\p{L}0-9._+\-]+@[\p{L}0-9.\-]+$|\p{L}?m²[.,;]?$|[A-Z]{1,3}[0-9]{4,}[.,;)]*$"
ODD = r"\p{Ll}\p{Lu}|�|\p{L}[0-9]|[0-9]\p{L}"
VOWEL = "[aeiouyAEIOUYàáâãäåæèéêëìíîïòóôõöøùúûüýÿœàáâãäèéêëìíîïòóôõöùúûüąęėįųūāēīőűăıůÀÁÂÃÄÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ]"
PLAIN_SIGNS = set(".,;:!?…()'\"“”‘’«»„¿¡。、，！？：；「」।؟-–—%ºª²°§$€£/>#*@\u200d\ufe0f")
HEAVY_SIGNS = set("§$€£/>#*@%")
DENSE_SIGNS = set("。、，！？「」“”：0123456789")
DENSE = ("zh", "ja", "th")
SCRIPTS = [("th", r"\p{Thai}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"), ("ru", r"\p{Cyrillic}"), ("el", r"\p{Greek}")]

MEASURED = "lang_group string, listed_language boolean, word_count int, mean_word_len double, line_count int, symbol_share double, punct_line_share double, common_share double, wordlike_share double, log_word_len double, distinct_share double, list_share double, table_share double, evidence double"
NAMES = [c.split(" ")[0] for c in MEASURED.split(", ")]


class Meter:
    """Statistics of one text after another; built once per Python worker."""

    def __init__(self, common: dict[str, list[str]]) -> None:
        import regex

        self.common = {g: frozenset(ws) for g, ws in common.items()}
        self.preferred = {g: i for i, g in enumerate(("pt", "es", "en", "fr", "de"))}
        c = regex.compile
        self.word, self.number, self.good, self.odd, self.vowel, self.latin3 = c(r"(?:\p{L}\p{M}*)+"), c(NUMBER), c(WORD), c(ODD), c(VOWEL), c("[a-zA-Z]{3}")
        self.lines, self.end, self.stop, self.closed, self.inner = c(r"\r\n|\r|\n"), c(END), c(STOP), c(CLOSED), c(INNER_STOP)
        self.marker, self.sentence_end, self.abbreviated = c(MARKER), c(SENTENCE_END), c(ABBREVIATED)
        self.semi, self.gap = c(rf";(?=[^{S_}])|;$"), c(rf"[^{S_}] {{3,}}(?=[^{S_}])")
        self.scripts = [(g, c(p)) for g, p in SCRIPTS]
        self.letter = c(r"[\p{L}\p{M}\p{N}\U0001F000-\U0001FAFF☀-➿]")
        self.dense = c(r"[\p{L}\p{M}]")
        self.tokens: dict[str, int] = {}
        self.chars: dict[str, tuple[int, int, int, int, str]] = {}

    def char(self, ch: str) -> tuple[int, int, int, int, str]:
        """(is no space, is a symbol, is a heavy sign, is writing without spaces, script)."""
        black = not ch.isspace()
        symbol = ch not in " \t\n\x0b\f\r" and ch not in PLAIN_SIGNS and not self.letter.match(ch)
        script = next((g for g, p in self.scripts if p.match(ch)), "")
        out = self.chars[ch] = (int(black), int(symbol), int(ch in HEAVY_SIGNS), int(ch in DENSE_SIGNS or bool(self.dense.match(ch))), script)
        return out

    def token(self, t: str) -> int:
        """0 number or sign, 1 word-like, 2 neither."""
        if self.number.match(t):
            k = 0
        else:
            k = 1 if len(t) <= 40 and self.good.match(t) and not self.odd.search(t) and (not self.latin3.search(t) or self.vowel.search(t)) else 2
        if len(self.tokens) > 400_000:  # a memory of seen tokens, no limit of the result
            self.tokens.clear()
        self.tokens[t] = k
        return k

    def guess(self, n_chars: int, scripts: dict[str, int], words: list[str]) -> str:
        for g, _ in SCRIPTS:
            if scripts.get(g, 0) * 3 > n_chars:
                return g
        seen = Counter(words)
        hits = [(sum(n for w, n in seen.items() if w in ws), -self.preferred.get(g, 99), g) for g, ws in self.common.items() if g not in dict(SCRIPTS)]
        best = max(hits, default=(0, 0, ""))
        return best[2] if best[0] else "xx"

    def measure(self, text: str, given: str) -> tuple:
        black = symbols = heavy = writing = 0
        scripts: dict[str, int] = {}
        known = self.chars
        for ch, n in Counter(text).items():
            b, s, h, d, script = known.get(ch) or self.char(ch)
            black += b * n
            symbols += s * n
            heavy += h * n
            writing += d * n
            if script:
                scripts[script] = scripts.get(script, 0) + n
        words = self.word.findall(text.lower())
        n_words, word_chars = len(words), sum(map(len, words))
        lang = given if len(given) == 2 and given.isascii() and given.isalpha() and given not in ("un", "xx") else self.guess(len(text), scripts, words)
        dense = lang in DENSE
        listed_language = lang in self.common
        common = self.common.get(lang, frozenset())
        own = sum(w in common for w in words) if common else 0
        tokens = text.split()
        shapes = self.tokens
        plain = good = 0
        for t in tokens:
            k = shapes.get(t)
            if k is None:
                k = self.token(t)
            if k:
                plain += 1
                good += k == 1
        if dense:
            wordlike = writing / black if black else 0.0
        else:
            wordlike = good / plain if plain else 1.0
        lines = [x for x in self.lines.split(text) if x.strip(" \t\n\x0b\f\r")]
        lens = [len(x) for x in lines]
        total, n_lines = float(sum(lens)), len(lines)
        table = max(self.regular(lines, lens, f) for f in (self.pipes, self.tabs, self.semis, self.gaps)) / total if total else 0.0
        flowing = (len(self.stop.findall(text)) - sum(self.abbreviated.match(x) is not None for x in lines)) * 60 > n_words
        loose = not flowing and not dense and n_lines >= 3
        listed = sum(n for x, n in zip(lines, lens) if self.item(x, n, loose))
        punct = sum(self.end.search(x) is not None for x in lines)
        mean = word_chars / n_words if n_words else None
        distinct = 1.0 if dense or not n_words else min(1.0, len(set(words)) / min(n_words, 25))
        symbol_share = (symbols + max(0.0, heavy - black / 25)) / black if black else 0.0
        return (
            lang, listed_language, n_words, mean, n_lines, symbol_share, punct / n_lines if n_lines else 0.0, own / n_words if n_words else 0.0,
            wordlike, float(np.log(mean)) if mean else 0.0, distinct, listed / total if total else 0.0, table, black / 3 if dense else float(max(n_words, len(tokens))),
        )

    def item(self, x: str, n: int, loose: bool) -> bool:
        marked = n < 140 and self.marker.match(x) and not self.inner.search(x) and not self.sentence_end.search(x)
        return bool(marked) or (loose and n < 85 and not self.closed.search(x) and not self.inner.search(x))

    @staticmethod
    def pipes(x: str) -> int:
        return x.count("|")

    @staticmethod
    def tabs(x: str) -> int:
        return x.count("\t")

    def semis(self, x: str) -> int:
        return len(self.semi.findall(x)) if ";" in x else 0

    def gaps(self, x: str) -> int:
        return len(self.gap.findall(x)) if "   " in x else 0

    @staticmethod
    def regular(lines: list[str], lens: list[int], count) -> int:
        """Characters in lines with the usual number of one separator."""
        if len(lines) < 2:
            return 0
        per = [count(x) for x in lines]
        mid = sorted(per)[len(per) // 2]
        return sum(n for c, n in zip(per, lens) if c == mid) if mid else 0


def statistics(docs: DataFrame, common: dict[str, list[str]], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_group, word_count, mean_word_len, symbol_share, punct_line_share, common_share and further statistics) of every row."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = Meter(common)
        for pdf in batches:
            rows = pd.DataFrame([meter.measure(t, g) for t, g in zip(pdf["__t"], pdf["__g"])], columns=NAMES)
            rows.insert(0, key, pdf[key].values)
            yield rows

    given = F.lower(F.substring(F.coalesce(F.col(lang), F.lit("")), 1, 2))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__t"), given.alias("__g"))
    return rows.mapInPandas(measured, f"{key} {docs.schema[key].dataType.simpleString()}, {MEASURED}")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("double"), lambda a, x: a + x)


def _moments(stats: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """lang_group -> (documents, mean, covariance); one row per language reaches the driver."""
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j]
    rows = stats.groupBy("lang_group").agg(F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *cross).collect()
    k, out = len(FEATURES), {}
    for r in rows:
        n = float(r["n"])
        mean = np.array([r[f"s{i}"] for i in range(k)]) / n
        second = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
        out[r["lang_group"]] = (n, mean, second - np.outer(mean, mean))
    return out


Estimate = dict[str, tuple[np.ndarray, np.ndarray]]


def _estimate(sample: DataFrame, groups: list[str]) -> Estimate:
    """lang_group -> (mean, inverse covariance), leaning on all languages where documents are few."""
    moments = _moments(sample)
    total = sum(n for n, _, _ in moments.values()) or 1.0
    k = len(FEATURES)
    pooled = sum((n * c for n, _, c in moments.values()), np.zeros((k, k))) / total
    centre = sum((n * m for n, m, _ in moments.values()), np.zeros(k)) / total
    out: Estimate = {}
    for g in groups:
        n, mean, cov = moments.get(g, (0.0, centre, pooled))
        spread = 0.0
        if n < 5:  # a mean of a few documents says little
            mean, spread = centre, float(g != "xx")
        mixed = (n * cov + PRIOR_DOCS * pooled) / (n + PRIOR_DOCS) + np.eye(k) * (RIDGE + spread * 0.02)
        out[g] = (mean, np.linalg.inv(mixed))
    return out


def _distance(stats: DataFrame, est: Estimate) -> DataFrame:
    """stats with d2 and parts (array of contributions in the order of FEATURES)."""
    k = len(FEATURES)
    rows = [(g, m.tolist(), v.ravel().tolist()) for g, (m, v) in est.items()]
    params = stats.sparkSession.createDataFrame(rows, "lang_group string, __m array<double>, __v array<double>")
    # the evidence of a short text is small: its deviation is drawn towards 0
    weight = F.col("evidence") / (F.col("evidence") + PRIOR_WORDS)
    joined = stats.join(F.broadcast(params), "lang_group")  # one row per two-letter code
    parts = [F.when(F.col("listed_language"), F.col(f) - F.get("__m", F.lit(i))).otherwise(0.0) if f == "common_share" else F.col(f) - F.get("__m", F.lit(i)) for i, f in enumerate(FEATURES)]
    dev = joined.withColumn("__d", F.array(*[p * weight for p in parts]))
    row = lambda i: _total(F.zip_with(F.slice("__v", i * k + 1, F.lit(k)), "__d", lambda a, b: a * b))
    return dev.withColumn("parts", F.transform("__d", lambda x, i: x * row(i))).withColumn("d2", _total(F.col("parts"))).drop("__m", "__v", "__d")


def report(docs: DataFrame, common: dict[str, list[str]], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, statistics, distance, contribution of each statistic, doc_class) of every row of docs."""
    docs = spread(docs.select(key, text, lang), key)
    stats = cut(statistics(docs, common, key, text, lang))
    prose = stats.where("evidence >= 5 and list_share < 0.3 and table_share < 0.3 and wordlike_share > 0.8 and symbol_share < 0.1 and distinct_share > 0.4")
    groups = [r["lang_group"] for r in stats.select("lang_group").distinct().collect()]  # at most one per two-letter code
    est = _estimate(prose, groups)
    while True:
        new = _estimate(_distance(prose, est).where(F.col("d2") < KEEP_BELOW), groups)
        moved = max((float(np.abs(new[g][0] - est[g][0]).max()) for g in groups), default=0.0)
        est = new
        if moved < SETTLED:
            break
    if not groups:
        est = _estimate(prose, ["xx"])
    far = _distance(stats, est)
    part = {f: F.get("parts", F.lit(i)) for i, f in enumerate(FEATURES)}
    blank = F.col("evidence") == 0
    noise = part["wordlike_share"] + part["symbol_share"] + part["common_share"] + part["distinct_share"] + part["log_word_len"]
    table = (part["table_share"] >= F.greatest(part["list_share"], F.lit(1.0))) & (F.col("table_share") > 0.5)
    listed = (part["list_share"] > 1.0) & (F.col("list_share") > 0.5) & (F.col("distinct_share") > 0.3)
    unlike = (F.col("wordlike_share") < 0.5) | (F.col("symbol_share") > 0.3) | (F.col("distinct_share") < 0.45) | ((F.col("common_share") == 0) & F.col("listed_language"))
    kind = F.when(blank | (F.col("d2") <= OUTLIER_ABOVE), "prose").when(table, "table").when(listed & ~(F.col("wordlike_share") < 0.5), "list").when((noise > OUTLIER_ABOVE / 3) & unlike & (F.col("evidence") >= 5), "junk").otherwise("prose")
    return far.select(
        F.col(key), "lang_group", "word_count", "mean_word_len", "line_count", *[f for f in FEATURES if f != "log_word_len"],
        F.when(~blank, F.sqrt(F.greatest("d2", F.lit(0.0)))).alias("distance"), *[F.when(~blank, part[f]).alias(f"from_{f}") for f in FEATURES], kind.alias("doc_class"),
    )


def common_by_language(common_words: DataFrame) -> dict[str, list[str]]:
    """language -> frequent words; a fixed table."""
    rows = common_words.where("lang is not null and word is not null").select(F.lower(F.substring("lang", 1, 2)).alias("g"), F.lower("word").alias("w")).distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["g"], []).append(r["w"])
    return out

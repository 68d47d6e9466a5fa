"""Problem 1: one consistent form for text that only looks the same.

Look-alike relations between strings and code points (width and font
variants, ligatures, composed and decomposed accents, letters shared by
Latin, Cyrillic and Greek, spaces, undrawn characters) are closed
transitively by union-find.  The representative of a class is its most
frequent plain member in the corpus, per script of the surrounding word.
Rows are rewritten greedily, leftmost-longest, by a multi-pattern automaton;
only rows holding a candidate character ever reach Python.

Rules of the rewrite
* a letter shared by several scripts follows the other letters of its word;
  a word of nothing but shared letters follows its page;
* the wide marks of CJK writing stay in CJK text;
* undrawn characters go; every space becomes the plain one.

Defined results: null text stays null, empty text stays empty, duplicate
rows give one result per key (``found``) or keep their copies (``normalize``).
Extra columns pass through ``normalize`` untouched.
"""

from __future__ import annotations

import sys
import unicodedata as U
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut

# Letters of two scripts that are drawn alike (Latin, other).
SHARED = {
    "CYRILLIC": "aа eе oо pр cс yу xх iі jј sѕ AА BВ EЕ KК MМ HН OО PР CС TТ XХ IІ JЈ SЅ",
    "GREEK": "oο AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ",
}
# Signs drawn alike without a Unicode decomposition that says so.
SIGNS = [(".", "․"), (":", "꞉"), ("!", "ǃ"), ("-", "‐"), ("-", "‑"), ("/", "⁄"), ("/", "∕"), (":", "∶"), (" ", " ")]
# Undrawn characters outside category Cf, and drawn ones inside it.
UNDRAWN = "͏ᅟᅠ឴឵ㅤﾠ"
DRAWN_CF = set("؀؁؂؃؄؅۝܏࢐࢑࣢")
CJK_MARKS = "，：！？"
MARKS = ("̀", "ͯ")


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)


def script(ch: str) -> str | None:
    name = U.name(ch, "")
    return next((s for s in ("LATIN", "CYRILLIC", "GREEK") if name.startswith((s, "FULLWIDTH " + s))), None)


def _undrawn(ch: str) -> bool:
    cp = ord(ch)
    kind = U.category(ch)
    return (kind == "Cf" and ch not in DRAWN_CF) or (kind == "Cc" and ch not in "\t\n\r") or ch in UNDRAWN or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


@lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """root -> members. Its size is fixed by Unicode, whatever the corpus."""
    uf = UnionFind()
    for cp in [*range(0x20, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        if _undrawn(ch):
            uf.join("", ch)
            continue
        decomposition = U.decomposition(ch)
        if not decomposition:
            continue
        tag = decomposition.split(" ")[0] if decomposition[0] == "<" else ""
        folded = U.normalize("NFKC", ch)
        if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>"):
            uf.join(folded, ch)
        elif tag == "<compat>" and (U.category(ch) == "Zs" or (U.category(ch) == "Nl" and folded.isascii()) or (U.category(ch)[0] == "L" and folded.isalpha() and "LIGATURE" in U.name(ch, ""))):
            uf.join(folded, ch)
        elif not tag and " " not in decomposition:
            uf.join(U.normalize("NFC", ch), ch)
        elif not tag and MARKS[0] <= U.normalize("NFD", ch)[-1] <= MARKS[1]:
            uf.join(U.normalize("NFC", ch), U.normalize("NFD", ch))
            base, mark = (chr(int(x, 16)) for x in decomposition.split(" "))
            uf.join(U.normalize("NFC", ch), base + mark)
    for a, b in SIGNS:
        uf.join(a, b)
    for pairs in SHARED.values():
        for pair in pairs.split(" "):
            uf.join(pair[0], pair[1])
    out = defaultdict(list)
    for x in list(uf.parent):
        out[uf.find(x)].append(x)
    return {r: sorted(m) for r, m in out.items()}


def _plain(member: str) -> bool:
    """Neither a compatibility variant nor split into letter and accent."""
    return U.normalize("NFC", member) == member and not any(U.decomposition(c).startswith("<") or U.category(c) == "Cf" for c in member) and (len(member) < 2 or not any(MARKS[0] <= c <= MARKS[1] for c in member))


def representatives(counts: dict[str, int]) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Fixed rewrites, and rewrites that depend on the script of the word (script -> member -> form)."""
    fixed: dict[str, str] = {}
    by_script: dict[str, dict[str, str]] = {s: {} for s in ("LATIN", "CYRILLIC", "GREEK")}
    for members in classes().values():
        if "" in members:
            fixed.update({m: "" for m in members if m})
            continue
        weight = lambda m: (not _plain(m), -min((counts.get(c, 0) for c in m), default=0), len(m), m)
        best: dict[str | None, str] = {}
        for m in sorted(members, key=weight):
            best.setdefault(script(m[0]) if m[0].isalpha() else None, m)
        scripts = [s for s in best if s]
        if len(scripts) < 2:
            top = min(members, key=weight)
            fixed.update({m: top for m in members if m != top})
            continue
        for s in by_script:
            for m in members:
                own = script(m[0])
                form = best.get(s) or best[own]
                if form != m:
                    by_script[s][m] = form
    return fixed, by_script


def _char_class(chars: set[str]) -> str:
    """Java character class of the given characters as ranges."""
    cps, out, i = sorted(map(ord, chars)), [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:X}}}" + (f"-\\x{{{cps[j]:X}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def _codepoints() -> set[str]:
    return {c for m in classes().values() for x in m for c in x}


@lru_cache(maxsize=1)
def candidate_pattern() -> str:
    """Regex of every character that may have to change: members that are not plain, and letters shared by scripts."""
    chars = {m[-1] if len(m) > 1 else m for ms in classes().values() for m in ms if m and not (_plain(m) and len(m) == 1)}
    chars |= {m for ms in classes().values() if "" in ms for m in ms if m}
    chars = {c for c in chars if ord(c) > 126 or ord(c) < 32}
    chars |= {p[1] for pairs in SHARED.values() for p in pairs.split(" ")} | {b for _, b in SIGNS}
    return _char_class(chars)


def corpus_counts(*texts: DataFrame) -> dict[str, int]:
    """Occurrences of class members over the whole corpus; at most one row per member reaches the driver."""
    known = sorted(_codepoints())
    spark = texts[0].sparkSession
    members = spark.createDataFrame([(c,) for c in known], "ch string")
    union = texts[0]
    for t in texts[1:]:
        union = union.unionByName(t)
    distinct = union.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    chars = distinct.select("n", F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.sum("n").alias("n"))
    return {r["ch"]: int(r["n"]) for r in chars.join(F.broadcast(members), "ch").collect()}  # the class table is bounded by Unicode


class Rewriter:
    """Greedy leftmost-longest rewriting; built once per Python worker."""

    def __init__(self, fixed: dict[str, str], by_script: dict[str, dict[str, str]]) -> None:
        import ahocorasick
        import regex

        self.fixed, self.by_script = fixed, by_script
        self.shared = set().union(*by_script.values())
        self.auto = ahocorasick.Automaton()
        for m in {*fixed, *self.shared}:
            self.auto.add_word(m, m)
        self.auto.make_automaton()
        self.word = regex.compile(r"[\p{L}\p{M}\p{Cf}]+")
        self.cjk = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー。、「」『』]")
        self.seen: dict[str, tuple[str, str]] = {}

    def hosts(self, text: str, ambiguous: str | None) -> list[tuple[int, int, str]]:
        """(start, end, script) of every word."""
        out = []
        for m in self.word.finditer(text):
            own: dict[str, int] = defaultdict(int)
            all_: dict[str, int] = defaultdict(int)
            for c in m[0]:
                if s := script(c):
                    all_[s] += 1
                    if c not in self.shared:
                        own[s] += 1
            if own:
                host = max(own, key=lambda s: (own[s], s == "LATIN"))
            elif len(all_) == 1 and "LATIN" not in all_ and ambiguous is None:
                host = next(iter(all_))
            else:
                host = "LATIN"
            out.append((m.start(), m.end(), host))
        return out

    def rewrite(self, text: str, ambiguous: str | None = "LATIN") -> str:
        hosts, h = self.hosts(text, ambiguous), 0
        cjk = bool(self.cjk.search(text)) or ambiguous is None
        best: dict[int, str] = {}
        for end, m in self.auto.iter(text):
            start = end - len(m) + 1
            if len(m) > len(best.get(start, "")):
                best[start] = m
        out, at = [], 0
        for start in sorted(best):
            if start < at:
                continue
            m = best[start]
            while h < len(hosts) and hosts[h][1] <= start:
                h += 1
            if m in self.shared:
                host = hosts[h][2] if h < len(hosts) and hosts[h][0] <= start else "LATIN"
                form = self.by_script[host].get(m, m)
            elif cjk and m in CJK_MARKS:
                form = m
            else:
                form = self.fixed[m]
            out += [text[at:start], form]
            at = start + len(m)
        return "".join(out) + text[at:]

    def settle(self, text: str, ambiguous: str | None) -> str:
        """Rewriting may bring a letter and its accent together: repeat until nothing changes."""
        for _ in range(4):
            new = self.rewrite(text, ambiguous)
            if new == text:
                break
            text = new
        return text

    def both(self, text: str) -> tuple[str, str]:
        """Form where undecided words are Latin, and where they keep their script."""
        if text not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[text] = (self.settle(text, "LATIN"), self.settle(text, None))
        return self.seen[text]


def _forms(fixed: dict[str, str], by_script: dict[str, dict[str, str]]):
    @F.pandas_udf("latin string, native string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Rewriter(fixed, by_script)
        for s in batches:
            yield pd.DataFrame([r.both(t) for t in s], columns=["latin", "native"])

    return forms.asNondeterministic()  # else the optimizer evaluates it once per use


def page_scripts(texts: DataFrame) -> DataFrame:
    """(doc_id, page, foreign): whether the page is written in a script other than Latin.

    Latin text takes about one byte a character, Greek and Cyrillic two, CJK three: no need to look at characters."""
    text = F.when(F.char_length("text") > 3, F.col("text"))  # short words may be nothing but shared letters
    ratio = F.sum(F.octet_length(text)) > 1.5 * F.sum(F.char_length(text))
    return texts.groupBy("doc_id", "page").agg(ratio.alias("foreign"))


def touched() -> Column:
    """Whether text holds a candidate character: cheap tests first, most rows are plain."""
    text = F.col("text")
    wide = (F.octet_length(text) > F.char_length(text)) & text.rlike("[^\\x20-\\x7E\\xA1-\\xAC\\xAE-\\xFF]") & text.rlike(candidate_pattern())
    return F.coalesce(wide | text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"), F.lit(False))


def forms(rows: DataFrame, counts: dict[str, int], pages: DataFrame) -> DataFrame:
    """rows (doc_id, page, text, ...) holding a candidate character, with column __form."""
    fixed, by_script = representatives(counts)
    held = cut(rows.where(touched()).withColumn("__f", _forms(fixed, by_script)(F.col("text"))))
    same = held.where("__f.latin = __f.native").withColumn("__form", F.col("__f.latin")).drop("__f")
    other = held.where("__f.latin <> __f.native").join(pages.select("doc_id", "page", F.col("foreign").alias("__foreign")), ["doc_id", "page"], "left")
    chosen = other.withColumn("__form", F.when(F.coalesce("__foreign", F.lit(False)), F.col("__f.native")).otherwise(F.col("__f.latin"))).drop("__f", "__foreign")
    return same.unionByName(chosen)


def normalize(rows: DataFrame, counts: dict[str, int] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """rows with text in its consistent form; rows without a candidate character never leave the JVM."""
    counts = corpus_counts(rows.select("text")) if counts is None else counts
    pages = page_scripts(rows) if pages is None else pages
    return rows.where(~touched()).unionByName(forms(rows, counts, pages).withColumn("text", F.col("__form")).drop("__form").select(rows.columns))


def found(rows: DataFrame, counts: dict[str, int] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Rows whose consistent form differs from their text, one per distinct row."""
    counts = corpus_counts(rows.select("text")) if counts is None else counts
    pages = page_scripts(rows) if pages is None else pages
    return forms(rows, counts, pages).where("__form <> text").drop("__form", "text").distinct()


if __name__ == "__main__":
    print(len(classes()), len(candidate_pattern()), file=sys.stderr)

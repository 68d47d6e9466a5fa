"""Problem 5: text that was decoded with the wrong character encoding.

Round-trip repair: a piece of text is encoded again under a candidate legacy
encoding and strictly decoded as an intended one; the result is kept when a
garbling cost drops, and the step is repeated until nothing drops any more,
so any number of nested layers is undone.  The whole text is tried first, then
its runs between plain spaces, so that text decoded wrongly in part is mended
in part.

The cost counts evidence of garbling, never letters of an alphabet: broken
characters, byte sequences of UTF-8 spelled out in signs, a capital accented
letter after a small one, a sign inside a word, letters of two scripts in one
word, four accented letters in a row.  Weak signs (a letter standing alone)
count only beside strong ones.  Polish, Turkish, Czech or Ukrainian text costs
nothing and is never touched.

Between single-byte encodings strict decoding proves little.  There a reading
must also be better supported: its accented letters stand beside letters they
stand beside in the corpus (a table of letter pairs, bounded by the alphabet).

Defined results: null and empty texts are not affected; a text that is
garbled but cannot be restored keeps what could be mended (``restorable`` is
false while any cost is left); duplicate rows are one result of ``affected``
and keep their copies in ``restore``.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Legacy encodings text may have been read with, and what it may have been.
READ_AS_UTF8 = [["latin-1", "cp1252"], ["cp1250", "iso8859-2"], ["cp437", "cp850", "mac_roman"], ["cp1251", "cp1254", "iso8859-15", "cp1253", "koi8-r", "cp866", "cp1256"]]  # likeliest group first
SINGLE_BYTE = [(r, w) for w in ("cp1252",) for r in ("cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "cp1251", "cp1253", "koi8-r", "cp866", "cp1256")]
FOREIGN = [(r, w) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250") for w in ("cp1251", "cp1253", "cp1256", "cp874", "koi8-r", "iso8859-5", "iso8859-6", "iso8859-7", "cp866")]
FOREIGN += [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_cyrillic", "cp1251")]
WIDE = [(r, w) for r in ("cp1252", "latin-1") for w in ("cp932", "gbk", "euc_jp", "big5", "euc_kr")]

# Signs that stand beside letters in correct text.
CLOSERS = "”“»«’‘…–—"
AFTER_LETTER = set(CLOSERS + "·•ºª°²³¹‐‑€¿¡„™®©†‡›‹´`")
INSIDE = set("’‘–—‐‑“”„»«´`")
BEFORE_LETTER = set("“„«»‹›‘’¿¡–—…•·†‡§¶©®€£¥¢°№☐☑✓★●■□▪◦‣→←⇒º´`")
MATHS = set("±≤≥≈∞√∂∑∏∫∩≡÷×◊¬Ω")
IN_WORD = set("¤¢£¥§¶¬¦µ")
DIACRITICS = set("˙˚¸˝˛ˇ˘¨˜ˆ¯")
ALIKE = set("аеорсухіјѕАВЕКМНОРСТХІЈЅοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
VOWELS = set("aeiouyäöüAEIOUYÄÖÜáéíóúàèìòùâêîôû")


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """L latin, G greek, C cyrillic, J cjk, O other letter or mark, S sign, P space or ASCII sign, X broken."""
    o = ord(c)
    if o < 128:
        return "L" if c.isalpha() else "P" if o >= 32 or c in "\t\r\n" else "X"
    if c == "\x85":
        return "P"
    if 0x80 <= o < 0xA0 or c == "�" or U.category(c) in ("Co", "Cn", "Cs"):
        return "X"
    if c in "ªº":
        return "L"
    if c == "µ" or c in DIACRITICS:
        return "S"
    if c in "ʹʺʻʼʾʿ":
        return "P"
    name = U.name(c, "")
    kind = U.category(c)[0]
    if kind in "LM":
        for k, s in (("L", "LATIN"), ("L", "FULLWIDTH LATIN"), ("G", "GREEK"), ("C", "CYRILLIC"), ("J", "CJK"), ("J", "HIRAGANA"), ("J", "KATAKANA")):
            if name.startswith(s):
                return k
        return "M" if kind == "M" and o < 0x370 else "O"
    return "P" if kind in "ZC" else "S"


@lru_cache(maxsize=262144)
def _mark(pp: str, p: str, c: str, q: str, qq: str) -> tuple[int, int]:
    """(strong, weak) evidence of garbling at the non-ASCII character c between p and q."""
    o, k, kp, kq = ord(c), _kind(c), _kind(p), _kind(q)
    if k == "X":
        return 2, 0
    lone = p in " \n" and q in " \n" and pp.isalpha() and qq.isalpha() and pp.islower() and qq.islower()
    if k == "L":
        if o >= 0xFF00 or c in "ﬁﬂ":
            return 0, 0
        if c.isupper() and p.islower() and kp == "L" and p not in "ªº":
            return 1, 0
        if c.islower() and c not in "ªºß" and p.isupper() and pp.isupper() and kp == "L" and kq == "L":
            return 1, 0
        if kq == "S" and q not in AFTER_LETTER and ord(q) < 0xFF00:
            return 1, 0
        if c == "ß" and ((kp == "L" and p not in VOWELS) or p == "-" or (kp == "P" and not p.isdigit() and kq == "L")):
            return 1, 0
        if c.isupper() and p.isupper() and p.isascii() and q.islower() and kq == "L" and not pp.isalpha():
            return 1, 0
        if c.islower() and c not in "ªº" and p == " " and q.isascii() and q.isupper():
            return 1, 0  # a quotation mark read as a letter
        quote = c.islower() and c not in "ªº" and p in ".!?" and q in " .,;"
        return 0, int(lone or quote or (c in "ªº" and kp == "L" and p not in "nNDMVSsr" and kq == "L"))
    if k in "GC":
        latin = (kp == "L") + (kq == "L") + (kp == "L" and _kind(pp) == "L") + (kq == "L" and _kind(qq) == "L")
        same = (kp == k) + (kq == k) + (kp != "P" and _kind(pp) == k) + (kq != "P" and _kind(qq) == k)
        if c not in ALIKE and latin > same:
            return 1, 0
        if {kp, k} == {"G", "C"} or (kp == k and c.isupper() and p.islower()):
            return 1, 0
        if (kq == "S" and q not in AFTER_LETTER) or (kp == "S" and p not in INSIDE and p not in BEFORE_LETTER and p not in "("):
            return 1, 0
        return 0, int(kp not in "GCOJMX" and kq not in "GCOJMX" and c not in ALIKE)
    if k == "S":
        letters = "LGC"
        if 0x2500 <= o < 0x25A0 or c in "⌐⌠⌡¼½¾":
            return (1, 0) if kp in letters or (kq in letters and c not in "¼½¾") else (0, int(kp != "P" or kq != "P" or lone))
        if c == "∫" and (kp == "L" or p.isdigit()) and q in " ,.;":
            return 1, 0
        if c in MATHS:
            return (1, 0) if kp == "L" and (kq == "L" or q in ",.;" or (pp.isalpha() and p.islower())) else (0, int(kp in letters or kq in letters))
        if c in DIACRITICS:
            return int(kp in letters or kq in letters), int(lone)
        if c == "·":
            return int(kp == "L" and kq == "L" and not (p in "lL" and q in "lL")), int(lone)
        if c in IN_WORD:
            return int(kp in letters and kq in letters and not (p.isupper() and q.isupper())), int(kp in letters)
        if kp in letters and kq in letters and o < 0xFF00 and c not in INSIDE and c not in "„" and not (c in BEFORE_LETTER and q.isupper()) and c != "°":
            return 1, 0
        if c in "‚ƒ„" and kp in letters and kq in letters:
            return 1, 0
        return 0, int(kp in letters and c not in AFTER_LETTER)
    if k in "OJ":  # letters without case beside accented Latin ones
        accented = lambda x, kx: kx == "L" and ord(x) > 127 and ord(x) < 0xFF00 and x not in "ªº"
        odd = lambda x, kx: kx == "S" and (x in DIACRITICS or x in MATHS or x in IN_WORD or x in "‚ƒ„†‡ˆ‰¼½¾")
        return int(accented(p, kp) or accented(q, kq) or odd(p, kp) or odd(q, kq)), 0
    return 0, 0


def _char_class(encodings: tuple[str, ...], low: int, high: int) -> str:
    out = set()
    for e in encodings:
        for b in range(low, high + 1):
            try:
                out.add(bytes([b]).decode(e))
            except UnicodeDecodeError:
                out.add(chr(b))
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(out)) + "]"


_CONT, _CONT_MAC = _char_class(("cp1252", "latin-1"), 0x80, 0xBF), _char_class(("mac_roman",), 0x80, 0xBF)
_SPELLED = re.compile(f"[Â-Å]{_CONT}|â{_CONT}{_CONT}")
_SPELLED_MAC = re.compile(f"[√¬]{_CONT_MAC}|‚Ä{_CONT_MAC}")
_SPELLED_DOS = re.compile(f"[├┬]{_char_class(('cp437', 'cp850'), 0x80, 0xAF)}|┬[║╗░]|(?:ΓÇ|ÔÇ){_char_class(('cp437', 'cp850'), 0x80, 0xBF)}")
_SPELLED_CYRILLIC = re.compile(f"(?<![\u0400-\u04ff])[ВГ]{_char_class(('cp1251',), 0x80, 0xBF)}(?![\u0400-\u04ff])")
_MOSTLY_LATIN = re.compile("[A-Za-z].*[A-Za-z].*[A-Za-z]", re.S)
_HIGH = re.compile(r"[^\x00-\x7f]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_ACCENTED_RUN = re.compile("[À-ÖØ-öø-ÿ]{4,}")


def _spelled(text: str) -> int:
    """Characters of UTF-8 spelled out in the signs of a code page."""
    n = sum(len(m[0]) for m in _SPELLED_DOS.finditer(text))
    n += sum(m[0][1] not in "πΩ∂∑∏∞" or text[m.end() : m.end() + 1].isalpha() for m in _SPELLED_MAC.finditer(text))
    if not n and _MOSTLY_LATIN.search(text):
        n = len(_SPELLED_CYRILLIC.findall(text))
    for m in _SPELLED.finditer(text):
        a, b = m.start(), m.end()
        if b - a == 2:
            p, q = text[a - 1 : a], text[b : b + 1]
            if text[a + 1] in CLOSERS + "\xa0\xad·ºª´" and (p.isupper() or (text[a] in "ÄÅ" and not p.islower())) and not (q.isupper() and text[a + 1] in "·ºª´"):
                continue  # a capital letter before a closing sign or space
        n += b - a
    return n


def cost(text: str) -> int:
    """Evidence of garbling in text; 0 for correct text of any language."""
    strong = 2 * len(_CONTROL.findall(text))
    if text.isascii():
        return strong
    weak, padded = 0, f"  {text}  "
    for m in _HIGH.finditer(padded):
        i = m.start()
        s, w = _mark(padded[i - 2], padded[i - 1], padded[i], padded[i + 1], padded[i + 2])
        strong += s
        weak += w
    strong += _spelled(text) + len(_ACCENTED_RUN.findall(text))
    return strong + weak if strong else 0


@lru_cache(maxsize=64)
def _tables(encoding: str) -> dict[str, int]:
    """char -> byte, undefined bytes standing for themselves, as lenient readers have them."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def _recode(text: str, legacy: str, intended: str) -> str | None:
    table = _tables(legacy)
    try:
        return bytes([table[c] for c in text]).decode(intended)
    except (KeyError, UnicodeDecodeError):
        return None


def _plausible(text: str) -> bool:
    return not any(_kind(c) == "X" for c in text)


def _foreign(text: str) -> bool:
    """A text of another script has few ASCII letters left once garbled."""
    high = sum(ord(c) > 127 for c in text)
    return high >= 3 and sum(c.isascii() and c.isalpha() for c in text) * 3 < high


Pairs = dict[str, int]


def _neighbours(text: str, i: int) -> tuple[str, str, str]:
    """The letter at i of a padded small text with its neighbours; what is no letter counts as a space."""
    p, q = (x if _kind(x) == "L" else " " for x in (text[i - 1], text[i + 1]))
    return p, text[i], q


def _support(text: str, at: list[int], pairs: Pairs | None) -> float:
    """How well the accented letters at the given places go with their neighbours; without a corpus, whether they have letters beside them."""
    low, total = f" {text.lower()} ", 0.0
    if len(low) != len(text) + 2:  # a letter of two code points when small
        low = f" {text} "
    for i in at:
        p, c, q = _neighbours(low, i + 1)
        if ord(c) < 128 or _kind(c) != "L":
            continue
        if pairs is None:
            total += 1 if (p.isascii() and p.isalpha()) or (q.isascii() and q.isalpha()) else -1
        elif triple := pairs.get(p + c + q, 0):
            total += log2(1 + triple)
        else:
            total += 0.5 if pairs.get(p + c) and pairs.get(c + q) else -1
    return total


def _spelt(text: str, now: int, pairs: Pairs | None) -> tuple[int, str]:
    """The reading as UTF-8 under the first group of encodings that lowers the cost: the lowest, of equal ones the best supported."""
    for group in READ_AS_UTF8:
        found = {new: c for r in group if (new := _recode(text, r, "utf-8")) is not None and new != text and (c := cost(new)) < now}
        if found:
            least = min(found.values())
            best = [new for new, c in found.items() if c == least]
            return least, best[0] if len(best) == 1 else max(best, key=lambda t: _support(t, list(range(len(t))), pairs))
    return now, text


def _reread(text: str, now: int, pairs: Pairs | None) -> tuple[int, str]:
    """The reading under another single-byte or two-byte encoding: cheaper, and where letters become letters better supported."""
    best = (now, 0.0, text)
    if _foreign(text):
        for r, w in FOREIGN + WIDE:
            new = _recode(text, r, w)
            if new is None or new == text or not _plausible(new) or any(_kind(x) == "L" and ord(x) > 127 for x in new):
                continue
            if (c := cost(new)) < best[0]:
                best = (c, 0.0, new)
                if not c:
                    return 0, new
    for r, w in SINGLE_BYTE:
        new = _recode(text, r, w)
        if new is None or new == text or (c := cost(new)) > best[0] or c == now or not _plausible(new):
            continue
        at = [i for i, (x, y) in enumerate(zip(text, new)) if x != y]
        letters = [i for i in at if _kind(new[i]) == "L"]
        gain = _support(new, letters, pairs) - max(0.0, _support(text, letters, pairs)) if letters else 0.25
        if gain > 0 and (c < best[0] or gain > best[1]):
            best = (c, gain, new)
    return best[0], best[2]


def _step(text: str, now: int, pairs: Pairs | None) -> tuple[int, str]:
    """One layer undone: as UTF-8 before other encodings, the whole text before its runs between plain spaces."""
    for read in (_spelt, _reread):
        c, new = read(text, now, pairs)
        if c and " " in text:
            parts = " ".join(read(t, k, pairs)[1] if (k := cost(t)) else t for t in text.split(" "))
            if (m := cost(parts)) < c:
                c, new = m, parts
        if c < now:
            return c, new
    return now, text


def repair(text: str, pairs: Pairs | None = None) -> tuple[int, str, int]:
    """(cost before, mended text, cost after). The cost falls with every step, so the loop ends."""
    first = now = cost(text)
    while now:
        c, new = _step(text, now, pairs)
        if c >= now:
            break
        now, text = c, new
    return first, text, now


def _mend(pairs: Pairs | None):
    @F.pandas_udf("before int, text string, after int")
    def mend(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[int, str, int]] = {}
        for s in batches:
            out = []
            for t in s:
                if t not in seen:
                    if len(seen) > 50_000:  # a memory of repeated texts, no limit of the result
                        seen.clear()
                    seen[t] = repair(t, pairs)
                out.append(seen[t])
            yield pd.DataFrame(out, columns=["before", "text", "after"])

    return mend.asNondeterministic()  # else the optimizer evaluates it once per use


ACCENTED = "\\x{E0}-\\x{F6}\\x{F8}-\\x{FF}\\x{AA}\\x{BA}"


def letter_pairs(rows: DataFrame, text: str = "text") -> Pairs:
    """Counts of accented Western letters with one and with both neighbours (small letters or the end of a word) over all rows.

    The driver receives one row per combination: at most 33 x 60 x 62, whatever the corpus."""
    held = rows.where(F.col(text).rlike(f"[{ACCENTED}]")).select(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), f"[^a-z{ACCENTED}]", " "), F.lit(" ")).alias("t"))
    near = f"[a-z {ACCENTED}]"
    every = F.flatten(F.array(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (f"{near}[{ACCENTED}]", f"[{ACCENTED}]{near}", f"{near}[{ACCENTED}]{near}")]))
    return {r["pair"]: int(r["n"]) for r in held.select(F.explode(every).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}


def _suspect(text: str):
    return F.col(text).rlike("[^\\x00-\\x7F]|[\\x00-\\x08]")


def affected(rows: DataFrame, text: str = "text") -> DataFrame:
    """Distinct affected rows with columns repaired and restorable.

    A row is affected when its cost drops under some round trip, or when it holds characters that only
    decoding errors leave behind (U+FFFD and C1 controls; U+0085 is a line end)."""
    tried = rows.where(_suspect(text)).distinct().withColumn("__m", _mend(letter_pairs(rows, text))(F.col(text)))
    hit = tried.where((F.col("__m.after") < F.col("__m.before")) | F.col(text).rlike("[\\x{FFFD}\\x{80}-\\x{84}\\x{86}-\\x{9F}]"))
    return hit.withColumn("repaired", F.col("__m.text")).withColumn("restorable", F.col("__m.after") == 0).drop("__m")


def restore(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with text mended where a round trip lowers its cost; copies and other columns stay."""
    mended = rows.where(_suspect(text)).withColumn("__m", _mend(letter_pairs(rows, text))(F.col(text)))
    mended = mended.withColumn(text, F.col("__m.text")).drop("__m").select(rows.columns)
    return rows.where(~F.coalesce(_suspect(text), F.lit(False))).unionByName(mended)

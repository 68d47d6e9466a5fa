"""String operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it (Java's \s is ASCII only).
WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# Shapes of markers, headings and notes.
BULLET = f"^{WS}*([-–—•▪◦·*]){WS}+(?=\\S)"
ORDERED_NUM = f"^{WS}*\\(?(\\d{{1,3}})[.)]{WS}+(?=\\S)"
ORDERED_ALPHA = f"^{WS}*\\(?([a-zA-Z])[.)]{WS}+(?=\\S)"
ORDERED_ROMAN = f"(?i)^{WS}*\\(?((?=[ivx])x{{0,3}}(?:ix|iv|v?i{{0,3}}))[.)]{WS}+(?=\\S)"
NUMBERING = f"^{WS}*(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,4}})[.)]?{WS}+(?=\\S)"
ROMAN_HEADING = f"^{WS}*([IVXLCDM]{{1,7}}){WS}*[-–—.)]{WS}+(?=\\S)"
STRUCTURAL = f"(?iu)^{WS}*(CAP[ÍI]TULO|T[ÍI]TULO|SE[ÇC][ÃA]O|SUBSE[ÇC][ÃA]O|PARTE|ANEXO|CL[ÁA]USULA|LIVRO)(?![\\p{{L}}\\p{{N}}_])"
FOOTNOTE = f"^{WS}*(\\[?\\d{{1,3}}\\]?|[*†‡§]{{1,3}})[.)\\]]?{WS}+(?=\\S)"
SENTENCE_END = f"[.;:!?]{WS}*$"
COMPLETE_END = f"[.!?;:»”\"']{WS}*$"
CONTINUES = "^[a-zàáâãéêíóôõúç(\\[“\"']"
HYPHEN_END = "[\\p{L}\\p{N}_]-$"
CAPTION = f"(?iu)^{WS}*(figura|fig\\.?|imagem|gráfico|grafico|foto|quadro|ilustração|ilustracao|anexo|documento){WS}*[\\d ivxlc]*{WS}*[-–—:.)]"
TOKEN = "[\\p{L}\\p{Nl}\\p{No}]{2,}"
NUMBER = "\\d[\\d.,:/]*\\d|\\d"
WORD = "[\\p{L}\\p{Nl}\\p{No}]+"
VOWELS = "[aeiouáàâãéêíóôõúüAEIOUÁÀÂÃÉÊÍÓÔÕÚÜ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def recurrence_key(c: Column) -> Column:
    """Lower case, digit runs as #, single spaces."""
    return collapse(F.regexp_replace(F.lower(c), "\\p{Nd}+", "#"))


def join_lines(lines: Column, dehyphenate: Column) -> Column:
    """Lines joined by spaces; a hyphen at a line's end is dropped before a small letter if the file breaks words, else kept without a space."""

    def step(acc: Column, x: Column) -> Column:
        ends = acc.rlike(f"[\\p{{L}}\\p{{N}}_]-{WS}*$")
        small = F.substring(x, 1, 1) != F.upper(F.substring(x, 1, 1))
        return (
            F.when(acc.isNull(), x)
            .when(ends & dehyphenate & small, F.concat(F.regexp_replace(acc, f"-{WS}*$", ""), x))
            .when(ends, F.concat(F.regexp_replace(acc, f"{WS}+$", ""), F.regexp_replace(x, f"^{WS}+", "")))
            .otherwise(F.concat(F.regexp_replace(acc, f"{WS}+$", ""), F.lit(" "), F.regexp_replace(x, f"^{WS}+", "")))
        )

    return strip(F.coalesce(F.aggregate(lines, F.lit(None).cast("string"), step), F.lit("")))


def list_marker(c: Column) -> Column:
    """struct(marker, ordered, rest) or null; bullets, numbers, letters, then roman numerals up to 39."""

    def found(pattern: str, ordered: bool, bare: bool = False) -> Column:
        whole = F.regexp_extract(c, pattern, 0)
        marker = F.regexp_extract(c, pattern, 1) if bare else strip(whole)
        return F.struct(marker.alias("marker"), F.lit(ordered).alias("ordered"), F.substring(c, F.char_length(whole) + 1, F.char_length(c)).alias("rest"))

    return F.when(c.rlike(BULLET), found(BULLET, False, True)).when(c.rlike(ORDERED_NUM), found(ORDERED_NUM, True)).when(c.rlike(ORDERED_ALPHA), found(ORDERED_ALPHA, True)).when(c.rlike(ORDERED_ROMAN), found(ORDERED_ROMAN, True))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def looks_numeric(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(strip(c), "R\\$|[.,% -]", "").rlike("^\\p{Nd}+$"), F.lit(False))


def suspect_token(t: Column) -> Column:
    """Four letters without a vowel, a character four times in a row, or case changing three times."""
    chars = F.split(t, "")
    upper = F.transform(chars, lambda x: (F.upper(x) == x) & (F.lower(x) != x))
    changes = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(upper) - 1, F.lit(1))), F.lit(0), lambda a, i: a + F.when(F.get(upper, i) != F.get(upper, i - 1), 1).otherwise(0))
    mixed = F.expr("true") & F.substring(t, 2, 1000000).rlike("\\p{Lu}") & F.substring(t, 2, 1000000).rlike("\\p{Ll}")
    return ((F.char_length(t) >= 4) & ~t.rlike(VOWELS)) | t.rlike("(.)\\1{3,}") | ((F.char_length(t) >= 5) & mixed & (changes >= 3))


def escape_text(c: Column) -> Column:
    """Markup at the start of a text made harmless."""
    return F.regexp_replace(c, f"^({WS}*)([#>*+\\-=]|\\d+[.)])({WS})", "$1\\\\$2$3")


def escape_inline(c: Column) -> Column:
    return escape_text(F.regexp_replace(F.regexp_replace(c, "\\\\", "\\\\\\\\"), "([*_`~\\[\\]])", "\\\\$1"))


def escape_cell(c: Column) -> Column:
    lf = F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n|\\r", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(lf, "\\|", "\\\\|"), "\n", "<br>"), "[ \\t]+", " "))


def yaml_escape(c: Column) -> Column:
    return F.left(F.regexp_replace(collapse(c), '"', '\\\\"'), F.lit(300))


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)^---\\n.*?\\n---\\n", "")


def collapse_blank_lines(c: Column) -> Column:
    """At most one blank line in a row, no spaces at line ends, one line feed at the end."""
    trimmed = F.regexp_replace(c, f"[ \\t\\x{{A0}}]+(?=\\n|$)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, "\\n{3,}", "\n\n"), "^\\n+", ""), "\\n+$", ""), F.lit("\n"))


def page_list(c: Column) -> Column:
    """'1-3,7' as a sorted array of positive pages; a reversed range is empty, a malformed list gives null."""
    chunks = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    fine = F.forall(chunks, lambda x: x.rlike("^\\d+\\s*(-\\s*\\d+)?$"))
    lo = lambda x: F.regexp_extract(x, "^(\\d+)", 1).cast("int")
    hi = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, "-\\s*(\\d+)$", 1), F.lit("")).cast("int"), lo(x))
    ranges = F.transform(chunks, lambda x: F.when(lo(x) <= hi(x), F.sequence(lo(x), hi(x))).otherwise(F.array().cast("array<int>")))
    return F.when(fine, F.array_sort(F.array_distinct(F.filter(F.flatten(ranges), lambda p: p > 0))))


def safe_stem(c: Column, default: str = "documento") -> Column:
    """A usable file stem: base name over both slashes, no illegal characters, at most 120 characters, no reserved name."""
    base = F.regexp_replace(F.coalesce(c, F.lit("")), "^.*[/\\\\]", "")
    stem = F.regexp_replace(base, "(?<=.)\\.[^.]*$", "")
    clean = F.regexp_replace(collapse(F.regexp_replace(stem, '[<>:"/\\\\|?*\\x00-\\x1f]', "")), "[. ]+$", "")
    cut = F.regexp_replace(F.left(clean, F.lit(120)), "[. ]+$", "")
    reserved = F.lower(cut).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    return F.when((cut == "") | reserved, default).otherwise(cut)


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, at most 80."""
    plain = F.translate(F.lower(c), "áàâãäçéèêëíìîïñóòôõöúùûü", "aaaaaceeeeiiiinooooouuuu")
    return F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(80))


def provider_operations(c: Column) -> Column:
    """The operations of a provider's answer: envelope, code fence, list, object or embedded object; else an empty list as JSON text."""
    inner = F.coalesce(F.get_json_object(c, "$.result"), c)
    bare = F.regexp_replace(F.trim(inner), "(?m)^```(?:json)?\\s*|\\s*```$", "")
    embedded = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    ops = F.coalesce(F.get_json_object(bare, "$.operations"), F.when(F.trim(bare).startswith("[") & F.get_json_object(bare, "$").isNotNull(), F.get_json_object(bare, "$")), F.get_json_object(embedded, "$.operations"), F.lit("[]"))
    failed = F.coalesce(F.get_json_object(c, "$.is_error") == "true", F.lit(False))
    return F.when(failed, "[]").otherwise(ops)

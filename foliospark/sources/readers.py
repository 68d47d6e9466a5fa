"""Adapters that turn files into positioned records.

Text and HTML are read natively. PDF decoding and recognition are plug-ins: a decoder registered by name is run behind
``mapInPandas``; without one the reader gives its rows with an error column instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T

Decoder = Callable[[bytes], list[dict]]
DECODERS: dict[str, Decoder] = {}
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
SPANS = "doc_id string, page int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, color int, confidence double"


def register(name: str, decoder: Decoder) -> None:
    """A decoder takes a file's bytes and returns span dicts without doc_id."""
    DECODERS[name] = decoder


def capabilities() -> dict[str, bool]:
    """Which optional engines can be imported here."""
    import importlib.util

    return {name: importlib.util.find_spec(mod) is not None for name, mod in (("pdf", "pymupdf"), ("second_reader", "pdfplumber"), ("recognition", "pytesseract"), ("lattice", "camelot"), ("tabula", "tabula"))} | {f"decoder:{d}": True for d in DECODERS}


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(doc_id, path, filename, bytes, sha256, modified, content, error) of a folder's files; error is set where a file is empty or no PDF."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    magic = F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")
    error = F.when(F.col("length") == 0, "arquivo vazio")
    if glob.lower().endswith("pdf"):
        error = error.when(~magic, "INVALID_PDF")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(F.sha2("content", 256).alias("doc_id"), "path", name.alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"), "content", error.alias("error"))


def not_yet_converted(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose doc_id has no output yet: resuming is an anti-join."""
    return files.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def decode(files: DataFrame, decoder: str) -> DataFrame:
    """Spans of files by a registered decoder, plus error rows: columns of SPANS and error."""
    fn = DECODERS.get(decoder)
    cols = [c.split(" ")[0] for c in SPANS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    if fn is None:
                        raise RuntimeError(f"no decoder named {decoder}")
                    rows += [{**{c: s.get(c) for c in cols}, "doc_id": doc, "error": None} for s in fn(bytes(content))]
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                    rows.append({**dict.fromkeys(cols), "doc_id": doc, "error": str(e)[:200]})
            frame = pd.DataFrame(rows, columns=[*cols, "error"])
            for c in ("page", "block_no", "line_no", "span_no", "flags", "color"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return files.where("error is null").select("doc_id", "content").mapInPandas(run, SPANS + ", error string")


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain text as positioned lines: 20 lines a page, a line every 36 points (key, page, line_no, text, box, size)."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.col(text), "\\r\\n|\\r|\\n")).alias("pos", "line"))
    y0 = 60 + (F.col("pos") % 20) * 36
    x1 = 56 + F.least(F.lit(480.0), 4.5 * F.char_length("line"))
    return rows.select(key, (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"), F.col("pos").alias("line_no"), F.col("line").alias("text"), F.lit(56.0).alias("x0"), y0.cast("double").alias("y0"), x1.alias("x1"), (y0 + 10).cast("double").alias("y1"), F.lit(10.0).alias("size"))


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown as typed blocks (key, seq, kind, level, marker, text): headings, list items, quotations, table rows, paragraphs."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.col(text), "\\r\\n|\\r|\\n")).alias("seq", "line")).where(F.col("line").rlike("\\S"))
    line = T.strip(F.col("line"))
    marks = F.regexp_extract(line, "^(#{1,6})\\s", 1)
    item = T.list_marker(line)
    kind = F.when(marks != "", "heading").when(line.startswith("|"), "table_row").when(line.startswith(">"), "quote").when(item.isNotNull(), "list_item").otherwise("paragraph")
    body = F.when(marks != "", F.regexp_replace(line, "^#{1,6}\\s+", "")).when(kind == "quote", F.regexp_replace(line, "^>\\s*", "")).when(kind == "list_item", T.strip(item["rest"])).otherwise(line)
    return rows.select(key, F.col("seq").cast("int").alias("seq"), kind.alias("kind"), F.when(marks != "", F.char_length(marks)).alias("level"), F.when(kind == "list_item", item["marker"]).alias("marker"), body.alias("text"))


def html_blocks(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, pos, tag, text) of headings, paragraphs and list items of HTML; script, style, nav and footer are boilerplate."""
    bare = F.regexp_replace(F.col(html), "(?is)<(script|style|nav|footer)\\b.*?</\\1>", "")
    found = F.regexp_extract_all(bare, F.lit("(?is)<(?:h[1-6]|p|li)\\b[^>]*>.*?</(?:h[1-6]|p|li)>"), F.lit(0))
    rows = pages.select(F.col(key), F.posexplode(found).alias("pos", "el"))
    inner = T.collapse(F.regexp_replace(F.regexp_replace("el", "(?i)<br\\s*/?>", " "), "<[^>]*>", ""))
    text = F.replace(F.replace(F.replace(F.replace(inner, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return rows.select(key, "pos", F.lower(F.regexp_extract("el", "(?i)^<(h[1-6]|p|li)", 1)).alias("tag"), text.alias("text"))


def map_box(x0: Column, y0: Column, x1: Column, y1: Column, matrix: tuple[float, float, float, float, float, float], zoom: float) -> Column:
    """A pixel box under the inverse of an image transform, in points: the envelope of its four mapped corners."""
    a, b, c, d, e, f = matrix
    px = lambda x, y: (x * a + y * c + e) / zoom
    py = lambda x, y: (x * b + y * d + f) / zoom
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    xs, ys = [px(*p) for p in corners], [py(*p) for p in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))

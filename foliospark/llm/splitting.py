"""Problem 7: oversized items cut at natural boundaries.

Agglomerative merging: an item starts as atomic segments; adjacent pairs wait
in a heap by the strength of the boundary between them; the weakest boundary
is closed first while the merged size plus the overlap fits the limit.  What
stays open is where the item is cut, so cuts fall on the strongest boundaries.
Each piece then repeats the last ``overlap`` units of the piece before it.

Texts are cut one by one.  A file's block list may be long, so it is first
parted into stretches of a bounded number of blocks at its own strong
boundaries; stretches are cut independently and numbered through.

Defined results: null and short texts and short files give no piece; a word
longer than the limit is cut hard, never inside a letter and its accents where
that fits; equal rows count once; a null seq sorts first.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096
STRETCH_SLACK = 64


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit:
        raise ValueError(f"overlap {overlap} must be at least 0 and below the limit {limit}")


def merge_segments(sizes: list[int], strengths: list[float], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open ranges of segments. strengths[i] is the boundary between segments i and i + 1."""
    n, room = len(sizes), limit - overlap
    size, nxt, prev = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(strengths[i], size[i] + size[i + 1], i) for i in range(n - 1) if size[i] + size[i + 1] <= room]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        strength, total, a = pop(heap)
        b = nxt[a]
        if b >= n or strengths[b - 1] != strength or size[a] + size[b] != total:  # one side has grown since
            continue
        size[a], size[b] = total, -(limit + total) * 2
        c, p = nxt[b], prev[a]
        nxt[a] = c
        if c < n:
            prev[c] = a
            if total + size[c] <= room:
                push(heap, (strengths[c - 1], total + size[c], a))
        if p >= 0 and size[p] + total <= room:
            push(heap, (strengths[a - 1], size[p] + total, p))
    out, i = [], 0
    while i < n:
        out.append((i, nxt[i]))
        i = nxt[i]
    return out


ATOM = re.compile(r"\S+\s*|\s+")
IDEOGRAPHIC = re.compile(r"[^。！？]+[。！？]*[”」』]?|[。！？]+[”」』]?")
# Signs that end a sentence or clause, and marks that may follow them.
STOPS, CLAUSES, AFTER_STOP = ".!?…。！？।؟", ";:,、，）)", "\"”»“)」』"


def _strength(part: str) -> float:
    """Strength of the boundary after an atom."""
    word = part.rstrip()
    gap = len(part) - len(word)
    if gap and "\n" in (white := part[len(word) :]):
        return 6.0 if white.count("\n") > 1 else 5.0
    last = word[-1:]
    if not last:
        return 2.0 if gap else 1.0
    if last in STOPS or (last in AFTER_STOP and word.rstrip(AFTER_STOP)[-1:] in STOPS_SET):
        return 4.0
    if last in CLAUSES:
        return 3.0
    return 2.0 if gap else 1.0


STOPS_SET = set(STOPS)


def text_segments(text: str, room: int) -> tuple[list[int], list[float]]:
    """Sizes of a text's atoms and the strength of each boundary: 1 inside a word, 2 space, 3 clause, 4 sentence, 5 line, 6 paragraph."""
    sizes, strengths = [], []
    dense = "。" in text or "！" in text or "？" in text
    for atom in ATOM.findall(text):
        while len(atom) > room:
            at = room
            while at > room // 2 and unicodedata.category(atom[at]) in ("Mn", "Mc", "Me", "Cf"):
                at -= 1
            sizes.append(at)
            strengths.append(1.0)
            atom = atom[at:]
        for part in IDEOGRAPHIC.findall(atom) if dense else (atom,):
            sizes.append(len(part))
            strengths.append(_strength(part))
    return sizes, strengths[:-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open character ranges of the pieces, each at most limit, consecutive ones sharing overlap characters."""
    _check(limit, overlap)
    if len(text) <= limit:
        return [(0, len(text))]
    sizes, strengths = text_segments(text, limit - overlap)
    at = [0]
    for s in sizes:
        at.append(at[-1] + s)
    return [(max(0, at[a] - (overlap if a else 0)), at[b]) for a, b in merge_segments(sizes, strengths, limit, overlap)]


def text_pieces(blocks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(doc_id, block_id, piece_no, start_at, end_at, piece) of every text longer than limit."""

    _check(limit, overlap)

    def cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, b, i, s, e, t[s:e]) for d, b, t in zip(pdf["doc_id"], pdf["block_id"], pdf["text"]) for i, (s, e) in enumerate(split_text(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_id", "piece_no", "start_at", "end_at", "piece"])

    long_ = blocks.where(F.char_length("text") > limit).select("doc_id", "block_id", "text").distinct()
    return long_.mapInPandas(cut_texts, "doc_id string, block_id string, piece_no int, start_at int, end_at int, piece string")


def block_strength() -> Column:
    """Strength of the boundary before a block: headings by level, a new page, then kind changes."""
    heading = F.col("kind") == "heading"
    return F.when(heading, 8.0 - F.least(F.coalesce("level", F.lit(6)), F.lit(6))).when(F.col("kind").isin("list_item", "footnote"), 0.5).otherwise(1.0)


def block_pieces(blocks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(doc_id, piece_no, start_pos, end_pos, n_blocks) for files of more than limit blocks; page breaks do not count.

    Positions are 0-based in reading order, end exclusive; consecutive pieces share overlap blocks."""
    _check(limit, overlap)
    kept = blocks.where(F.coalesce("kind", F.lit("")) != "page_break").select("doc_id", "block_id", "seq", "kind", "level").distinct()
    long_ = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("doc_id")
    rows = kept.join(long_, "doc_id").withColumn("seq", F.coalesce("seq", F.lit(0))).withColumn("strength", block_strength())
    k = F.floor(F.col("seq") / STRETCH)
    edge = rows.where((F.col("seq") % STRETCH < STRETCH_SLACK) & (k > 0)).groupBy("doc_id", k.alias("k")).agg(F.max_by("seq", F.struct("strength", -F.col("seq"))).alias("edge"))
    rows = rows.withColumn("k", k).join(edge, ["doc_id", "k"], "left").withColumn("k", F.when(F.col("seq") < F.col("edge"), F.col("k") - 1).otherwise(F.col("k"))).drop("edge")
    stretches = rows.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("seq", "block_id", "strength"))).alias("b"))  # at most STRETCH + STRETCH_SLACK blocks each

    def cut_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, k_, b in zip(pdf["doc_id"], pdf["k"], pdf["b"]):
                ranges = merge_segments([1] * len(b), [float(x["strength"]) for x in b[1:]], limit, overlap)
                out += [(doc, k_, s, e, len(b)) for s, e in ranges]
            yield pd.DataFrame(out, columns=["doc_id", "k", "s", "e", "size"])

    local = stretches.mapInPandas(cut_lists, "doc_id string, k bigint, s int, e int, size int")
    offsets = rows.groupBy("doc_id", "k").agg(F.count("*").alias("c")).withColumn("off", F.sum("c").over(Window.partitionBy("doc_id").orderBy("k")) - F.col("c")).drop("c")
    placed = local.join(offsets, ["doc_id", "k"]).withColumn("core", F.col("off") + F.col("s"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("core")) - 1
    start = F.greatest(F.lit(0), F.col("core") - overlap)
    return placed.select("doc_id", number.alias("piece_no"), start.alias("start_pos"), (F.col("off") + F.col("e")).alias("end_pos"), (F.col("off") + F.col("e") - start).cast("int").alias("n_blocks"))

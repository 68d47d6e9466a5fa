"""Headers, footers, footnote zones and columns.

Exact recurrence is a grouped count. Fuzzy recurrence follows the reference semantics (first matching group by
its first key) and is folded per file over *distinct* keys only, so a large file contributes few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import geometry as G
from foliospark.functions import text as T


def band_blocks(blocks: DataFrame, pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Blocks (doc_id, page, block_no, text, box) in a header or footer band, with band and key."""
    sizes = pages.select("doc_id", "page", "width", "height").distinct().where("height > 0")
    b = blocks.join(sizes, ["doc_id", "page"])
    top = F.col("y1") <= F.col("height") * cfg.header_band
    bottom = F.col("y0") >= F.col("height") - F.col("height") * cfg.footer_band
    return b.withColumn("band", F.when(top, "header").when(bottom, "footer")).where("band is not null").withColumn("key", T.recurrence_key(F.col("text")))


def _rates(bands: DataFrame, groups: DataFrame, cfg: Config) -> DataFrame:
    """(doc_id, band, group) of groups on enough of the eligible pages."""
    eligible = bands.groupBy("doc_id", "band").agg(F.countDistinct("page").alias("eligible"))
    hits = groups.groupBy("doc_id", "band", "group").agg(F.countDistinct("page").alias("pages"))
    return hits.join(eligible, ["doc_id", "band"]).where(F.col("pages") / F.greatest(F.lit(1), F.col("eligible")) >= cfg.repetition)


def recurrent_exact(bands: DataFrame, n_pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Band blocks whose key recurs on enough eligible pages. n_pages: (doc_id, pages) of every file."""
    long_ = n_pages.where(F.col("pages") >= cfg.min_repeat_pages).select("doc_id")
    b = bands.join(long_, "doc_id")
    keyed = b.where(F.char_length("key") >= 4).withColumn("group", F.col("key"))
    return keyed.join(_rates(b, keyed, cfg).select("doc_id", "band", "group"), ["doc_id", "band", "group"], "left_semi").drop("group")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), with a bit-parallel LCS."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    state, full = 0, (1 << len(a)) - 1
    for c in b:
        x = masks.get(c, 0) | state
        state = x & ~(x - ((state << 1) | 1)) & full
    return 200.0 * bin(state).count("1") / (len(a) + len(b))


def first_match_groups(keys: list[str], similarity: float) -> list[int]:
    """Group of every key, in order: the first group whose first key is similar enough, else a new one."""
    heads: list[str] = []
    out = []
    for k in keys:
        for g, h in enumerate(heads):
            longest = max(len(k), len(h)) or 1
            if 200.0 * min(len(k), len(h)) / (len(k) + len(h) or 1) >= similarity and longest and indel_ratio(k, h) >= similarity:
                out.append(g)
                break
        else:
            heads.append(k)
            out.append(len(heads) - 1)
    return out


def recurrent_fuzzy(bands: DataFrame, n_pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """As recurrent_exact, with keys grouped by similarity in page and block order."""
    long_ = n_pages.where(F.col("pages") >= cfg.min_repeat_pages).select("doc_id")
    b = bands.join(long_, "doc_id")
    keyed = b.where(F.char_length("key") >= 4)
    first = keyed.groupBy("doc_id", "band", "key").agg(F.min(F.struct("page", "block_no")).alias("at"))
    per = first.groupBy("doc_id", "band").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("keys"))  # distinct masked keys at page edges

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, band, keys in zip(pdf["doc_id"], pdf["band"], pdf["keys"]):
                ks = [k["key"] for k in keys]
                rows += [(doc, band, k, g) for k, g in zip(ks, first_match_groups(ks, cfg.similarity))]
            yield pd.DataFrame(rows, columns=["doc_id", "band", "key", "group"])

    groups = per.mapInPandas(fold, "doc_id string, band string, key string, group int")
    hit = keyed.join(groups, ["doc_id", "band", "key"])
    return hit.join(_rates(b, hit, cfg).select("doc_id", "band", "group"), ["doc_id", "band", "group"], "left_semi").drop("group")


def boilerplate(recurrent: DataFrame) -> DataFrame:
    """(doc_id, page, boilerplate_chars, header_text, footer_text) of pages with recurring blocks."""
    pick = lambda band: F.min_by(F.when(F.col("band") == band, F.col("text")), F.when(F.col("band") == band, F.col("block_no")))
    return recurrent.groupBy("doc_id", "page").agg(F.sum("char_count").alias("boilerplate_chars"), pick("header").alias("header_text"), pick("footer").alias("footer_text"))


def discarded(recurrent: DataFrame) -> DataFrame:
    """Distinct discarded texts by key in first-seen order: (doc_id, band, ord, text)."""
    from pyspark.sql import Window

    first = recurrent.groupBy("doc_id", "band", "key").agg(F.min_by("text", F.struct("page", "block_no")).alias("text"), F.min(F.struct("page", "block_no")).alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "band").orderBy("at"))).select("doc_id", "band", "ord", "text")


def median_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.where("size > 0").groupBy("doc_id").agg(F.median("size").alias("median_size"))


def footnote_separators(rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, separator): topmost short horizontal ruling in the lower part of the page."""
    sizes = pages.select("doc_id", "page", "width", "height").distinct()
    length = F.abs(F.col("end") - F.col("start"))
    fits = (F.col("pos") >= 0.62 * F.col("height")) & length.between(0.12 * F.col("width"), 0.55 * F.col("width"))
    return rulings.where("axis = 'h'").join(sizes, ["doc_id", "page"]).where(fits).groupBy("doc_id", "page").agg(F.min("pos").alias("separator"))


def footnote_zones(blocks: DataFrame, pages: DataFrame, separators: DataFrame | None = None) -> DataFrame:
    """blocks with footnote_zone: below the separator, or visibly smaller than the file's median and low on the page."""
    sizes = pages.select("doc_id", "page", "height").distinct()
    b = blocks.join(sizes, ["doc_id", "page"], "left").join(median_sizes(blocks), "doc_id", "left")
    b = b.join(separators, ["doc_id", "page"], "left") if separators is not None else b.withColumn("separator", F.lit(None).cast("double"))
    low = (F.col("size") > 0) & (F.col("size") <= 0.86 * F.col("median_size")) & (F.col("y0") >= 0.72 * F.col("height"))
    return b.withColumn("footnote_zone", F.coalesce(F.col("y0") >= F.col("separator") - 1, F.lit(False)) | F.coalesce(low, F.lit(False))).drop("separator", "median_size", "height")


GUTTERS = [0.44, 0.46, 0.48, 0.50, 0.52, 0.54, 0.56]


def columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, gutter) of pages in two columns: the first central gutter no block crosses, with balanced sides."""
    edges = blocks.where("char_count > 0").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("x0").alias("l"), F.max("x1").alias("r")).where("n >= 6 and r > l")
    tried = edges.withColumn("frac", F.explode(F.array(*map(F.lit, GUTTERS)))).withColumn("x", F.col("l") + (F.col("r") - F.col("l")) * F.col("frac"))
    j = blocks.where("char_count > 0").join(tried.select("doc_id", "page", "frac", "x"), ["doc_id", "page"])
    per = j.groupBy("doc_id", "page", "frac", "x").agg(F.count_if((F.col("x0") < F.col("x")) & (F.col("x") < F.col("x1"))).alias("crossing"), F.count_if(F.col("x1") <= F.col("x")).alias("left_n"), F.count_if(F.col("x0") >= F.col("x")).alias("right_n"))
    good = per.where((F.col("crossing") == 0) & (F.col("left_n") >= 3) & (F.col("right_n") >= 3) & (F.least("left_n", "right_n") / F.greatest("left_n", "right_n") >= 0.35))
    return good.groupBy("doc_id", "page").agg(F.min_by("x", "frac").alias("gutter"))


def with_columns(blocks: DataFrame) -> DataFrame:
    """blocks with col: 0 or 1 by the page's gutter, 0 on single-column pages."""
    return blocks.join(columns(blocks), ["doc_id", "page"], "left").withColumn("col", F.when(F.col("gutter").isNotNull() & (G.cx() >= F.col("gutter")), 1).otherwise(0)).drop("gutter")

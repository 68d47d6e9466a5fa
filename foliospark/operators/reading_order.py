"""Reading order, stitching across pages, captions and page breaks over typed blocks.

Blocks are (doc_id, block_id, page, seq, kind, text, style, col, box, ...). Work is keyed by file and page: neighbours
meet by window over the order of a file or by joins of adjacent pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import geometry as G
from foliospark.functions import text as T


def order_key() -> list[Column]:
    """Page, column, footnotes last, top and left edge to 0.1; seq and id settle ties."""
    col = F.coalesce("col", F.lit(0))
    return [F.col("page"), col, (F.col("kind") == "footnote").cast("int"), F.bround("y0", 1), F.bround("x0", 1), F.col("seq"), F.col("block_id")]


def reading_order(blocks: DataFrame) -> DataFrame:
    """Distinct blocks with ord, their 0-based place in the file.

    Places are counted page by page and added up, so no file is sorted in one task."""
    b = blocks.distinct()
    b = b if "col" in b.columns else b.withColumn("col", F.lit(0))
    return place_in_file(b, order_key()[1:]).withColumnRenamed("pos", "ord")


def place_in_file(df: DataFrame, order: list) -> DataFrame:
    """df with pos, its 0-based place in the file by page and order: counted per page, then added up."""
    inner = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)) - 1
    per = df.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    before = per.withColumn("__before", F.sum("n").over(Window.partitionBy("doc_id").orderBy("page")) - F.col("n")).drop("n")
    return df.withColumn("__i", inner).join(before, ["doc_id", "page"]).withColumn("pos", F.col("__i") + F.col("__before")).drop("__i", "__before")


def with_previous(ordered: DataFrame, col: str, name: str) -> DataFrame:
    """ordered with name: col of the block before it in the file, over page ends; only page rows are sorted per file."""
    inside = F.lag(col).over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) == 1
    ends = ordered.groupBy("doc_id", "page").agg(F.max_by(col, "ord").alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy("doc_id").orderBy("page")))
    return ordered.withColumn("__first", first).withColumn("__in", inside).join(ends, ["doc_id", "page"]).withColumn(name, F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__in"))).drop("__first", "__in", "__end")


def paragraph_links(ordered: DataFrame) -> DataFrame:
    """(doc_id, ord, next_ord): paragraphs at the end of a page that go on in the first block of the next.

    Last and first blocks of adjacent pages meet by a join, so no file is sorted for it."""
    row = F.struct("kind", "style", F.coalesce("text", F.lit("")).alias("text"), "ord")
    ends = ordered.groupBy("doc_id", "page").agg(F.max_by(row, "ord").alias("l"), F.min_by(row, "ord").alias("f"))
    nxt = ends.select("doc_id", (F.col("page") - 1).alias("page"), F.col("f").alias("n"))
    j = ends.join(nxt, ["doc_id", "page"])
    left, right = T.strip(F.col("l.text")), T.strip(F.col("n.text"))
    ok = (F.col("l.kind") == "paragraph") & (F.col("n.kind") == "paragraph") & F.col("l.style").eqNullSafe(F.col("n.style")) & (left != "") & (right != "") & ~left.rlike(T.COMPLETE_END) & right.rlike(T.CONTINUES)
    return j.where(ok).select("doc_id", F.col("l.ord").alias("ord"), F.col("n.ord").alias("next_ord"))


def stitch_paragraphs(ordered: DataFrame, dehyphenate: Column | bool = False, chain: bool = False) -> DataFrame:
    """Blocks with continued paragraphs joined; pieces has the pages a text came from.

    Without chain a paragraph takes at most one continuation, as its page does not advance; with chain any number.
    Only linked blocks are regrouped, all others pass through."""
    links = paragraph_links(ordered)
    w = Window.partitionBy("doc_id").orderBy("ord")  # links only: at most one a page
    linked = links.withColumn("__prev", F.lag("next_ord").over(w)).withColumn("cont", F.coalesce(F.col("__prev") == F.col("ord"), F.lit(False)))
    runs = linked.withColumn("run", F.sum((~F.col("cont")).cast("int")).over(w).cast("string"))
    runs = runs.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("ord")) - 1)
    taken = runs if chain else runs.where("k % 2 = 0").withColumn("run", F.concat_ws("-", "run", F.col("k").cast("string")))
    ends = taken.select("doc_id", F.col("next_ord").alias("ord"), "run").unionByName(taken.select("doc_id", "ord", "run")).distinct()
    hyph = F.lit(dehyphenate) if isinstance(dehyphenate, bool) else dehyphenate

    def join(acc: Column, x: Column) -> Column:
        a, t = F.regexp_replace(acc, f"{T.WS}+$", ""), F.regexp_replace(x["t"], f"^{T.WS}+", "")
        return F.when(acc.isNull(), x["t"]).when(a.endswith("-") & hyph & t.rlike("^\\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), t)).when(a.endswith("-"), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t))

    b = ordered.join(ends, ["doc_id", "ord"])
    parts = b.groupBy("doc_id", "run").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "page", F.coalesce("text", F.lit("")).alias("t")))).alias("parts"), F.min("confidence").alias("low"))
    parts = parts.select("doc_id", "ord", F.aggregate("parts", F.lit(None).cast("string"), join).alias("__text"), F.transform("parts", lambda x: x["page"]).alias("pieces"), "low")
    heads = ordered.join(parts, ["doc_id", "ord"]).withColumn("text", F.col("__text")).withColumn("confidence", F.col("low")).drop("__text", "low")
    rest = ordered.join(ends.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").withColumn("pieces", F.array("page"))
    return heads.unionByName(rest)


def page_breaks(ordered: DataFrame) -> DataFrame:
    """Blocks with a page_break row before the first block of every page but the file's first."""
    kept = ordered.where("kind <> 'page_break'")
    firsts = kept.groupBy("doc_id", "page").agg(F.min("ord").alias("ord"))
    later = firsts.withColumn("pp", F.lag("page").over(Window.partitionBy("doc_id").orderBy("page"))).where("pp is not null")
    marks = later.select("doc_id", F.format_string("pb%05d", "page").alias("block_id"), "page", (F.col("ord") - 0.5).alias("ord"), F.lit("page_break").alias("kind"), F.concat(F.lit("página "), F.col("page").cast("string")).alias("text"))
    return kept.withColumn("ord", F.col("ord").cast("double")).unionByName(marks, allowMissingColumns=True)


def nearest_captions(figures: DataFrame, texts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, page, block_id, caption_id, caption, distance): the nearest caption text below or above each figure.

    On equal distance the later text wins. Each text goes to one figure, the first that takes it."""
    t = texts.where((F.char_length(T.strip(F.col("text"))).between(1, cfg.caption_chars)) & F.col("text").rlike(T.CAPTION) & F.col("y0").isNotNull())
    t = t.select("doc_id", "page", F.col("block_id").alias("caption_id"), F.col("seq").alias("caption_seq"), T.collapse(F.col("text")).alias("caption"), *[F.col(c).alias("t_" + c) for c in ("x0", "y0", "x1", "y1")])
    f = figures.where("y0 is not null").select("doc_id", "page", "block_id", "seq", "x0", "y0", "x1", "y1")
    j = f.join(t, ["doc_id", "page"]).where(F.least("x1", "t_x1") - F.greatest("x0", "t_x0") > 0)
    below, above = F.col("t_y0") - F.col("y1"), F.col("y0") - F.col("t_y1")
    j = j.withColumn("distance", F.when(below >= 0, below).when(above >= 0, above)).where(F.col("distance") <= cfg.caption_distance)
    pick = j.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page", "block_id").orderBy("distance", F.desc("caption_seq"), F.desc("caption_id")))).where("r = 1")
    once = pick.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "caption_id").orderBy("seq", "block_id"))).where("r = 1")
    return once.select("doc_id", "page", "block_id", "caption_id", "caption", "distance")


def orphan_captions(ordered: DataFrame) -> DataFrame:
    """(doc_id, figure_id, caption_id, caption): short body paragraphs right below a figure without a caption."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    cols = ["block_id", "kind", "page", "style", "text", "y0"]
    n = ordered.select("doc_id", "ord", "kind", "block_id", "page", "y1", *[F.lead(c).over(w).alias("n_" + c) for c in cols])
    gap = F.col("n_y0") - F.col("y1")
    ok = (F.col("kind") == "figure") & (F.col("n_kind") == "paragraph") & (F.col("n_page") == F.col("page")) & (F.char_length("n_text") <= 200) & (F.col("n_style") == "body") & gap.between(0, 24)
    return n.where(ok).select("doc_id", F.col("block_id").alias("figure_id"), F.col("n_block_id").alias("caption_id"), F.col("n_text").alias("caption"))


def table_links(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, block_id, next_id, page): the last table of a page and the first of the next, equal in columns, near foot and top."""
    sizes = pages.select("doc_id", "page", "height").distinct().where("height is not null")
    t = tables.where("y0 is not null and y1 is not null").join(sizes, ["doc_id", "page"])
    s = F.struct("block_id", "n_cols", "y0", "y1", "height")
    ends = t.groupBy("doc_id", "page").agg(F.max_by(s, F.struct("y1", "seq")).alias("last"), F.min_by(s, F.struct("y0", "seq")).alias("first"))
    nxt = ends.select("doc_id", (F.col("page") - 1).alias("page"), F.col("first").alias("nx"))
    j = ends.join(nxt, ["doc_id", "page"])
    ok = (F.col("last.n_cols") == F.col("nx.n_cols")) & (F.col("last.n_cols") > 0) & (F.col("last.y1") >= 0.78 * F.col("last.height")) & (F.col("nx.y0") <= 0.28 * F.col("nx.height"))
    return j.where(ok).select("doc_id", F.col("last.block_id").alias("block_id"), F.col("nx.block_id").alias("next_id"), "page")


def chain_tables(tables: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, block_id, chain_id): tables of one chain share the id of its first part.

    Each part keeps its own box, so a chain runs over pages p, p + 1, ... and is an island of consecutive pages."""
    w = Window.partitionBy("doc_id").orderBy("page", "block_id")
    l = links.withColumn("pn", F.lag("next_id").over(w)).withColumn("new", (~F.coalesce(F.col("pn") == F.col("block_id"), F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(w))
    head = l.withColumn("chain_id", F.first("block_id").over(Window.partitionBy("doc_id", "island").orderBy("page")))
    member = head.select("doc_id", "block_id", "chain_id").unionByName(head.select("doc_id", F.col("next_id").alias("block_id"), "chain_id")).distinct()
    return tables.select("doc_id", "block_id").join(member, ["doc_id", "block_id"], "left").withColumn("chain_id", F.coalesce("chain_id", "block_id"))


def point_in_blocks(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, n_spans, n_chars): spans whose centre lies in a block's box; pages meet by key, boxes by range."""
    s = spans.where("y0 is not null").select("doc_id", "page", G.cx().alias("sx"), G.cy().alias("sy"), F.char_length("text").alias("n"))
    b = blocks.where("y0 is not null").select("doc_id", "page", "block_id", "x0", "y0", "x1", "y1")
    hit = b.join(s, ["doc_id", "page"]).where(F.col("sx").between(F.col("x0"), F.col("x1")) & F.col("sy").between(F.col("y0"), F.col("y1")))
    return hit.groupBy("doc_id", "block_id").agg(F.count("*").alias("n_spans"), F.sum("n").alias("n_chars"))

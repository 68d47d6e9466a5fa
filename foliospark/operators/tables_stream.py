"""Borderless tables: visual lines, gaps, runs of aligned lines, columns and confidence. All windows and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators.rulings import cluster
from foliospark.runtime import cut

PAGE = ["doc_id", "page"]
B = ["x0", "y0", "x1", "y1"]


def usable_words(words: DataFrame, exclude: DataFrame | None = None, share: float = 0.5) -> DataFrame:
    """Distinct non-blank words with a full box, without those mostly inside an excluded box (doc_id, page, box)."""
    w = words.distinct().where((T.strip(F.coalesce("text", F.lit(""))) != "") & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    if exclude is None:
        return w
    e = exclude.select(*PAGE, *[F.col(c).alias("e_" + c) for c in B])
    return w.join(e, (w["doc_id"] == e["doc_id"]) & (w["page"] == e["page"]) & G.contained("", "e_", share), "left_anti")


def visual_lines(words: DataFrame, overlap: float = 0.5) -> DataFrame:
    """words with line: words in order of (centre to 0.1, left edge) share a line while they overlap the word before."""
    w = Window.partitionBy(*PAGE).orderBy("cyr", "x0", "word_no")
    s = words.withColumn("cyr", F.bround(G.cy(), 1))
    s = s.withColumns({f"p_{c}": F.lag(c).over(w) for c in B})
    new = F.when(F.col("p_y0").isNotNull() & (G.vertical_overlap("", "p_") < overlap), 1).otherwise(0)
    return s.withColumn("line", F.sum(new).over(w)).drop("cyr", *[f"p_{c}" for c in B])


def line_gaps(lined: DataFrame) -> DataFrame:
    """Gap after every word of a line: (doc_id, page, line, word_no, gap, mid)."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x0", "word_no")
    nxt = F.lead("x0").over(w)
    return lined.select(*PAGE, "line", "word_no", (nxt - F.col("x1")).alias("gap"), ((F.col("x1") + nxt) / 2).alias("mid")).where("gap is not null")


def median_spaces(gaps: DataFrame) -> DataFrame:
    """(doc_id, page, space): median of the word spaces between 0 and 40 points; 2 where there is none."""
    return gaps.groupBy(*PAGE).agg(F.coalesce(F.median(F.when((F.col("gap") > 0) & (F.col("gap") < 40), F.col("gap"))), F.lit(2.0)).alias("space"))


def runs(lined: DataFrame, cfg: Config = DEFAULT, min_lines: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lines of candidate runs with run, wide gaps with page thresholds)."""
    gaps = line_gaps(lined)
    limits = median_spaces(gaps).select(*PAGE, F.greatest(F.lit(cfg.min_gap), F.col("space") * cfg.gap_factor).alias("threshold"), F.greatest(F.lit(6.0), F.col("space") * 3).alias("tolerance"))
    wide = gaps.join(limits, PAGE).where(F.col("gap") >= F.col("threshold"))
    n_gaps = wide.groupBy(*PAGE, "line").agg(F.count("*").alias("n_gaps"))
    lines = lined.groupBy(*PAGE, "line").agg(*G.envelope(), F.count("*").alias("n_words")).join(n_gaps, [*PAGE, "line"], "left").na.fill(0, ["n_gaps"])
    w = Window.partitionBy(*PAGE).orderBy("line")
    tall = F.last(F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = F.coalesce((F.col("y0") - F.lag("y1").over(w)) <= tall * 2.2, F.lit(True))
    lines = lines.withColumn("candidate", F.col("n_gaps") >= cfg.table_min_cols - 1).withColumn("near", near)
    lines = lines.withColumn("run", F.sum(F.when(F.col("candidate") & F.col("near"), 0).otherwise(1)).over(w)).where("candidate")
    sizes = lines.groupBy(*PAGE, "run").agg(F.count("*").alias("run_lines")).where(F.col("run_lines") >= min_lines)
    return lines.join(sizes, [*PAGE, "run"]), wide


def stream_tables(words: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of borderless tables: tables (doc_id, page, run, n_rows, n_cols, fill, stability, misplaced, confidence, box)."""
    min_lines = max(3, cfg.table_min_rows + 1)
    lined = cut(visual_lines(words))
    run, wide = runs(lined, cfg, min_lines)
    run = cut(run)
    key = [*PAGE, "run"]
    mids = wide.join(run.select(*PAGE, "line", "run"), [*PAGE, "line"]).select(*key, "mid", "tolerance")
    w = Window.partitionBy(*key).orderBy("mid")
    mids = mids.withColumn("c", F.sum(F.when(F.col("mid") - F.lag("mid").over(w) > F.col("tolerance"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = mids.groupBy(*key, "c").agg(F.avg("mid").alias("position"), F.count("*").alias("n"))
    box = run.groupBy(*key).agg(F.count("*").alias("n_lines"), *G.envelope())
    kept = clusters.join(box.select(*key, "n_lines"), key).where(F.col("n") / F.col("n_lines") >= cfg.stability)
    seps = kept.groupBy(*key).agg(F.array_sort(F.collect_list("position")).alias("seps"), F.avg(F.col("n") / F.col("n_lines")).alias("stability"))
    seps = seps.where(F.size("seps") >= cfg.table_min_cols - 1)
    placed = lined.join(seps.select(*PAGE).distinct(), PAGE, "left_semi").join(run.select(*PAGE, "line", "run"), [*PAGE, "line"]).join(seps, key).join(box.select(*key, F.col("x0").alias("bx0"), F.col("x1").alias("bx1")), key)
    c = G.cx()
    inside = (c >= F.col("bx0") - 1) & (c < F.col("bx1") + 1)
    col = F.when(inside, F.size(F.filter("seps", lambda s: s <= c))).otherwise(F.size("seps"))
    placed = placed.withColumn("col", col).withColumn("out", ~inside)
    cells = placed.groupBy(*key, "line", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.count_if("out").alias("out"))
    recognised = placed.where("from_ocr").groupBy(*key).agg(F.avg("confidence").alias("ocr"))
    per = cells.groupBy(*key).agg(F.count("*").alias("filled"), F.sum("out").alias("misplaced"))
    t = box.join(seps, key).join(per, key).join(recognised, key, "left").withColumn("n_cols", F.size("seps") + 1)
    t = t.withColumn("fill", F.col("filled") / (F.col("n_lines") * F.col("n_cols"))).where("fill >= 0.45")
    conf = F.col("stability") * 0.45 + F.col("fill") * 0.30 + 0.10 + F.when(F.col("n_lines") >= 4, 0.05).otherwise(0.0) - F.when(F.col("misplaced") > 0, F.least(F.lit(0.15), F.col("misplaced") * 0.02)).otherwise(0.0)
    conf = conf * F.coalesce(F.col("ocr") * 0.5 + 0.5, F.lit(1.0))
    tables = t.select(*key, F.col("n_lines").alias("n_rows"), "n_cols", "fill", "stability", "misplaced", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.88), conf)), 4).alias("confidence"), *B)
    row = F.dense_rank().over(Window.partitionBy(*key).orderBy("line")) - 1
    return tables, cells.join(tables.select(*key), key, "left_semi").withColumn("row", row).drop("line", "out")


__all__ = ["cluster", "line_gaps", "median_spaces", "runs", "stream_tables", "usable_words", "visual_lines"]

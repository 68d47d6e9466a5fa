"""Bordered tables: cells with merges, their text, alignment, header rows and confidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators.rulings import closed_ratio
from foliospark.runtime import cut

TABLE = ["doc_id", "page", "grid"]


def span_growth(rows: list[float], cols: list[float], h: list, v: list, tol: float) -> list[tuple]:
    """(row, col, rowspan, colspan, x0, y0, x1, y1) of every cell, row by row; covered cells have spans of 0."""

    def bordered(segments: list, at: float, a: float, b: float) -> bool:
        return b <= a or any(abs(s["pos"] - at) <= tol and (min(s["end"], b) - max(s["start"], a)) / (b - a) >= 0.6 for s in segments)

    n, m, covered, out = len(rows) - 1, len(cols) - 1, set(), []
    for i in range(n):
        for j in range(m):
            if (i, j) in covered:
                out.append((i, j, 0, 0, cols[j], rows[i], cols[j + 1], rows[i + 1]))
                continue
            right = j + 1
            while right < m and not bordered(v, cols[right], rows[i], rows[i + 1]):
                right += 1
            below = i + 1
            while below < n and not bordered(h, rows[below], cols[j], cols[right]):
                below += 1
            covered |= {(a, b) for a in range(i, below) for b in range(j, right)} - {(i, j)}
            out.append((i, j, below - i, right - j, cols[j], rows[i], cols[right], rows[below]))
    return out


def cells(grids: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per cell: row, col, rowspan, colspan (0 where covered) and box."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, p, g, *c) for d, p, g, r, c_, h, v in zip(*(pdf[x] for x in ("doc_id", "page", "grid", "rows", "cols", "h", "v"))) for c in span_growth(list(r), list(c_), list(h), list(v), cfg.snap)]
            yield pd.DataFrame(out, columns=["doc_id", "page", "grid", "row", "col", "rowspan", "colspan", "x0", "y0", "x1", "y1"])

    return grids.select(*TABLE, "rows", "cols", "h", "v").mapInPandas(grow, "doc_id string, page int, grid int, row int, col int, rowspan int, colspan int, x0 double, y0 double, x1 double, y1 double")


def spans_in_cells(cell: DataFrame, spans: DataFrame) -> DataFrame:
    """Non-blank spans (text, box) whose centre lies in a cell; a centre on a shared border is in both."""
    s = spans.where((T.strip(F.coalesce("text", F.lit(""))) != "") & F.col("y0").isNotNull())
    s = s.select("doc_id", "page", "text", *[F.col(c).alias("s_" + c) for c in ("x0", "y0", "x1", "y1")], *[F.col(c) for c in ("bold", "confidence") if c in spans.columns])
    inside = G.cx("s_").between(F.col("x0"), F.col("x1")) & G.cy("s_").between(F.col("y0"), F.col("y1"))
    return cell.where("rowspan > 0").join(s, ["doc_id", "page"]).where(inside)


def cell_texts(cell: DataFrame, spans: DataFrame) -> DataFrame:
    """(table, row, col, text): spans in visual lines, joined without a space inside a line and by one between lines."""
    key = [*TABLE, "row", "col"]
    s = spans_in_cells(cell, spans).withColumn("cyr", F.bround(G.cy("s_"), 1))
    w = Window.partitionBy(*key).orderBy("cyr", "s_x0", "s_x1", "text")
    prev = {f"p_{c}": F.lag(f"s_{c}").over(w) for c in ("x0", "y0", "x1", "y1")}
    s = s.withColumns(prev)
    s = s.withColumn("line", F.sum(F.when(F.col("p_y0").isNotNull() & (G.vertical_overlap("s_", "p_") < 0.45), 1).otherwise(0)).over(w))
    lines = s.groupBy(*key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_x0", "s_x1", "text"))), lambda x: x["text"]), "").alias("t"))
    lines = lines.withColumn("t", T.strip(F.col("t"))).where("t <> ''")
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("text"))


def cell_alignment(cell: DataFrame, spans: DataFrame) -> DataFrame:
    """(table, row, col, align) of cells holding text."""
    s = spans_in_cells(cell, spans).groupBy(*TABLE, "row", "col", "x0", "x1").agg(F.min("s_x0").alias("l"), F.max("s_x1").alias("r"))
    left, right = F.col("l") - F.col("x0"), F.col("x1") - F.col("r")
    ratio = left / (left + right)
    centred = ratio.between(0.38, 0.62) & (F.least(left, right) > (F.col("x1") - F.col("x0")) * 0.08)
    return s.where("x1 > x0").select(*TABLE, "row", "col", F.when(left + right <= 0, "left").when(ratio > 0.62, "right").when(centred, "center").otherwise("left").alias("align"))


def column_alignment(texts: DataFrame, aligned: DataFrame) -> DataFrame:
    """(table, col, align): right for numeric columns, else the vote of the cells, ties in the order left, center, right."""
    numeric = texts.groupBy(*TABLE, "col").agg((F.count_if(T.looks_numeric(F.col("text"))) / F.count("*")).alias("numeric"))
    votes = aligned.groupBy(*TABLE, "col", "align").agg(F.count("*").alias("n"))
    prio = F.when(F.col("align") == "left", 2).when(F.col("align") == "center", 1).otherwise(0)
    best = votes.groupBy(*TABLE, "col").agg(F.max_by("align", F.struct("n", prio)).alias("vote"))
    return numeric.join(best, [*TABLE, "col"], "left").select(*TABLE, "col", F.when(F.col("numeric") >= 0.7, "right").otherwise(F.coalesce("vote", F.lit("left"))).alias("align"))


def header_rows(texts: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(table, header_rows): 1 where the first row has no number but later rows do, or where its text is mostly bold."""
    num = T.looks_numeric(F.col("text"))
    per = texts.groupBy(*TABLE).agg(F.max("row").alias("last"), F.count_if(F.col("row") == 0).alias("firsts"), F.count_if(num & (F.col("row") == 0)).alias("f"), F.count_if(num & (F.col("row") > 0)).alias("r"))
    sure = (F.col("last") > 0) & (F.col("firsts") > 0)
    if spans is None:
        return per.select(*TABLE, F.when(sure & (F.col("f") == 0) & (F.col("r") > 0), 1).otherwise(0).alias("header_rows"))
    first = texts.where("row = 0").select(*TABLE, F.col("text").alias("cell"))
    s = spans.withColumn("t", T.strip(F.coalesce("text", F.lit("")))).where("t <> ''").select("doc_id", "page", "block_no", "line_no", "span_no", "t", "bold")
    used = first.join(s, ["doc_id", "page"]).where(F.col("cell").contains(F.col("t"))).drop("cell").distinct()
    weight = used.groupBy(*TABLE).agg((F.sum(F.when(F.col("bold"), F.char_length("t")).otherwise(0)) / F.sum(F.char_length("t"))).alias("bold"))
    j = per.join(weight, TABLE, "left")
    return j.select(*TABLE, F.when(sure & (((F.col("f") == 0) & (F.col("r") > 0)) | (F.coalesce("bold", F.lit(0.0)) >= 0.6)), 1).otherwise(0).alias("header_rows"))


def grid_confidence(closed: Column, fill: Column, rows: Column, cols: Column, merged: Column, ocr: Column) -> Column:
    """0..1 from closed borders, filled cells, size, merges and recognition confidence (null: native text)."""
    base = closed * 0.55 + fill * 0.30 + F.when((rows >= 2) & (cols >= 2), 0.15).otherwise(0.0)
    base = base * F.when(merged, 0.80).otherwise(1.0) * F.coalesce(ocr * 0.5 + 0.5, F.lit(1.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 4)


def review_notes(closed: Column, fill: Column, rows: Column, cols: Column, merged: Column, ocr: Column) -> Column:
    pct = lambda c: F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    return F.array_compact(
        F.array(
            F.when(~((rows >= 2) & (cols >= 2)), "tabela com dimensões mínimas"), F.when(fill < 0.5, F.concat(F.lit("mais da metade das células vazias ("), pct(1 - fill), F.lit(")"))),
            F.when(closed < 0.6, "malha de bordas incompleta"), F.when(merged, "contém células mescladas, que o Markdown não representa"),
            F.when(ocr < 0.75, F.concat(F.lit("texto vindo de OCR com confiança média de "), pct(ocr))),
        )
    )


def grid_tables(grids: DataFrame, spans: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per bordered table: size, merges, fill, closed borders, header rows, confidence, review and reasons."""
    grids, spans = cut(grids), cut(spans)
    cell = cut(cells(grids, cfg))
    texts = cut(cell_texts(cell, spans))
    filled = texts.groupBy(*TABLE).agg(F.count("*").alias("filled"))
    shape = cell.groupBy(*TABLE).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count_if(F.col("rowspan") > 0).alias("shown"), F.coalesce(F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)), F.lit(False)).alias("merged"))
    g = grids.select(*TABLE, "x0", "y0", "x1", "y1", closed_ratio().alias("closed"))
    t = g.join(shape, TABLE).join(filled, TABLE, "left").join(header_rows(texts, spans), TABLE, "left").na.fill(0, ["filled", "header_rows"])
    t = t.withColumn("fill", F.col("filled") / F.greatest("shown", F.lit(1))).withColumn("ocr", F.lit(None).cast("double"))
    args = [F.col(c) for c in ("closed", "fill", "n_rows", "n_cols", "merged", "ocr")]
    t = t.withColumn("confidence", grid_confidence(*args)).withColumn("notes", review_notes(*args))
    low = F.when(F.col("confidence") < cfg.table_confidence, F.concat(F.lit("confiança de apenas "), F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%")))
    reasons = F.array_distinct(F.concat(F.array_compact(F.array(low, F.when(F.col("merged"), "contém células mescladas, que o Markdown não representa"))), "notes"))
    review = (F.col("confidence") < cfg.table_confidence) | F.col("merged")
    kept = t.where((F.col("n_rows") >= cfg.table_min_rows) & (F.col("n_cols") >= cfg.table_min_cols))
    return kept.select(*TABLE, F.lit("lines").alias("engine"), "n_rows", "n_cols", "merged", "fill", "closed", "header_rows", "confidence", review.alias("needs_review"), F.when(review, F.array_join(reasons, "; ")).alias("review_reason"), "x0", "y0", "x1", "y1")


def best_engine(candidates: DataFrame) -> DataFrame:
    """Of tables of one region, the first engine unless another is strictly more confident: (region columns, engine_order, confidence)."""
    return candidates.withColumn("r", F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc("confidence"), "engine_order"))).where("r = 1").drop("r")


def fallback_confidence(rows: Column, accuracy: Column) -> Column:
    """Confidence of a reserve engine's rows (array of arrays of text); null where fewer than 2 rows or columns remain."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    filled = F.aggregate(clean, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c != "")))
    conf = F.least(F.lit(0.95), F.coalesce(accuracy / 100, F.lit(0.7)) * 0.6 + filled / (F.size(clean) * width) * 0.4)
    return F.when((F.size(clean) >= 2) & (width >= 2), F.round(conf, 4))

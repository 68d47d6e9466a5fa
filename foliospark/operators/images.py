"""Images and drawn figures: size filters, slices of one picture, clusters of drawings, names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import DEFAULT, Config
from foliospark.functions import geometry as G

PAGE = ["doc_id", "page"]


def size_filter(images: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Placements above a point each way whose pixels are enough; 0 by 0 pixels are unknown and pass."""
    w, h = F.coalesce("px_w", F.lit(0)), F.coalesce("px_h", F.lit(0))
    big = ((w == 0) & (h == 0)) | ((w >= cfg.image_min_side) & (h >= cfg.image_min_side) & (w * h >= cfg.image_min_area))
    return images.where((G.width() > 1) & (G.height() > 1) & big)


def distinct_rects(images: DataFrame) -> DataFrame:
    """Placements distinct to 0.1 point: the first xref of each."""
    r = lambda c: F.bround(c, 1)
    return images.groupBy(*PAGE, *[r(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")]).agg(F.min("xref").alias("xref"))


def suppress_scans(images: DataFrame, routed: DataFrame) -> DataFrame:
    """Images without those that are a whole scanned page: the only image of an ocr page, over 85 % of it."""
    per = images.groupBy(*PAGE).agg(F.count("*").alias("n"), F.max(G.area()).alias("a"))
    scans = per.join(routed.where("route = 'ocr'").select(*PAGE, (F.col("width") * F.col("height")).alias("page_area")), PAGE).where((F.col("n") == 1) & (F.col("a") >= 0.85 * F.col("page_area"))).select(*PAGE)
    return images.join(scans, PAGE, "left_anti")


def group_slices(boxes: list[tuple], tol: float = 2.0) -> list[int]:
    """Group of every (x0, y0, x1, y1) in order of (x0 to 0.1, y0): stacked strips of one width belong together."""
    last: list[tuple] = []
    out = []
    for b in boxes:
        for g, a in enumerate(last):
            if abs(b[0] - a[0]) <= tol and abs(b[2] - a[2]) <= tol and abs(b[1] - a[3]) <= tol + 1:
                last[g] = b
                out.append(g)
                break
        else:
            last.append(b)
            out.append(len(last) - 1)
    return out


def cluster_drawings(boxes: list[tuple], grow: float = 12.0) -> list[int]:
    """Cluster of every box in order of (y0, x0): the oldest envelope that, grown on all sides, overlaps it.

    Envelopes are columns of one array, so a box is held against all of them at once."""
    low, high = np.empty((len(boxes), 2)), np.empty((len(boxes), 2))  # envelopes by corner
    labels = np.empty(len(boxes), dtype=int)
    used = 0
    for i, box in enumerate(np.array(boxes, dtype=float).reshape(-1, 4)):
        overlap = ((low[:used] - grow < box[2:]) & (high[:used] + grow > box[:2])).all(axis=1) & (box[2:] > box[:2]).all()
        k = int(overlap.argmax()) if overlap.any() else used
        if k == used:
            low[k], high[k], used = box[:2], box[2:], used + 1
        else:
            low[k], high[k] = np.minimum(low[k], box[:2]), np.maximum(high[k], box[2:])
        labels[i] = k
    return labels.tolist()


def _per_page(boxes: DataFrame, assign, order, name: str) -> DataFrame:
    cols = [*PAGE, name, "x0", "y0", "x1", "y1"]

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), key=order)
        return pd.DataFrame([(*key, g, *b) for g, b in zip(assign(rows), rows)], columns=cols)

    return boxes.select(*PAGE, "x0", "y0", "x1", "y1").groupBy(*PAGE).applyInPandas(fold, f"doc_id string, page int, {name} int, x0 double, y0 double, x1 double, y1 double")


def slices(images: DataFrame) -> DataFrame:
    """(doc_id, page, slice, box, n): pictures put together from strips; the boxes of one page fit in memory."""
    g = _per_page(images, group_slices, lambda b: (round(b[0], 1), b[1], b[2], b[3]), "slice")
    return g.groupBy(*PAGE, "slice").agg(*G.envelope(), F.count("*").alias("n"))


def vector_figures(drawings: DataFrame, pages: DataFrame, images: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Clusters of drawings that are figures: enough drawings, not the page's frame, large enough, not inside an image."""
    d = drawings.where((G.width() >= 4) & (G.height() >= 4))
    per = d.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") >= cfg.vector_min_drawings).select(*PAGE)
    c = _per_page(d.join(per, PAGE), cluster_drawings, lambda b: (b[1], b[0], b[2], b[3]), "cluster").groupBy(*PAGE, "cluster").agg(*G.envelope(), F.count("*").alias("n"))
    sizes = pages.select(*PAGE, (F.col("width") * F.col("height")).alias("page_area")).distinct()
    f = c.join(sizes, PAGE, "left").where((F.col("n") >= cfg.vector_min_drawings) & F.coalesce(G.area() / F.col("page_area") <= 0.9, F.lit(True)) & (G.width() >= 40) & (G.height() >= 40)).drop("page_area")
    if images is None:
        return f
    i = images.select(*PAGE, *[F.col(x).alias("i_" + x) for x in ("x0", "y0", "x1", "y1")])
    return f.join(i, (f["doc_id"] == i["doc_id"]) & (f["page"] == i["page"]) & G.contained("", "i_", 0.8), "left_anti")


def asset_name(page: Column, index: Column, vector: Column) -> Column:
    return F.concat(F.lit("assets/"), F.when(vector, F.format_string("p%03d_fig%03d.png", page, index)).otherwise(F.format_string("p%03d_img%03d.png", page, index)))


def raster_dpi(target_px: Column, width_pt: Column) -> Column:
    return F.greatest(F.lit(150), F.least(F.lit(600), F.bround(target_px / (F.greatest(F.lit(1.0), width_pt) / 72), 0).cast("int")))

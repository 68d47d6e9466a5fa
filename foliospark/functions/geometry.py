"""Box arithmetic as column expressions. A box is a prefix of four columns: x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return F.col(f"{prefix}x0"), F.col(f"{prefix}y0"), F.col(f"{prefix}x1"), F.col(f"{prefix}y1")


def width(p: str = "") -> Column:
    return F.col(f"{p}x1") - F.col(f"{p}x0")


def height(p: str = "") -> Column:
    return F.col(f"{p}y1") - F.col(f"{p}y0")


def cx(p: str = "") -> Column:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2


def cy(p: str = "") -> Column:
    return (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), width(p)) * F.greatest(F.lit(0.0), height(p))


def union(a: str, b: str) -> list[Column]:
    """Envelope of two boxes of one row."""
    return [F.least(f"{a}x0", f"{b}x0").alias("x0"), F.least(f"{a}y0", f"{b}y0").alias("y0"), F.greatest(f"{a}x1", f"{b}x1").alias("x1"), F.greatest(f"{a}y1", f"{b}y1").alias("y1")]


def envelope() -> list[Column]:
    """Envelope of the boxes of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def intersection(a: str, b: str) -> Column:
    """Shared area; boxes that only touch share none."""
    dx = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    dy = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.when((dx <= 0) | (dy <= 0), 0.0).otherwise(dx * dy)


def iou(a: str, b: str) -> Column:
    i = intersection(a, b)
    return F.when(i > 0, i / (area(a) + area(b) - i)).otherwise(0.0)


def contained(a: str, b: str, tolerance: float = 0.85) -> Column:
    """Whether at least tolerance of box a lies in box b."""
    own = area(a)
    return F.when(own > 0, intersection(a, b) / own >= tolerance).otherwise(False)


def vertical_overlap(a: str, b: str) -> Column:
    """Shared height over the smaller height; a height of 0 counts as 1."""
    dy = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    h = lambda p: F.when(height(p) == 0, 1.0).otherwise(height(p))
    return F.when(dy <= 0, 0.0).otherwise(dy / F.least(h(a), h(b)))


def as_struct(p: str = "") -> Column:
    return F.struct(*box(p))

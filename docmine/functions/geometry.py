"""Box arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def centre_x(b: Box) -> Column:
    return (b[0] + b[2]) / F.lit(2.0)


def centre_y(b: Box) -> Column:
    return (b[1] + b[3]) / F.lit(2.0)


def overlaps(a: Box, b: Box) -> Column:
    """Touching edges count."""
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def overlap_area(a: Box, b: Box) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return width * height


def contains_point(b: Box, x: Column, y: Column) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def aspect(w: Column, h: Column) -> Column:
    return F.try_divide(w.cast("double"), h.cast("double"))


def solidity(filled: Column, hull: Column) -> Column:
    return F.when(hull > 0, filled.cast("double") / hull).otherwise(F.lit(0.0))


def in_noise_band(b: Box, page_width: Column) -> Column:
    """Page-number band at the top, line-number gutter left of the page middle."""
    header = (b[1] > 275) & (b[3] < 360)
    gutter = (centre_x(b) > page_width * 0.45) & (centre_x(b) < page_width * 0.50)
    return header | gutter


def is_text_like(w: Column, h: Column, filled: Column, hull: Column) -> Column:
    """Character-sized component: height 5-40, aspect 0.1-5, fills over a quarter of its hull."""
    ratio = aspect(w, h)
    return (h > 5) & (h < 40) & (ratio > 0.1) & (ratio < 5) & (solidity(filled, hull) > 0.25)


def is_structure_region(w: Column, h: Column, n_lines: Column, n_corners: Column) -> Column:
    ratio = aspect(w, h)
    return (
        (w >= 50) & (h >= 50) & (ratio >= 0.1) & (ratio <= 10) & (n_lines > 10) & (n_corners > 10)
    )


def pad(b: Box, left: int = 0, top: int = 0, right: int = 0, bottom: int = 0) -> Box:
    """Grow a box and truncate to whole pixels."""
    return tuple(
        v.cast("int") for v in (b[0] - left, b[1] - top, b[2] + right, b[3] + bottom)
    )

"""Box arithmetic as columns. A box is given by a prefix: the columns <prefix>x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sides(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{s}") for s in ("x1", "y1", "x2", "y2"))


def overlaps(a: str, b: str, axis: str = "both") -> Column:
    """Whether boxes overlap: on "x", on "y" or on both; touching sides don't."""
    ax1, ay1, ax2, ay2 = sides(a)
    bx1, by1, bx2, by2 = sides(b)
    x, y = (ax1 < bx2) & (bx1 < ax2), (ay1 < by2) & (by1 < ay2)
    return {"x": x, "y": y, "both": x & y}[axis]


def includes(a: str, b: str) -> Column:
    """Whether a holds b; equal boxes hold each other."""
    ax1, ay1, ax2, ay2 = sides(a)
    bx1, by1, bx2, by2 = sides(b)
    return (ax1 <= bx1) & (ay1 <= by1) & (ax2 >= bx2) & (ay2 >= by2)


def area(prefix: str) -> Column:
    x1, y1, x2, y2 = sides(prefix)
    return (x2 - x1) * (y2 - y1)


def intersection(a: str, b: str) -> Column:
    ax1, ay1, ax2, ay2 = sides(a)
    bx1, by1, bx2, by2 = sides(b)
    return F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0)) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0))


def iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    return both / (area(a) + area(b) - both)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def ratio(value: Column, size: Column, digits: int = 2) -> Column:
    return F.bround(value / size, digits)


def number_text(x: Column) -> Column:
    """A rounded number as text with at least one decimal: 0.5, 1.0, 0.25."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"(\.\d)0$", "$1")


def ratio_text(values: list[Column], sizes: list[Column]) -> Column:
    """(0.01, 0.14, 0.66, 0.89): coordinates as shares of the image, two digits."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[number_text(ratio(v, s)) for v, s in zip(values, sizes, strict=True)]), F.lit(")"))


def box_ratio_text(prefix: str, width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = sides(prefix)
    return ratio_text([x1, y1, x2, y2], [width, height, width, height])


def thousandths(values: list[Column], sizes: list[Column]) -> Column:
    """[15, 140, 660, 890]: coordinates in thousandths of the image, cut to whole numbers."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[(v / s * 1000).cast("int").cast("string") for v, s in zip(values, sizes, strict=True)]), F.lit("]"))


def box_thousandths(prefix: str, width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = sides(prefix)
    return thousandths([x1, y1, x2, y2], [width, height, width, height])


def square_padded(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Grow the shorter side of a box to the longer, half (rounded down) before it and the rest after."""
    w, h = x2 - x1, y2 - y1
    dx, dy = F.greatest(h - w, F.lit(0)), F.greatest(w - h, F.lit(0))
    left, top = F.floor(dx / 2), F.floor(dy / 2)
    return F.struct((x1 - left).alias("x1"), (y1 - top).alias("y1"), (x2 + dx - left).alias("x2"), (y2 + dy - top).alias("y2"))


def same_point(a: list[Column], b: list[Column], sizes: list[Column]) -> Column:
    """Whether two points are one at the precision of their ratio text."""
    return ratio_text(a, sizes) == ratio_text(b, sizes)

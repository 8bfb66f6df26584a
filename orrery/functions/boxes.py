"""Column expressions over boxes and segments, given as x1, y1, x2, y2 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def _sides(alias: str, suffix: str = "") -> list[Column]:
    return [F.col(f"{alias}.{s}" if alias else f"{s}{suffix}") for s in SIDES]


def area(alias: str = "", suffix: str = "") -> Column:
    x1, y1, x2, y2 = _sides(alias, suffix)
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(a: str, b: str) -> Column:
    """Area that the boxes of two table aliases share."""
    ax1, ay1, ax2, ay2 = _sides(a)
    bx1, by1, bx2, by2 = _sides(b)
    wide, high = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def overlaps(a: str, b: str) -> Column:
    """Whether two boxes share an area: the join condition, strict on every side."""
    ax1, ay1, ax2, ay2 = _sides(a)
    bx1, by1, bx2, by2 = _sides(b)
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def _over(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    """Shared area over joint area; boxes without an area overlap nothing."""
    shared = intersection(a, b)
    return _over(shared, area(a) + area(b) - shared)


def containment(a: str, b: str) -> Column:
    """Shared area over the area of the first."""
    return _over(intersection(a, b), area(a))


def fitted_segment(x1: Column, x2: Column, length: Column, limit: Column) -> tuple[Column, Column]:
    """A segment of the given length (at most ``limit``) centred on [x1, x2], shifted into [0, limit]."""
    new = F.least(length, limit)
    start = F.greatest(F.lit(0.0), F.least((x1 + x2) / 2 - new / 2, limit - new))
    return start, start + new


def square_box(min_side: float = 0.0, width: str = "im_width", height: str = "im_height") -> list[Column]:
    """The best square around a box inside its image: as wide as its longer side and ``min_side``, as far as the image allows."""
    x1, y1, x2, y2 = _sides("")
    most = F.least(F.col(width), F.col(height)).cast("double")
    side = F.greatest(F.least(F.greatest(x2 - x1, y2 - y1), most), F.least(F.lit(float(min_side)), most))
    sx1, sx2 = fitted_segment(x1, x2, side, F.col(width).cast("double"))
    sy1, sy2 = fitted_segment(y1, y2, side, F.col(height).cast("double"))
    return [c.alias(n) for c, n in zip((sx1, sy1, sx2, sy2), ("sx1", "sy1", "sx2", "sy2"), strict=True)]


def padded_box(factor: float, width: str = "im_width", height: str = "im_height") -> list[Column]:
    """The box scaled about its centre and clipped to its image."""
    x1, y1, x2, y2 = _sides("")
    grow = lambda a, b, limit: (
        F.greatest(F.lit(0.0), (a + b) / 2 - (b - a) / 2 * factor),
        F.least(F.col(limit).cast("double"), (a + b) / 2 + (b - a) / 2 * factor),
    )
    px1, px2 = grow(x1, x2, width)
    py1, py2 = grow(y1, y2, height)
    return [c.alias(n) for c, n in zip((px1, py1, px2, py2), ("px1", "py1", "px2", "py2"), strict=True)]


def segment_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> tuple[Column, Column, Column]:
    """(start, end, length) that two segments share; length 0 if none."""
    start, end = F.greatest(a1, b1), F.least(a2, b2)
    return start, end, F.greatest(F.lit(0.0), end - start)

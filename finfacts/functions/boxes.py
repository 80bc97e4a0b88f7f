"""Token boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnOrName, as_col


def bbox_xyxy(bbox: ColumnOrName) -> Column:
    """Left, top, right, bottom of a corner list ``[[x, y], ...]`` as a struct; zeros for an empty one."""
    box = as_col(bbox)
    xs, ys = F.transform(box, lambda p: F.get(p, 0)), F.transform(box, lambda p: F.get(p, 1))

    def side(values: Column, pick) -> Column:
        return F.coalesce(pick(values), F.lit(0.0))

    return F.struct(
        side(xs, F.array_min).alias("x0"),
        side(ys, F.array_min).alias("y0"),
        side(xs, F.array_max).alias("x1"),
        side(ys, F.array_max).alias("y1"),
    )


def bbox_norm(box: ColumnOrName, width: ColumnOrName, height: ColumnOrName) -> Column:
    """Box struct scaled to 0-1000 of the page, cut to that range; zeros for a page without size."""
    b, w, h = as_col(box), as_col(width), as_col(height)

    def scaled(name: str, size: Column) -> Column:
        value = F.try_divide(b[name] * 1000.0, size).cast("int")
        inside = F.least(F.greatest(value, F.lit(0)), F.lit(1000))
        return F.when((w > 0) & (h > 0), inside).otherwise(0).alias(name)

    return F.struct(scaled("x0", w), scaled("y0", h), scaled("x1", w), scaled("y1", h))

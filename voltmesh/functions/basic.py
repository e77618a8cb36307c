"""Null-safe arithmetic shared by the converters; a missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793
DEG = PI / 180.0


def num(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """x within [low, high]; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else num(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else num(high))
    return F.when(x.isNotNull(), out)


def larger(a: Column, b: Column) -> Column:
    """The larger one; NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def zero(x: Column) -> Column:
    return F.coalesce(x, num(0))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear, constant outside; at a doubled knot the last of its values holds."""
    out = F.when(x < num(xs[0]), num(ys[0]))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
        if x1 > x0:
            out = out.when(x < num(x1), num(y0) + (x - num(x0)) * num((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), num(ys[-1]))

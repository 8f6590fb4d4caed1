"""Scalar expressions over colours, sizes and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chop(c: Column) -> Column:
    """The six high bits of a channel."""
    return (c - c % 4).cast("int")


def distance2(a: tuple, b: tuple) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def to_channel(c: Column) -> Column:
    """Half away from zero, within 0 and 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(c))).cast("int")


def tint(c: Column, share: float = 0.82) -> Column:
    return to_channel(c * share + 255 * (1 - share))


def flat(x: Column, y: Column, width: Column) -> Column:
    return y * width + x


def resized(width: Column, height: Column, max_width: int, max_height: int, enabled: bool = True) -> tuple[Column, Column]:
    """Size that fits the limits, never larger; the same where not enabled or zero."""
    if not enabled:
        return width.cast("int"), height.cast("int")
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(float(max_width)), width), F.try_divide(F.lit(float(max_height)), height))
    fit = lambda v: F.when((width > 0) & (height > 0), F.greatest(F.lit(1), F.round(v * scale))).otherwise(v).cast("int")
    return fit(width), fit(height)


def css(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("rgb(%d,%d,%d)", r, g, b)


def bucket_size(width: Column, height: Column, facets: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(width * height / F.greatest(F.lit(1), facets)))).cast("int")

"""Sizes and offsets.  Whole numbers are long; halves round away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(x: Column) -> Column:
    return F.floor(x / 2).cast("long")


def scaled(source: Column, target: Column, reference: Column) -> Column:
    """source * target / reference, rounded, at least 1."""
    return F.greatest(F.lit(1), F.round(source.cast("double") * target / reference)).cast("long")


def output_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """The size asked for; one missing side follows the ratio, two leave the size as it is."""
    width = F.when(tw.isNotNull(), tw).when(th.isNotNull(), scaled(w, th, h)).otherwise(w)
    height = F.when(th.isNotNull(), th).when(tw.isNotNull(), scaled(h, tw, w)).otherwise(h)
    return width, height


def contain_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """The largest size of the same ratio inside the box, enlarging if need be."""
    ratio = F.least(tw.cast("double") / w, th.cast("double") / h)
    return tuple(F.greatest(F.lit(1), F.round(x * ratio)).cast("long") for x in (w, h))


def inside_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """As contain, but never larger than the source."""
    fits = (w <= tw) & (h <= th)
    return tuple(F.when(fits, own).otherwise(x) for own, x in zip((w, h), contain_size(w, h, tw, th)))


def cover_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """The smallest size of the same ratio that covers the box, rounded up."""
    ratio = F.greatest(tw.cast("double") / w, th.cast("double") / h)
    return tuple(F.greatest(F.lit(1), F.ceil(x * ratio)).cast("long") for x in (w, h))


def offset(outer_w: Column, outer_h: Column, inner_w: Column, inner_h: Column, position: Column) -> tuple[Column, Column]:
    """Where content of a smaller size lies in its container."""
    sx, sy = F.greatest(outer_w - inner_w, F.lit(0)), F.greatest(outer_h - inner_h, F.lit(0))
    x = F.when(position.isin("left", "top-left", "bottom-left"), 0).when(
        position.isin("right", "top-right", "bottom-right"), sx).otherwise(half(sx))
    y = F.when(position.isin("top", "top-left", "top-right"), 0).when(
        position.isin("bottom", "bottom-left", "bottom-right"), sy).otherwise(half(sy))
    return x.cast("long"), y.cast("long")


def watermark_offset(
    w: Column, h: Column, wm_w: Column, wm_h: Column, position: Column, margin: Column
) -> tuple[Column, Column]:
    """As ``offset``, a margin kept on each side that the position names."""
    sx, sy = F.greatest(w - wm_w, F.lit(0)), F.greatest(h - wm_h, F.lit(0))
    x = F.when(position.isin("left", "top-left", "bottom-left"), margin).when(
        position.isin("right", "top-right", "bottom-right"), F.greatest(sx - margin, F.lit(0))).otherwise(half(sx))
    y = F.when(position.isin("top", "top-left", "top-right"), margin).when(
        position.isin("bottom", "bottom-left", "bottom-right"), F.greatest(sy - margin, F.lit(0))).otherwise(half(sy))
    return x.cast("long"), y.cast("long")


def watermark_fits(w: Column, h: Column, wm_w: Column, wm_h: Column, position: Column, margin: Column) -> Column:
    """Whether the watermark and the margins that count for its position fit."""
    mx = F.when(position.isin("center", "top", "bottom"), 0).otherwise(margin)
    my = F.when(position.isin("center", "left", "right"), 0).otherwise(margin)
    return (wm_w + mx <= w) & (wm_h + my <= h)


def render_size(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column]:
    """The size at which a vector image is drawn; 300 x 150 where it has none of its own."""
    from_height = F.when(h > 0, F.round(th.cast("double") * w / h)).otherwise(w)
    from_width = F.when(w > 0, F.round(tw.cast("double") * h / w)).otherwise(h)
    width = F.when(tw.isNotNull(), tw).when(th.isNotNull(), from_height).otherwise(F.when(w > 0, w).otherwise(300))
    height = F.when(th.isNotNull(), th).when(tw.isNotNull(), from_width).otherwise(F.when(h > 0, h).otherwise(150))
    return tuple(F.greatest(F.lit(1), x).cast("long") for x in (width, height))

"""Boxes, scales and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox_from_sides(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """[left, bottom, right, top]; what is missing is 0."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in (left, bottom, right, top)])


def clamped_scale(width: Column, height: Column, scale: Column, max_pixels: Column) -> Column:
    """struct(scale, clamped): the scale at which width by height keeps to ``max_pixels``.

    An area or a budget that is not positive leaves the scale as it is.
    """
    area = width * height
    wanted = area * scale * scale
    fits = (area <= 0) | (max_pixels <= 0) | (wanted <= max_pixels)
    return F.struct(
        F.when(fits, scale).otherwise(scale * F.sqrt(max_pixels.cast("double") / F.nullif(wanted, F.lit(0.0)))).alias("scale"),
        (~fits).alias("clamped"),
    )


def region_pixels(bbox: Column, page_height: Column, scale: Column, width_px: Column, height_px: Column) -> Column:
    """A box in points (origin below) as pixels (origin above), cut to the image: struct(left, top, right, bottom).

    Null where nothing of the box is left.
    """
    held = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    left, right = held(bbox[0] * scale, width_px), held(bbox[2] * scale, width_px)
    top, bottom = held((page_height - bbox[3]) * scale, height_px), held((page_height - bbox[1]) * scale, height_px)
    sides = (("left", left), ("top", top), ("right", right), ("bottom", bottom))
    return F.when((right > left) & (bottom > top), F.struct(*[v.cast("int").alias(n) for n, v in sides]))

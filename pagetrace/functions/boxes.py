"""Axis-aligned box arithmetic on x0, y0, x1, y1 columns."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Any, Any, Any, Any]
SIDES = ("x0", "y0", "x1", "y1")


def box_of(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{side}") for side in SIDES)


def field_box(value: Column) -> Box:
    return tuple(value[side] for side in SIDES)


def area(box: Box) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def intersection(a: Box, b: Box) -> Column:
    width = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return width * height


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b).cast("double")
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def overlap_fraction(candidate: Box, existing: Box) -> Column:
    """Share of the candidate's own area that the other box covers."""
    return intersection(candidate, existing).cast("double") / F.greatest(F.lit(1), area(candidate)).cast("double")


def gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(low_a, low_b) - F.least(high_a, high_b))


def stacked(a: Box, b: Box) -> Column:
    """Shared columns of at least a fifth of the narrower box, at most 36 px apart."""
    overlap = (F.least(a[2], b[2]) - F.greatest(a[0], b[0])).cast("double")
    narrower = F.greatest(F.lit(1), F.least(a[2] - a[0], b[2] - b[0])).cast("double")
    return (overlap / narrower >= 0.20) & (gap(a[1], a[3], b[1], b[3]) <= 36)


def beside(a: Box, b: Box) -> Column:
    """Touching rows, at most 45 px apart."""
    return (F.least(a[3], b[3]) - F.greatest(a[1], b[1]) >= 0) & (
        gap(a[0], a[2], b[0], b[2]) <= 45
    )


def neighbours(a: Box, b: Box) -> Column:
    return stacked(a, b) | beside(a, b)


def linked_boxes(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """``neighbours`` of two arrays of boxes; like ``greatest`` and ``least`` it passes over a missing side."""
    across = np.fmin(a["x1"], b["x1"]) - np.fmax(a["x0"], b["x0"])
    down = np.fmin(a["y1"], b["y1"]) - np.fmax(a["y0"], b["y0"])
    narrower = np.fmax(1, np.fmin(a["x1"] - a["x0"], b["x1"] - b["x0"]))
    return ((across / narrower >= 0.20) & (-down <= 36)) | ((down >= 0) & (-across <= 45))


def corners_box(points: Column) -> Column:
    """Struct(x0, y0, x1, y1) of an array of [x, y] points; NULL for none or a bad point."""
    bad = F.exists(points, lambda p: F.coalesce(F.size(p) != 2, F.lit(True)))
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)).cast("int"))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)).cast("int"))
    whole = F.struct(
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )
    return F.when((F.size(points) > 0) & ~bad, whole)

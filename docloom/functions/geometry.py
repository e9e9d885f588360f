"""Boxes as structs of x0, y0, x1, y1. Null boxes give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Margins by which labels are eroded, as a share of width and height; others take DEFAULT_MARGIN.
DEFAULT_MARGIN = 0.05


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """G1: intersection over union; 0 for empty boxes."""
    both = overlap(a, b)
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def enclosing_iou(a: Column, b: Column) -> Column:
    """Intersection over the rectangle that encloses both."""
    hull = box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))
    return F.coalesce(overlap(a, b) / F.nullif(area(hull), F.lit(0.0)), F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """Euclidean distance between the edges of two boxes."""
    dx = F.greatest(F.lit(0.0), a["x0"] - b["x1"], b["x0"] - a["x1"])
    dy = F.greatest(F.lit(0.0), a["y0"] - b["y1"], b["y0"] - a["y1"])
    return F.sqrt(dx * dx + dy * dy)


def center(b: Column) -> Column:
    """G3."""
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def x_overlap(a: Column, b: Column) -> Column:
    """Horizontal overlap as a share of the narrower box."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return F.coalesce(w / F.nullif(F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]), F.lit(0.0)), F.lit(0.0))


def y_overlap(a: Column, b: Column) -> Column:
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.coalesce(h / F.nullif(F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]), F.lit(0.0)), F.lit(0.0))


def is_aligned(a: Column, b: Column, least: float = 0.3) -> Column:
    """G4."""
    return x_overlap(a, b) >= least


def erode(b: Column, margin: Column | float = DEFAULT_MARGIN) -> Column:
    """Each side moved in by a share of the size; a box that would turn inside out stays as it is."""
    m = margin if isinstance(margin, Column) else F.lit(margin)
    dx, dy = (b["x1"] - b["x0"]) * m, (b["y1"] - b["y0"]) * m
    small = box(b["x0"] + dx, b["y0"] + dy, b["x1"] - dx, b["y1"] - dy)
    return F.when((small["x1"] > small["x0"]) & (small["y1"] > small["y0"]), small).otherwise(b)


def scale(b: Column, sx: Column | float, sy: Column | float) -> Column:
    """Pixels to page units and back."""
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def flip_y(b: Column, height: Column) -> Column:
    return box(b["x0"], height - b["y1"], b["x1"], height - b["y0"])


def hull_of(boxes: Column) -> Column:
    """Envelope of an array of boxes."""
    return box(F.array_min(F.transform(boxes, lambda b: b["x0"])), F.array_min(F.transform(boxes, lambda b: b["y0"])), F.array_max(F.transform(boxes, lambda b: b["x1"])), F.array_max(F.transform(boxes, lambda b: b["y1"])))

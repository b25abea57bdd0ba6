"""Boxes as column expressions: x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Shared area by the area of both together; an area counts as 1 at least."""
    shared = (F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
              * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])))
    whole = F.greatest(F.lit(1), area(a)) + F.greatest(F.lit(1), area(b)) - shared
    return shared / F.greatest(F.lit(1), whole)


def width(b: Column) -> Column:
    return F.greatest(F.lit(1), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(1), b["y2"] - b["y1"])


def centre_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def is_duplicate(a: Column, b: Column, least_iou: float = 0.65) -> Column:
    """Boxes that overlap much, or whose centres are near by their heights and widths."""
    dy, dx = F.abs(centre_y(a) - centre_y(b)), F.abs(centre_x(a) - centre_x(b))
    return (iou(a, b) >= least_iou) | ((dy <= 0.55 * F.greatest(height(a), height(b))) & (dx <= 0.35 * F.greatest(width(a), width(b))))


def relation(a: Column, b: Column, ratio: float = 1.5) -> Column:
    """Where b lies from a, if one axis dominates; null else."""
    dx, dy = centre_x(b) - centre_x(a), centre_y(b) - centre_y(a)
    return (F.when(F.abs(dy) > F.abs(dx) * ratio, F.when(dy > 0, "above").otherwise("below"))
            .when(F.abs(dx) > F.abs(dy) * ratio, F.when(dx > 0, "left_of").otherwise("right_of")))


INVERSE = {"above": "below", "below": "above", "left_of": "right_of", "right_of": "left_of"}


def from_any(b: Column) -> Column:
    """A box from an array of four numbers: x, y, width, height if the corners are out of order, null if shorter."""
    x1, y1, a, c = (F.get(b, F.lit(i)) for i in range(4))
    flipped = (a < x1) | (c < y1)
    return F.when(F.size(b) >= 4, F.struct(x1.alias("x1"), y1.alias("y1"), F.when(flipped, x1 + a).otherwise(a).alias("x2"), F.when(flipped, y1 + c).otherwise(c).alias("y2")))


def of_polygon(points: Column) -> Column:
    """The box around an array of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def xywh(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), F.greatest(F.lit(0), b["x2"] - b["x1"]).alias("w"), F.greatest(F.lit(0), b["y2"] - b["y1"]).alias("h"))


def confidence(c: Column) -> Column:
    """From 0 to 1: a percentage is divided by 100, NaN and null are 0."""
    clean = F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((clean > 1) & (clean <= 100), clean / 100).otherwise(clean)))

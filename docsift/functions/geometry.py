"""Box arithmetic. A box is struct<x1, y1, x2, y2> of doubles with x1 <= x2 and y1 <= y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    low, high = (lambda a, b: F.least(a, b).cast("double")), (lambda a, b: F.greatest(a, b).cast("double"))
    return F.struct(low(x1, x2).alias("x1"), low(y1, y2).alias("y1"), high(x1, x2).alias("x2"), high(y1, y2).alias("y2"))


def from_polygon(points: Column) -> Column:
    """The bounding box of array<struct<x, y>>; null for no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def from_numbers(values: Column) -> Column:
    """Of four numbers a box, of eight or more the bounding box of the first four points; else null."""
    pick = lambda odd: F.array(*[F.get(values, F.lit(2 * k + odd)) for k in range(4)])
    four = box(*[F.get(values, F.lit(k)) for k in range(4)])
    eight = box(F.array_min(pick(0)), F.array_min(pick(1)), F.array_max(pick(0)), F.array_max(pick(1)))
    return F.when(F.size(values) == 4, four).when(F.size(values) >= 8, eight)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a that b covers; 0 for an a without area."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(F.lit(0.0))


def holds_center(outer: Column, inner: Column) -> Column:
    c = center(inner)
    return c["x"].between(outer["x1"], outer["x2"]) & c["y"].between(outer["y1"], outer["y2"])


def vertical_overlap(a: Column, b: Column) -> Column:
    """Common height over the smaller height; 0 without either."""
    common = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    smaller = F.least(height(a), height(b))
    return F.when((common > 0) & (smaller > 0), common / smaller).otherwise(F.lit(0.0))


def merge(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2")
    )

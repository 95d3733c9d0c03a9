"""Plane geometry as native column expressions. Boxes are (x1, y1, x2, y2); rings are arrays of (x, y) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, both_zero: float = 1.0) -> Column:
    """num / den, with 0/0 = both_zero and x/0 = 0."""
    return F.when(den == 0, F.when(num == 0, F.lit(both_zero)).otherwise(F.lit(0.0))).otherwise(num / F.when(den == 0, F.lit(1)).otherwise(den))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length of the common part of two intervals, 0 if there is none."""
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])
    return ratio(both, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both, 0.0)


def axial_difference(a: Column, b: Column) -> Column:
    """Degrees between two undirected axes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def span_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees of an undirected span, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to a segment, which may be a point."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(size == 0, F.lit(1.0)).otherwise(size))))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an open ring."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)


def ring_box(ring: Column) -> Column:
    """Struct of a ring's box, its longer and shorter side, and whether it is horizontal (width >= height)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.greatest(x2 - x1, y2 - y1).alias("length"), F.least(x2 - x1, y2 - y1).alias("thickness"), (x2 - x1 >= y2 - y1).alias("horizontal")
    )


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies inside an open ring, by the parity of edges crossed to the right."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)

    def crossed(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        height = F.when(a["y"] == b["y"], F.lit(1.0)).otherwise(b["y"] - a["y"])
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / height + a["x"])

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crossed(i).cast("int")) % 2 == 1


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def letterbox_to_source(v: Column, low: Column, high: Column, size: Column) -> Column:
    """A letterbox coordinate mapped to source pixels and clamped to the image; [low, high] is where the image lies."""
    return F.greatest(F.lit(0.0), F.least(size, (v - low) * size / (high - low)))

"""Joins between openings, wall segments, gaps, bridges and rooms. All are equi joins on the image with residual predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, overlap, segment_distance
from ..scratch import stored


def _prefixed(df: DataFrame, p: str, key: str = "image") -> DataFrame:
    return df.select(*(F.col(c) if c == key else F.col(c).alias(f"{p}_{c}") for c in df.columns))


def bind_nearest(openings: DataFrame, segments: DataFrame) -> DataFrame:
    """image, opening, segment, distance, overhang, status, reasons: the segment that carries each opening.

    A segment is aligned if it departs from the opening's direction by a slope of 0.27 at most; the overhang is what of the opening (its length
    about the nearest point of the segment) lies beyond an end. The nearest segment is taken if it is aligned with an overhang of 5
    at most. Else those are feasible that are aligned, with an overhang of 1 at most, no farther than the nearest by over
    max(3, 5 % of the length), and within max(20, 1.5 x their thickness): a single one is taken (`span_aware`), with several the nearest stays as
    `ambiguous`, with none as `nearest`. Without segments the status is null. reasons say why the choice must be rejected:
    no_wall_segments, perpendicular_wall (a slope over 3.7 the other way), far_from_wall (over twice max(20, 1.5 x thickness)), exceeds_segment (overhang over
    max(20, a quarter of the length)). A null thickness is 20. Ties go to the smaller id. Grouped minima and counts; no list of candidates is gathered.
    """
    o = _prefixed(openings.select("image", "id", "cx", "cy", "length", "horizontal"), "o")
    s = _prefixed(segments.select("image", "id", "x1", "y1", "x2", "y2", F.coalesce("thickness", F.lit(20.0)).alias("thickness")), "s")
    x1, y1, x2, y2, cx, cy = (F.col(c) for c in ("s_x1", "s_y1", "s_x2", "s_y2", "o_cx", "o_cy"))
    dx, dy, size, half = F.abs(x2 - x1), F.abs(y2 - y1), distance(x1, y1, x2, y2), F.col("o_length") / 2
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / F.when(size > 0, size * size)))).otherwise(0.0)
    flat = F.col("o_horizontal")
    near = o.join(s, "image").select(
        "image", "o_id", "o_length", F.col("s_id").alias("segment"), F.col("s_thickness").alias("thickness"), segment_distance(cx, cy, x1, y1, x2, y2).alias("distance"),
        F.greatest(F.lit(0.0), half - t * size, t * size + half - size).alias("overhang"), F.when(flat, dy <= 0.27 * dx).otherwise(dx <= 0.27 * dy).alias("aligned"), F.when(flat, dy > 3.7 * dx).otherwise(dx > 3.7 * dy).alias("across"),
    )
    pick = F.struct(F.round("distance", 9).alias("d"), "segment", "distance", "overhang", "aligned", "across", "thickness")
    first = near.groupBy("image", "o_id").agg(F.min(pick).alias("n"))
    first = first.withColumn("good", F.col("n.aligned") & (F.col("n.overhang") <= 5))
    reach = F.least(F.col("n.distance") + F.greatest(F.lit(3.0), 0.05 * F.col("o_length")), F.greatest(F.lit(20.0), 1.5 * F.col("thickness")))
    others = near.join(first.where("not good"), ["image", "o_id"]).where(F.col("aligned") & (F.col("overhang") <= 1) & (F.col("distance") <= reach))
    feasible = others.groupBy("image", "o_id").agg(F.count("*").alias("feasible"), F.min(pick).alias("f"))
    whole = o.select("image", "o_id", "o_length").join(first, ["image", "o_id"], "left").join(feasible, ["image", "o_id"], "left")
    status = F.when(F.col("n").isNull(), None).when(F.col("feasible") == 1, "span_aware").when(F.col("feasible") > 1, "ambiguous").otherwise("nearest")
    whole = whole.withColumn("status", status).withColumn("use", F.when(F.col("status") == "span_aware", F.col("f")).otherwise(F.col("n")))
    limit = F.greatest(F.lit(20.0), 1.5 * F.col("use.thickness"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "no_wall_segments"), F.when(F.col("use.across"), "perpendicular_wall"), F.when(F.col("use.distance") > 2 * limit, "far_from_wall"),
        F.when(F.col("use.overhang") > F.greatest(F.lit(20.0), 0.25 * F.col("o_length")), "exceeds_segment"),
    ))
    return whole.select("image", F.col("o_id").alias("opening"), "use.segment", "use.distance", "use.overhang", "status", reasons.alias("reasons"))


def unique_carrier(cuts: DataFrame, edges: DataFrame, reach: float = 2.0) -> DataFrame:
    """For each cut the only edge on whose line (within `reach`) and between whose ends it lies, else why there is none."""
    c, e = _prefixed(cuts.select("image", "id", "horizontal", "pos", "low", "high"), "c"), _prefixed(edges.select("image", "id", "horizontal", "pos", "low", "high"), "e")
    carries = (F.col("c_horizontal") == F.col("e_horizontal")) & (F.abs(F.col("c_pos") - F.col("e_pos")) <= reach) & (F.col("e_low") <= F.col("c_low")) & (F.col("c_high") <= F.col("e_high"))
    found = c.join(e, "image").where(carries).groupBy("image", "c_id").agg(F.count("*").alias("n"), F.min("e_id").alias("edge"))
    n = F.coalesce("n", F.lit(0))
    whole = c.select("image", "c_id").join(found, ["image", "c_id"], "left")
    return whole.select("image", F.col("c_id").alias("cut"), F.when(n == 1, F.col("edge")).alias("edge"), F.when(n == 0, "no_carrier").when(n > 1, "several_carriers").otherwise("bound").alias("reason"))


def gaps_without_bridge(gaps: DataFrame, bridges: DataFrame) -> DataFrame:
    """Gaps whose end points (in either order) no bridge of the image has."""
    ends = lambda: F.array_sort(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return gaps.withColumn("ends", ends()).join(bridges.select("image", ends().alias("ends")), ["image", "ends"], "left_anti").drop("ends")


def strips_in_windows(windows: DataFrame) -> DataFrame:
    """Thin windows that are part of a wide one: parent is the least id that holds the strip.

    Same orientation, thickness at most 40 % and length at most 105 % of the parent's, 90 % of the strip's axis within the
    parent's, centre lines no farther apart than half the parent's thickness and 2.
    """
    cols = ("id", "horizontal", "pos", "low", "high", "thickness")
    a, b = _prefixed(windows.select("image", *cols), "a"), _prefixed(windows.select("image", *cols), "b")
    size = lambda p: F.col(f"{p}_high") - F.col(f"{p}_low")
    part = (
        (F.col("a_id") != F.col("b_id")) & (F.col("a_horizontal") == F.col("b_horizontal")) & (F.col("a_thickness") <= 0.4 * F.col("b_thickness")) & (size("a") <= 1.05 * size("b"))
        & (overlap(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high")) >= 0.9 * size("a")) & (F.abs(F.col("a_pos") - F.col("b_pos")) <= F.col("b_thickness") / 2 + 2)
    )
    return a.join(b, "image").where(part).groupBy("image", F.col("a_id").alias("strip")).agg(F.min("b_id").alias("parent"))


def parallel_windows(windows: DataFrame, gap: float = 20.0) -> DataFrame:
    """window, partner in both orders: parallel windows within `gap` that share 75 % of the shorter one's axis."""
    cols = ("id", "horizontal", "pos", "low", "high")
    a, b = _prefixed(windows.select("image", *cols), "a"), _prefixed(windows.select("image", *cols), "b")
    size = lambda p: F.col(f"{p}_high") - F.col(f"{p}_low")
    near = (F.col("a_id") < F.col("b_id")) & (F.col("a_horizontal") == F.col("b_horizontal")) & (F.abs(F.col("a_pos") - F.col("b_pos")) <= gap) & (overlap(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high")) >= 0.75 * F.least(size("a"), size("b")))
    both = F.explode(F.array(F.struct(F.col("a_id").alias("window"), F.col("b_id").alias("partner")), F.struct(F.col("b_id").alias("window"), F.col("a_id").alias("partner"))))
    return a.join(b, "image").where(near).select("image", both.alias("p")).select("image", "p.*")


def crossing_windows(windows: DataFrame, longer: float = 1.2) -> DataFrame:
    """Windows that a perpendicular one, `longer` times as long at least, crosses; crossed_by is the least such id."""
    cols = ("id", "horizontal", "pos", "low", "high")
    a, b = _prefixed(windows.select("image", *cols), "a"), _prefixed(windows.select("image", *cols), "b")
    size = lambda p: F.col(f"{p}_high") - F.col(f"{p}_low")
    cross = (F.col("a_horizontal") != F.col("b_horizontal")) & F.col("b_pos").between(F.col("a_low"), F.col("a_high")) & F.col("a_pos").between(F.col("b_low"), F.col("b_high")) & (size("b") >= longer * size("a"))
    return a.join(b, "image").where(cross).groupBy("image", F.col("a_id").alias("window")).agg(F.min("b_id").alias("crossed_by"))


def door_window_pairs(doors: DataFrame, windows: DataFrame, gap: float = 15.0) -> DataFrame:
    """For each door the collinear window of similar size that is nearest along the axis: least (gap, offset, id)."""
    cols = ("id", "horizontal", "pos", "low", "high")
    d, w = _prefixed(doors.select("image", *cols), "d"), _prefixed(windows.select("image", *cols), "w")
    between = F.greatest(F.lit(0.0), F.col("w_low") - F.col("d_high"), F.col("d_low") - F.col("w_high"))
    offset, size = F.abs(F.col("d_pos") - F.col("w_pos")), lambda p: F.col(f"{p}_high") - F.col(f"{p}_low")
    fits = (F.col("d_horizontal") == F.col("w_horizontal")) & (offset <= 6) & (between <= gap) & (F.least(size("d"), size("w")) >= 0.5 * F.greatest(size("d"), size("w")))
    best = F.min(F.struct(between.alias("gap"), offset.alias("offset"), F.col("w_id").alias("window"))).alias("b")
    return d.join(w, "image").where(fits).groupBy("image", F.col("d_id").alias("door")).agg(best).select("image", "door", "b.window", "b.gap", "b.offset")


def same_layer() -> Column:
    """Whether rows a_ and b_ (id, horizontal, pos, low, high, thickness) are layers of one window.

    Both run one way, are 12 long at least and 0.3 times as thick at most; the shorter is 85 % of the longer and shares 90 % of its axis; the free space
    between them is within max(4, half the lesser thickness), their middle lines within 1.75 x the greater thickness.
    """
    a, b = F.col("a_high") - F.col("a_low"), F.col("b_high") - F.col("b_low")
    ta, tb, off = F.col("a_thickness"), F.col("b_thickness"), F.abs(F.col("a_pos") - F.col("b_pos"))
    short, long = F.least(a, b), F.greatest(a, b)
    shape = (F.col("a_horizontal") == F.col("b_horizontal")) & (short >= 12) & (ta <= 0.3 * a) & (tb <= 0.3 * b) & (short >= 0.85 * long)
    along = overlap(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high")) >= 0.9 * short
    return shape & along & (off - (ta + tb) / 2 <= F.greatest(F.lit(4.0), 0.5 * F.least(ta, tb))) & (off <= 1.75 * F.greatest(ta, tb))


def priority_dedup(layers: DataFrame, same: Column, order: list[str]) -> DataFrame:
    """Rows that a pass in `order` keeps, where a kept row removes every later row that is the `same` (of columns a_, b_) in its image.

    A row is kept as soon as no undecided row before it is the same, and removed once a kept one is; each round decides all such rows at once.
    """
    whole = stored(layers, "layers")
    a, b = _prefixed(whole, "a"), _prefixed(whole, "b")
    before = F.struct(*(f"a_{c}" for c in order)) < F.struct(*(f"b_{c}" for c in order))
    conflicts = stored(a.join(b, "image").where(before & same).select("image", F.col("a_id").alias("keeper"), F.col("b_id").alias("id")), "conflicts")
    left, kept = whole.select("image", "id"), None
    while True:
        now = left.join(conflicts, ["image", "id"], "left_anti")
        kept = stored(now if kept is None else kept.union(now), "kept")
        lost = conflicts.join(kept.select("image", F.col("id").alias("keeper")), ["image", "keeper"], "left_semi").select("image", "id").distinct()
        left = stored(left.join(kept, ["image", "id"], "left_anti").join(lost, ["image", "id"], "left_anti"), "left")
        if left.isEmpty():
            return whole.join(kept, ["image", "id"], "left_semi")
        alive = kept.union(left).select("image", F.col("id").alias("keeper"))
        conflicts = stored(conflicts.join(left, ["image", "id"], "left_semi").join(alive, ["image", "keeper"], "left_semi").join(kept.select("image", F.col("id").alias("keeper")), ["image", "keeper"], "left_anti"), "conflicts")


def hole_overlaps(holes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Pairs of holes of one wall whose boxes overlap by more than `tolerance` on both axes; the earlier first."""
    cols = ("id", "ord", "x1", "y1", "x2", "y2")
    a, b = _prefixed(holes.select("wall", *cols), "a", "wall"), _prefixed(holes.select("wall", *cols), "b", "wall")
    x, y = (F.least(f"a_{c}2", f"b_{c}2") - F.greatest(f"a_{c}1", f"b_{c}1") for c in "xy")
    return a.join(b, "wall").where((F.col("a_ord") < F.col("b_ord")) & (x > tolerance) & (y > tolerance)).select("wall", F.col("a_id").alias("earlier"), F.col("b_id").alias("hole"), (x * y).alias("area"))


def first_by_ends(spans: DataFrame, order: list[str]) -> DataFrame:
    """Of spans with the same end points in either order, the first in `order`."""
    ends = F.array_sort(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    n = F.row_number().over(Window.partitionBy("image", "ends").orderBy(*order))
    return spans.withColumn("ends", ends).withColumn("n", n).where("n = 1").drop("ends", "n")

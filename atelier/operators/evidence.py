"""Joins and ladders over evidence rows: measured thickness, closures, lineage, cross-sections, proposals, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, segment_distance


def nearest_thickness(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """image, edge, thickness of the evidence axis (ordinal, x1, y1, x2, y2, thickness) nearest to each edge's middle (cx, cy).

    The distance is to the axis's segment, not to its line; ties go to the least ordinal. A grouped minimum, no list.
    """
    e, v = edges.select("image", F.col("id").alias("edge"), "cx", "cy"), evidence.select("image", "ordinal", "x1", "y1", "x2", "y2", "thickness")
    d = segment_distance(*(F.col(c) for c in ("cx", "cy", "x1", "y1", "x2", "y2")))
    best = F.min(F.struct(F.round(d, 9).alias("d"), "ordinal", "thickness")).alias("m")
    return e.join(v, "image").groupBy("image", "edge").agg(best).select("image", "edge", F.col("m.thickness").alias("thickness"))


def fuzzy_spans(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """For each left span the right one whose ends lie within `tolerance` of its ends in either direction, by least total distance."""
    a, b = (df.select("image", F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))) for df, p in ((left, "a"), (right, "b")))
    d = lambda i, j: distance(F.col(f"ax{i}"), F.col(f"ay{i}"), F.col(f"bx{j}"), F.col(f"by{j}"))
    ways = [F.when((d(1, i) <= tolerance) & (d(2, j) <= tolerance), d(1, i) + d(2, j)) for i, j in ((1, 2), (2, 1))]
    both = a.join(b, "image").withColumn("total", F.least(*ways)).where("total is not null")
    return both.groupBy("image", "a_id").agg(F.min(F.struct("total", "b_id")).alias("m")).select("image", F.col("a_id").alias("left"), F.col("m.b_id").alias("right"))


def measurement_status(openings: DataFrame, measurements: DataFrame, walls: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Status of each opening's wall measurement. measurements: image, id, opening_ids, wall, thickness; walls: image, wall, thickness.

    no_measurement, several_measurements, missing_wall, thickness_mismatch (over `tolerance` of the wall's) or confirmed.
    """
    told = measurements.select("image", "wall", F.col("thickness").alias("measured"), F.explode("opening_ids").alias("opening"))
    n = told.groupBy("image", "opening").agg(F.count("*").alias("n"), F.min("wall").alias("wall"), F.min("measured").alias("measured"))
    whole = openings.select("image", F.col("id").alias("opening")).join(n, ["image", "opening"], "left").join(walls.select("image", "wall", F.col("thickness").alias("real")), ["image", "wall"], "left")
    status = F.when(F.col("n").isNull(), "no_measurement").when(F.col("n") > 1, "several_measurements").when(F.col("real").isNull(), "missing_wall").when(F.abs(F.col("measured") - F.col("real")) > tolerance * F.col("real"), "thickness_mismatch").otherwise("confirmed")
    return whole.select("image", "opening", status.alias("status"))


def one_to_one(links: DataFrame, left: str, right: str) -> DataFrame:
    """Links whose left and right end have no other link in their image."""
    alone = lambda end: F.count("*").over(Window.partitionBy("image", end)) == 1
    return links.withColumn("_l", alone(left)).withColumn("_r", alone(right)).where("_l and _r").drop("_l", "_r")


def cross_sections(samples: DataFrame, ratio_limit: float = 1.4) -> DataFrame:
    """Median width of each segment's cross-sections, and whether the greatest is within `ratio_limit` of the least."""
    return samples.groupBy("image", "segment").agg(F.median("width").alias("width"), F.count("*").alias("n"), (F.max("width") <= ratio_limit * F.min("width")).alias("consistent"))


def ladder(steps: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first step whose condition is true; null conditions don't count."""
    out = None
    for cond, name in steps:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def routed(rows: DataFrame, steps: Sequence[tuple[Column, str]], otherwise: str = "kept") -> DataFrame:
    """Adds route: each row leaves at the first step that claims it."""
    return rows.withColumn("route", ladder(steps, otherwise))


def only_proposal(proposals: DataFrame, key: list[str]) -> DataFrame:
    """Proposals of keys that have just one; several make all of them ambiguous."""
    return proposals.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n = 1").drop("_n")


def endpoint_pairs(nodes: DataFrame, low: float, high: float, least_cos: float = 0.98) -> DataFrame:
    """Pairs of loose ends of an image that face each other. nodes: image, id, x, y, dx, dy (unit direction outwards).

    Their distance lies in [low, high] and the line between them runs along both directions.
    """
    a, b = (nodes.select("image", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y", "dx", "dy"))) for p in "ab")
    both = a.join(b, "image").where("a_id < b_id").withColumn("d", distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))).where(F.col("d").between(low, high))
    ux, uy = (F.col("b_x") - F.col("a_x")) / F.col("d"), (F.col("b_y") - F.col("a_y")) / F.col("d")
    cos_a, cos_b = F.col("a_dx") * ux + F.col("a_dy") * uy, -(F.col("b_dx") * ux + F.col("b_dy") * uy)
    return both.where((cos_a >= least_cos) & (cos_b >= least_cos)).select("image", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("d").alias("distance"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """image, node, degree, kind: end (1), line (2), T (3) or X (4 and more)."""
    ends = edges.select("image", F.explode(F.array("a", "b")).alias("node"))
    n = ends.groupBy("image", "node").agg(F.count("*").alias("degree"))
    return n.withColumn("kind", ladder([(F.col("degree") == 1, "end"), (F.col("degree") == 2, "line"), (F.col("degree") == 3, "T")], "X"))


def least_subset(items: Column, most: int, passes) -> Column:
    """The indices of the smallest subset of at most `most` items that passes (ties: least mask); null if none does.

    `passes` gets the array of a subset's items. Subsets of up to 2^most are bit masks of one array.
    """
    chosen = lambda mask: F.filter(items, lambda _, i: F.getbit(mask, i.cast("int")) == 1)
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), F.least(F.size(items), F.lit(most))).cast("long") - 1)
    good = F.filter(masks, lambda m: passes(chosen(m)))
    best = F.array_min(F.transform(good, lambda m: F.struct(F.bit_count(m).alias("n"), m.alias("m"))))
    return F.when((F.size(items) > 0) & (F.size(good) > 0), best["m"])


def captured(rows: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """ok and failed rows of each group, and the first error by name."""
    return rows.groupBy(*by).agg(F.count_if(failed.isNull()).alias("ok"), F.count_if(failed.isNotNull()).alias("failed"), F.min(failed).alias("first_error"))

"""From recognised openings to exported elements: geometry choices, placement, preflight, serialised holes, graph checks, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, overlap, ratio, ring_area
from ..functions.polygons import ring_valid, rings_share
from ..functions.scalars import fit_opening
from .binding import bind_nearest
from .matching import greedy_match

#: Answers that a review may give, by an opening's source class.
GAP_CHOICES, FRAME_CHOICES, OTHER_CHOICES = ("door", "open_passage", "ignore"), ("door", "window", "open_passage", "ignore"), ("door", "window", "ignore")


def opening_choices(source_class: Column) -> Column:
    """The answers that a review may give on an opening."""
    listed = lambda names: F.array(*(F.lit(n) for n in names))
    gap = source_class.isin("unmarked_exterior_gap", "unmarked_interior_gap")
    return F.when(F.coalesce(gap, F.lit(False)), listed(GAP_CHOICES)).when(F.coalesce(source_class == "outlined_wall_frame", F.lit(False)), listed(FRAME_CHOICES)).otherwise(listed(OTHER_CHOICES))


def hole_shape(width: Column, height: Column) -> Column:
    """The closed ring of a rectangular hole in metres, from centimetres, rounded to five places."""
    x, y, zero = F.round(width / 200.0, 5), F.round(height / 100.0, 5), F.lit(0.0)
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(point(x, y), point(-x, y), point(-x, zero), point(x, zero), point(x, y))


def scaled_hole(shape: Column, sx: Column, sy: Column) -> Column:
    return F.transform(shape, lambda p: F.struct(F.round(F.coalesce(p["x"], F.lit(0.0)) * sx, 5).alias("x"), F.round(F.coalesce(p["y"], F.lit(0.0)) * sy, 5).alias("y")))


def scaled_sill(shape: Column, sx: Column) -> Column:
    """As scaled_hole along the wall only; heights stay as they are."""
    return F.transform(shape, lambda p: F.struct(F.round(F.coalesce(p["x"], F.lit(0.0)) * sx, 5).alias("x"), F.coalesce(p["y"], F.lit(0.0)).alias("y")))


def carrier_span(source: Column, span: Column, clear_span: Column) -> Column:
    """The span that a bridge's carrier keeps: its own where the cut was trimmed at visible window jambs, else the clear one."""
    return F.when(F.coalesce(source == "visible_window_jambs", F.lit(False)), span).otherwise(clear_span)


def export_geometry(box: tuple[Column, ...], span: tuple[Column, ...], bay: tuple[Column, Column], least_support: Column, is_bay: Column) -> Column:
    """Struct (cx, cy, horizontal, length, source) of an opening: the measured bay if it is one and agrees with the box, else the box.

    box: x1, y1, x2, y2; span: the bay's axis x1, y1, x2, y2; bay: its start and end. A bay agrees if every support is 0.8 at least, its axis
    runs the box's way with a tilt of 10 % at most, its ends are within 2 of the bay's, it covers 20 and 40 % of the box at least and 20 more
    than it at most, and 70 % of it lie in the box.
    """
    (x1, y1, x2, y2), (sx1, sy1, sx2, sy2) = box, span
    wide = x2 - x1 >= y2 - y1
    plain = F.struct(((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), wide.alias("horizontal"), F.greatest(x2 - x1, y2 - y1).alias("length"), F.lit("segmentation_bbox").alias("source"))
    dx, dy = F.abs(sx2 - sx1), F.abs(sy2 - sy1)
    flat = dx >= dy
    lo, hi = F.when(flat, F.least(sx1, sx2)).otherwise(F.least(sy1, sy2)), F.when(flat, F.greatest(sx1, sx2)).otherwise(F.greatest(sy1, sy2))
    blo, bhi = F.when(flat, x1).otherwise(y1), F.when(flat, x2).otherwise(y2)
    size = hi - lo
    sound = is_bay & (least_support >= 0.8) & (F.least(dx, dy) <= 0.1 * F.greatest(dx, dy)) & (flat == wide) & (F.abs(lo - bay[0]) <= 2) & (F.abs(hi - bay[1]) <= 2)
    sound = sound & (size >= F.greatest(F.lit(20.0), 0.4 * (bhi - blo))) & (overlap(lo, hi, blo, bhi) >= 0.7 * size) & (size <= bhi - blo + 20)
    measured = F.struct(((sx1 + sx2) / 2).alias("cx"), ((sy1 + sy2) / 2).alias("cy"), flat.alias("horizontal"), size.alias("length"), F.lit("raster_clear_bay").alias("source"))
    return F.when(F.coalesce(sound, F.lit(False)), measured).otherwise(plain)


def strip_ring(x1: Column, y1: Column, x2: Column, y2: Column, width: Column) -> Column:
    """Ring of the strip of a width about a span, cut flat at its ends; null for a span without length."""
    size = distance(x1, y1, x2, y2)
    nx, ny = -(y2 - y1) / F.when(size > 0, size) * width / 2, (x2 - x1) / F.when(size > 0, size) * width / 2
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(size > 0, F.array(point(x1 + nx, y1 + ny), point(x2 + nx, y2 + ny), point(x2 - nx, y2 - ny), point(x1 - nx, y1 - ny)))


def length_in_strip(ax: Column, ay: Column, bx: Column, by: Column, x1: Column, y1: Column, x2: Column, y2: Column, half: Column) -> Column:
    """Length of the segment a-b within the flat-cut strip of half-width `half` about x1,y1-x2,y2, in closed form."""
    size = F.when(distance(x1, y1, x2, y2) > 0, distance(x1, y1, x2, y2))
    ux, uy = (x2 - x1) / size, (y2 - y1) / size
    along = lambda x, y: (x - x1) * ux + (y - y1) * uy
    across = lambda x, y: (y - y1) * ux - (x - x1) * uy

    def inside(p: Column, q: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """The part of [0, 1] in which a value that goes from p to q lies in [low, high]; an empty one has its end before its begin."""
        step = F.when(p == q, F.lit(1.0)).otherwise(q - p)
        t1, t2 = (low - p) / step, (high - p) / step
        still = F.when((p >= low) & (p <= high), 1.0).otherwise(-1.0)
        return F.when(p == q, 0.0).otherwise(F.least(t1, t2)), F.when(p == q, still).otherwise(F.greatest(t1, t2))

    s, d = inside(along(ax, ay), along(bx, by), F.lit(0.0), size), inside(across(ax, ay), across(bx, by), -half, half)
    part = F.least(F.lit(1.0), s[1], d[1]) - F.greatest(F.lit(0.0), s[0], d[0])
    return F.when(size.isNotNull(), F.greatest(F.lit(0.0), part) * distance(ax, ay, bx, by)).otherwise(0.0)  # a span without length has no strip


def on_existing_carrier(openings: DataFrame, bridges: DataFrame) -> DataFrame:
    """Openings (image, id, x1..y2 of their axis, width) that a bridge (image, x1..y2) of the image already carries, or whose axis has no length.

    A bridge carries an opening if 95 % of its length go the opening's way and half of the opening's axis lies within max(2, width / 2) of it.
    """
    o = openings.select("image", "id", *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2", "width")))
    b = bridges.select("image", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    ox, bx = [F.col(f"o_{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]
    size, own = distance(*ox), distance(*bx)
    way = F.abs((bx[2] - bx[0]) * (ox[2] - ox[0]) + (bx[3] - bx[1]) * (ox[3] - ox[1])) / F.when(size > 1e-5, size)
    carries = (way >= 0.95 * own) & (length_in_strip(*ox, *bx, F.greatest(F.lit(2.0), F.col("o_width") / 2)) >= 0.5 * size)
    found = o.join(b, "image").where(carries).select("image", "id").distinct()
    return found.union(o.where(size <= 1e-5).select("image", "id")).distinct()


def placed(openings: DataFrame, segments: DataFrame, least: float = 12.0) -> DataFrame:
    """Every opening bound on its own: image, opening, index (from 1, by id), segment, width, position, fitted, unplaced (reasons).

    An opening that a reason rejects has no width and position. One whose wall is aligned, not ambiguous and within half its thickness is fitted
    to the wall's ends where it overruns them a little.
    """
    bound = bind_nearest(openings, segments)
    rows = openings.select("image", F.col("id").alias("opening"), "cx", "cy", "length", "horizontal").join(bound, ["image", "opening"])
    walls = segments.select("image", F.col("id").alias("segment"), "x1", "y1", "x2", "y2", F.coalesce("thickness", F.lit(20.0)).alias("thickness"))
    rows = rows.join(walls, ["image", "segment"], "left")
    size = distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("cx") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("cy") - F.col("y1")) * (F.col("y2") - F.col("y1"))) / (size * size)))
    aligned = F.when(F.col("horizontal"), F.abs(F.col("y2") - F.col("y1")) <= 0.27 * F.abs(F.col("x2") - F.col("x1"))).otherwise(F.abs(F.col("x2") - F.col("x1")) <= 0.27 * F.abs(F.col("y2") - F.col("y1")))
    fit = F.when(aligned & (F.col("status") != "ambiguous") & (F.col("distance") <= F.col("thickness") / 2), fit_opening(F.col("length"), 100 * t, size, F.col("thickness"), F.lit(least)))
    rows = rows.withColumn("fit", fit)
    rejected = F.size("reasons") > 0
    own = lambda name, plain: F.when(~rejected, F.coalesce(F.col(f"fit.{name}"), plain))
    index = openings.groupBy("image").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # one plan's openings
    rows = rows.join(index, "image")
    return rows.select("image", "opening", F.array_position("ids", F.col("opening")).alias("index"), "segment", own("width", F.col("length")).alias("width"), own("position", 100 * t).alias("position"), F.coalesce(F.col("fit").isNotNull() & ~rejected, F.lit(False)).alias("fitted"), F.array_join("reasons", ",").alias("unplaced"))


def preflight(openings: DataFrame, segments: DataFrame) -> DataFrame:
    """image, opening, reasons of a placement's doubts: no_wall_segments, misaligned_wall, far_from_wall (beyond max(20, 1.5 x thickness)), exceeds_segment (over 5)."""
    bound = bind_nearest(openings, segments).select("image", "opening", "segment", "distance", "overhang")
    rows = openings.select("image", F.col("id").alias("opening"), "horizontal").join(bound, ["image", "opening"])
    walls = segments.select("image", F.col("id").alias("segment"), F.abs(F.col("x2") - F.col("x1")).alias("dx"), F.abs(F.col("y2") - F.col("y1")).alias("dy"), F.when(F.col("thickness") > 0, F.col("thickness")).otherwise(20.0).alias("thickness"))
    rows = rows.join(walls, ["image", "segment"], "left")
    aligned = F.when(F.col("horizontal"), F.col("dy") <= 0.27 * F.col("dx")).otherwise(F.col("dx") <= 0.27 * F.col("dy"))
    reasons = F.array_compact(F.array(
        F.when(F.col("segment").isNull(), "no_wall_segments"), F.when(~aligned, "misaligned_wall"),
        F.when(F.col("distance") > F.greatest(F.lit(20.0), 1.5 * F.col("thickness")), "far_from_wall"), F.when(F.col("overhang") > 5, "exceeds_segment"),
    ))
    return rows.select("image", "opening", reasons.alias("reasons"))


def preflight_summary(report: DataFrame) -> DataFrame:
    """image, examined, suspect and a count for each reason."""
    names = ("no_wall_segments", "misaligned_wall", "far_from_wall", "exceeds_segment")
    return report.groupBy("image").agg(F.count("*").alias("examined"), F.count_if(F.size("reasons") > 0).alias("suspect"), *(F.count_if(F.array_contains("reasons", n)).alias(n) for n in names))


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """image, fault, subject of a graph that can't be exported as simple and planar.

    nodes: image, id, x, y; edges: image, id, a, b, thickness. Faults: duplicate_id, duplicate_position, missing_node, degenerate_edge,
    duplicate_edge (in either direction), invalid_thickness, unnoded_crossing (two edges that meet anywhere but in a common end).
    """
    ids = nodes.groupBy("image", "id").agg(F.count("*").alias("n")).where("n > 1").select("image", F.lit("duplicate_id").alias("fault"), F.col("id").cast("string").alias("subject"))
    spots = nodes.groupBy("image", "x", "y").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("image", F.lit("duplicate_position").alias("fault"), F.col("id").cast("string").alias("subject"))
    at = lambda p: nodes.select("image", F.col("id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).dropDuplicates(["image", p])
    placed_edges = edges.join(at("a"), ["image", "a"], "left").join(at("b"), ["image", "b"], "left")
    one = F.array_compact(F.array(F.when(F.col("ax").isNull() | F.col("bx").isNull(), "missing_node"), F.when(F.col("a") == F.col("b"), "degenerate_edge"), F.when(~F.coalesce((F.col("thickness") > 0) & (F.col("thickness") < float("inf")), F.lit(False)), "invalid_thickness")))
    own = placed_edges.select("image", F.explode(one).alias("fault"), F.col("id").cast("string").alias("subject"))
    twice = edges.where("a <> b").groupBy("image", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1").select("image", F.lit("duplicate_edge").alias("fault"), F.col("id").cast("string").alias("subject"))
    lines = placed_edges.where("a <> b and ax is not null and bx is not null").select("image", "id", "a", "b", "ax", "ay", "bx", "by")
    p, q = (lines.select("image", *(F.col(c).alias(f"{s}{c}") for c in ("id", "a", "b", "ax", "ay", "bx", "by"))) for s in "pq")
    c = lambda name: F.col(name)
    meet = (F.least("pax", "pbx") <= F.greatest("qax", "qbx")) & (F.least("qax", "qbx") <= F.greatest("pax", "pbx")) & (F.least("pay", "pby") <= F.greatest("qay", "qby")) & (F.least("qay", "qby") <= F.greatest("pay", "pby"))
    side = lambda s, x, y: F.signum((c(f"{s}bx") - c(f"{s}ax")) * (c(y) - c(f"{s}ay")) - (c(f"{s}by") - c(f"{s}ay")) * (c(x) - c(f"{s}ax")))
    touch = (side("p", "qax", "qay") * side("p", "qbx", "qby") <= 0) & (side("q", "pax", "pay") * side("q", "pbx", "pby") <= 0)
    shared = (c("pa") == c("qa")) | (c("pa") == c("qb")) | (c("pb") == c("qa")) | (c("pb") == c("qb"))
    line = (side("p", "qax", "qay") == 0) & (side("p", "qbx", "qby") == 0)  # on one line, edges with a common end meet only there if they go apart
    dot = lambda s, end: (c(f"{s}{'b' if end == 'a' else 'a'}x") - c(f"{s}{end}x"), c(f"{s}{'b' if end == 'a' else 'a'}y") - c(f"{s}{end}y"))

    def folds(e: str, f: str) -> Column:
        (ux, uy), (vx, vy) = dot("p", e), dot("q", f)
        return (c(f"p{e}") == c(f"q{f}")) & (ux * vx + uy * vy > 0)

    overlapping = line & (folds("a", "a") | folds("a", "b") | folds("b", "a") | folds("b", "b"))
    crossing = p.join(q, "image").where(c("pid") < c("qid")).where(meet & touch & (~shared | overlapping))
    crossing = crossing.select("image", F.lit("unnoded_crossing").alias("fault"), F.concat_ws("-", "pid", "qid").alias("subject"))
    return ids.union(spots).union(own).union(twice).union(crossing)


def polygon_pairs(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """image, i, j, score: pairs of rings (image, id, ring) whose intersection over union is `least` at least. Invalid rings pair with nothing."""

    def boxed(df: DataFrame, s: str) -> DataFrame:
        xs, ys = F.transform("ring", lambda q: q["x"]), F.transform("ring", lambda q: q["y"])
        return df.where(ring_valid("ring")).select("image", F.col("id").alias(s), F.col("ring").alias(f"{s}r"), ring_area(F.col("ring")).alias(f"{s}a"), F.array_min(xs).alias(f"{s}x1"), F.array_max(xs).alias(f"{s}x2"), F.array_min(ys).alias(f"{s}y1"), F.array_max(ys).alias(f"{s}y2"))

    pairs = boxed(truth, "i").join(boxed(found, "j"), "image")
    boxes = overlap(F.col("ix1"), F.col("ix2"), F.col("jx1"), F.col("jx2")) * overlap(F.col("iy1"), F.col("iy2"), F.col("jy1"), F.col("jy2"))
    most = F.least(boxes, F.col("ia"), F.col("ja"))  # what they can share at most, so that few pairs reach the kernel
    likely = pairs.where((most > 0) & (most >= (least - 1e-9) * (F.col("ia") + F.col("ja") - most)))
    told = likely.withColumn("both", rings_share("ir", "jr"))
    return told.select("image", "i", "j", ratio(F.col("both"), F.col("ia") + F.col("ja") - F.col("both"), 0.0).alias("score")).where(F.col("score") >= least)


def same_rooms(before: DataFrame, after: DataFrame, least: float = 0.98) -> DataFrame:
    """image, same: whether the rooms (image, id, ring) of both states pair one to one at `least` intersection over union. Images of either side."""
    n = lambda df, name: df.groupBy("image").agg(F.count("*").alias(name))
    matched = greedy_match(polygon_pairs(before, after, least)).groupBy("image").agg(F.count("*").alias("m"))
    whole = n(before, "b").join(n(after, "a"), "image", "full_outer").join(matched, "image", "left").na.fill(0, ["a", "b", "m"])
    return whole.select("image", ((F.col("a") == F.col("b")) & (F.col("m") == F.col("b"))).alias("same"))


def detached_components(pixels: DataFrame) -> DataFrame:
    """image, component, area, radius of thin linework apart from the main walls. pixels: image, component, radius (its distance to the background).

    A component counts if its area is at least 64 and 1 %, and under 5 %, of the largest one's, and the 90th percentile of its radii is under a
    quarter of the wall thickness: twice the 75th percentile of all radii over 1, 2 at least. Images without such radii have none.
    """
    thick = pixels.where("radius > 1").groupBy("image").agg(F.greatest(F.lit(2.0), 2 * F.percentile("radius", 0.75)).alias("thickness"))
    own = pixels.groupBy("image", "component").agg(F.count("*").alias("area"), F.percentile("radius", 0.9).alias("radius"))
    most = own.groupBy("image").agg(F.max("area").alias("largest"))
    rows = own.join(most, "image").join(thick, "image")
    return rows.where((F.col("area") >= F.greatest(F.lit(64.0), 0.01 * F.col("largest"))) & (F.col("area") < 0.05 * F.col("largest")) & (F.col("radius") < 0.25 * F.col("thickness"))).select("image", "component", "area", "radius")


def supported_components(pixels: DataFrame, least_area: int = 24, least_share: float = 0.45) -> DataFrame:
    """image, component, area, supported of ink components that the model supports. pixels: image, component, support (boolean)."""
    own = pixels.groupBy("image", "component").agg(F.count("*").alias("area"), F.count_if("support").alias("supported"))
    return own.where((F.col("area") >= least_area) & (F.col("supported") >= least_share * F.col("area")))


def weighted_means(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, mean of `value` weighted by `weight`, and its plain median; null without any weight."""
    total = F.sum(weight)
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.when(total != 0, total)).alias("mean"), F.median(value).alias("median"))


def messages(issues: DataFrame) -> DataFrame:
    """image, errors, warnings (different messages in order of `ord`), codes of warnings (sorted). issues: image, ord, code, severity, message.

    Messages are first counted once each with their first place, so a plan's list holds different messages only.
    """
    once = issues.withColumn("kind", F.when(F.col("severity") == "error", "e").otherwise("w")).groupBy("image", "kind", "message").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set(F.when(F.col("severity") == "warning", F.col("code")))).alias("codes"))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "message")))), lambda s: s["message"])
    return once.groupBy("image").agg(listed("e").alias("errors"), listed("w").alias("warnings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def iou_line(names: list[str], values: Column) -> Column:
    """`name 0.912 | name 0.150 | ...`."""
    return F.array_join(F.transform(values, lambda v, i: F.format_string("%s %.3f", F.get(F.array(*(F.lit(n) for n in names)), i), v)), " | ")


def run_name(t: Column) -> Column:
    """A run's folder name from its local time."""
    return F.date_format(t, "yyyy-MM-dd_HH-mm-ss_SSSSSS")


def is_run_id(v: Column) -> Column:
    return F.coalesce(v.rlike("^[a-z0-9-]+$"), F.lit(False))


def manifest_faults(samples: DataFrame, split: str) -> DataFrame:
    """sample_id, fault of a manifest of reviewed masks. samples: sample_id, group_id, split, sha256, training_ready, group_review, actual_sha256.

    invalid_id (letters a-z, digits, - and _ only; once each), missing_metadata, crosses_splits (a group or content in two splits), and
    in `split` not_reviewed and changed_source. An empty split gives one row no_samples without an id.
    """
    twice = samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("sample_id").alias("twice"))
    cross = lambda c: samples.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col(c).alias(f"{c}_crosses"))
    rows = samples.join(twice, F.col("sample_id") == F.col("twice"), "left").join(cross("group_id"), F.col("group_id") == F.col("group_id_crosses"), "left").join(cross("sha256"), F.col("sha256") == F.col("sha256_crosses"), "left")
    sound = lambda c: F.coalesce(c, F.lit(False))
    own = F.col("split") == split
    faults = F.array_compact(F.array(
        F.when(~sound(F.col("sample_id").rlike("^[a-z0-9_-]+$")) | F.col("twice").isNotNull(), "invalid_id"),
        F.when(~sound(F.length("group_id") > 0) | ~sound(F.col("split").isin("train", "val", "test")) | F.col("sha256").isNull(), "missing_metadata"),
        F.when(F.col("group_id_crosses").isNotNull() | F.col("sha256_crosses").isNotNull(), "crosses_splits"),
        F.when(sound(own) & ~sound(F.col("training_ready") & (F.col("group_review") == "reviewed")), "not_reviewed"),
        F.when(sound(own) & ~sound(F.col("sha256") == F.col("actual_sha256")), "changed_source"),
    ))
    told = rows.select("sample_id", F.explode(faults).alias("fault"))
    none = samples.agg(F.count_if(own).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("sample_id"), F.lit("no_samples").alias("fault"))
    return told.union(none)


def exported_elements(openings: DataFrame) -> DataFrame:
    """Elements from templates: image, uuid, type, name, size_x, size_y, position, scale_x, hole.

    openings: image, id, kind, width, position, template_x, template_y (its size), low, high (its hole's limits in metres). Doors and passages get a
    rectangular hole of the measured width; a window's own hole is centred and scaled to it, and its body by the same factor. Heights are the
    template's; the uuid is a hash of image, kind and id. Rows without a positive template size, or windows without a hole, are left out.
    """
    window = F.col("kind") == "windowItem"
    sound = (F.least("template_x", "template_y") > 0) & (~window | (F.col("high") > F.col("low")))
    sx = F.when(window, F.col("width") / ((F.col("high") - F.col("low")) * 100))
    size = F.when(window, F.round(F.col("template_x") * sx, 4)).otherwise(F.round("width", 4))
    key = F.sha2(F.concat_ws(":", "image", "kind", "id"), 256)
    uid = F.concat_ws("-", *(F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    half = (F.col("high") - F.col("low")) / 2
    ring = lambda x, y: F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((-x, F.lit(0.0)), (x, F.lit(0.0)), (x, y), (-x, y))))
    hole = F.when(window, scaled_hole(ring(half, F.col("template_y") / 100), sx, F.lit(1.0))).otherwise(hole_shape(F.col("width"), F.col("template_y")))
    return openings.where(sound).select("image", uid.alias("uuid"), F.col("kind").alias("type"), F.concat(F.lit("graph_"), "kind", F.lit("_"), uid).alias("name"), size.alias("size_x"), F.col("template_y").alias("size_y"), "position", (size / F.col("template_x")).alias("scale_x"), hole.alias("hole"))

"""Aggregates over pixel classes, histograms and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ratio

IGNORE = 255


def confusion(pixels: DataFrame, classes: list[int], truth: str = "truth", found: str = "pred", weight: Column | None = None) -> DataFrame:
    """A row for each class: tp, fp, fn, iou = tp / max(1, tp + fp + fn). Pixels whose truth is 255 don't count.

    One pass of conditional sums over truth x prediction counts; a class without pixels has an iou of 0.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    cells = pixels.where(F.col(truth) != IGNORE).groupBy(truth, found).agg(n.alias("n"))
    dims = pixels.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    t, p = F.col(truth) == F.col("class"), F.col(found) == F.col("class")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    sums = dims.join(cells, t | p, "left").groupBy("class").agg(add(t & p).alias("tp"), add(~t & p).alias("fp"), add(t & ~p).alias("fn"))
    return sums.select("class", "tp", "fp", "fn", (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("fn"))).alias("iou"))


def class_counts(pixels: DataFrame, by: list[str], label: str, classes: list[int]) -> DataFrame:
    """Pixels of each class and ignored ones, a column each, for every group."""
    return pixels.groupBy(*by).agg(*(F.count_if(F.col(label) == c).alias(f"class_{c}") for c in classes), F.count_if(F.col(label) == IGNORE).alias("ignored"))


def area_rates(pixels: DataFrame, truth: str = "truth", found: str = "pred") -> DataFrame:
    """precision, recall, f1 and iou of two masks, for each image as a whole (region null) and for each region."""
    sums = pixels.groupingSets([("image",), ("image", "region")], "image", "region").agg(F.grouping("region").alias("whole"), *(F.count_if(c).alias(n) for c, n in ((F.col(truth) & F.col(found), "both"), (F.col(truth), "t"), (F.col(found), "p"))))
    both, t, p = F.col("both"), F.col("t"), F.col("p")
    return sums.select("image", "region", F.col("whole").cast("int").alias("whole"), ratio(both, p).alias("precision"), ratio(both, t).alias("recall"), ratio(2 * both, t + p).alias("f1"), ratio(both, t + p - both).alias("iou"))


def peak(rows: DataFrame, by: list[str], level: str) -> DataFrame:
    """The level with most rows of each group (ties: the lowest) and its count."""
    n = rows.groupBy(*by, level).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max(F.struct("n", (-F.col(level)).alias("neg"))).alias("m")).select(*by, (-F.col("m.neg")).alias("peak"), F.col("m.n").alias("n"))


def votes(rows: DataFrame, by: list[str], value: str, order: str, least: int) -> DataFrame:
    """The value with most votes of each group, ties to the first seen in `order`; groups where it has fewer than `least` go."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = n.groupBy(*by).agg(F.max(F.struct("n", (-F.col("seen")).alias("late"), value)).alias("m"))
    return best.where(F.col("m.n") >= least).select(*by, F.col(f"m.{value}").alias(value), F.col("m.n").alias("votes"))


def screen(before: DataFrame, after: DataFrame, key: list[str], metrics: dict[str, float]) -> DataFrame:
    """Before and after joined on key: failed lists metrics that fell by more than allowed, or `cohort` if a side lacks the key."""
    a, b = before.select(*key, F.lit(True).alias("had"), *(F.col(m).alias(f"a_{m}") for m in metrics)), after.select(*key, F.lit(True).alias("has"), *(F.col(m).alias(f"b_{m}") for m in metrics))
    fell = [F.when(F.col(f"a_{m}") - F.col(f"b_{m}") > drop, F.lit(m)) for m, drop in metrics.items()]
    lost = F.when(F.col("had").isNull() | F.col("has").isNull(), F.lit("cohort"))
    failed = F.array_join(F.array_compact(F.array(lost, *fell)), ",")
    return a.join(b, key, "full_outer").select(*key, *((F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"d_{m}") for m in metrics), failed.alias("failed"), (failed == "").alias("accepted"))


def scale_errors(lines: DataFrame) -> DataFrame:
    """image, line, error: how far each dimension line is from its length at the image's scale; null for all lines of an image if one
    of them has no positive length, scale or extent."""
    bad = ~F.coalesce((F.col("scale") > 0) & (F.col("length") > 0) & (F.col("pixels") > 0), F.lit(False))
    sound = lines.groupBy("image").agg(F.bool_or(bad).alias("bad"))
    return lines.join(sound, "image").select("image", "line", F.when(~F.col("bad"), F.abs(F.col("pixels") - F.col("length") / F.col("scale"))).alias("error"))


#: Places of the classes in a probability list.
FLOOR, WALL, DOOR, WINDOW = range(4)


def fuse_passes(pixels: DataFrame) -> DataFrame:
    """image, pixel, probabilities, class of the fused passes. pixels: image, pixel, original, normalized (arrays of four probabilities).

    The normalised pass stands. Where an image's original pass sees at least 9/20 as many wall pixels (by greatest probability, the first of equal
    ones) as the normalised one, pixels that the normalised pass calls floor are rescued: as wall if the original says wall at 0.72 while
    the normalised has 0.18 of wall and under 0.80 of floor (to 0.92 of the original), as door or window if the original says so at 0.75
    while wall, door and window have 0.25 together (to 0.90 of the original).
    """
    best = lambda p: F.array_position(p, F.array_max(p)) - 1
    o, n = F.col("original"), F.col("normalized")
    rows = pixels.select("image", "pixel", "original", "normalized", best(o).alias("oc"), best(n).alias("nc"))
    walls = lambda c: F.count_if(F.col(c) == WALL)
    sure = rows.groupBy("image").agg((walls("oc") * 20 >= F.greatest(walls("nc"), F.lit(1)) * 9).alias("sure"))
    floor = F.col("sure") & (F.col("nc") == FLOOR)
    wall = floor & (F.col("oc") == WALL) & (o[WALL] >= 0.72) & (n[WALL] >= 0.18) & (n[FLOOR] < 0.80)
    frame = n[WALL] + n[DOOR] + n[WINDOW] >= 0.25
    opening = lambda c: F.when(floor & (F.col("oc") == c) & (o[c] >= 0.75) & frame, F.greatest(n[c], o[c] * 0.90)).otherwise(n[c])
    fused = F.array(n[FLOOR], F.when(wall, F.greatest(n[WALL], o[WALL] * 0.92)).otherwise(n[WALL]), opening(DOOR), opening(WINDOW))
    out = rows.join(sure, "image").select("image", "pixel", fused.alias("probabilities"))
    return out.withColumn("class", best(F.col("probabilities")).cast("int"))

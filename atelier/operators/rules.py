"""Filters, rollups and decisions that need a join or two and a ladder of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap, ratio
from .evidence import ladder


def recoverable(rejected: DataFrame, known: DataFrame, least_length: float = 15.0, most_share: float = 0.2) -> DataFrame:
    """Rejected rows whose only reason is too_thick, long enough, and that no known interval of their line covers by over `most_share`."""
    only = rejected.where((F.array_join("reasons", ",") == "too_thick") & (F.col("high") - F.col("low") >= least_length))
    k = known.select("image", "pos", F.col("low").alias("k_low"), F.col("high").alias("k_high"))
    share = overlap(F.col("low"), F.col("high"), F.col("k_low"), F.col("k_high")) / (F.col("high") - F.col("low"))
    taken = only.join(k, ["image", "pos"]).where(share > most_share).select("image", "id").distinct()
    return only.join(taken, ["image", "id"], "left_anti")


def non_rectangular(polygons: DataFrame, least: float = 0.9) -> DataFrame:
    """For each image how many polygons fill less than `least` of their box. Columns: image, area, box_area."""
    return polygons.groupBy("image").agg(F.count_if(ratio(F.col("area"), F.col("box_area"), 0.0) < least).alias("n"), F.count("*").alias("polygons"))


def confirmed_passages(doors: DataFrame, passages: DataFrame) -> DataFrame:
    """Doors and passages of interior gaps that a user confirmed, with their kind."""
    both = doors.withColumn("kind", F.lit("door")).unionByName(passages.withColumn("kind", F.lit("passage")))
    return both.where(F.col("interior") & F.col("confirmed"))


def answer_errors(answers: DataFrame, keys: list[str], choices: dict[str, list[str]]) -> DataFrame:
    """Answers without exactly one id key, or whose choice is not one of that key's: answer, error."""
    given = F.size(F.filter(F.array(*(F.col(k) for k in keys)), lambda x: x.isNotNull()))
    key = F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys))
    allowed = None
    for k in keys:
        ok = (key == k) & F.col("choice").isin(choices[k])
        allowed = ok if allowed is None else allowed | ok
    error = ladder([(given != 1, "id_keys"), (~F.coalesce(allowed, F.lit(False)), "choice")], "")
    return answers.select("answer", error.alias("error")).where("error <> ''")


def run_rollup(cases: DataFrame) -> DataFrame:
    """Per run: cases, annotated ones, those whose counts are exact, and summed tp, fp, fn; null rows of expected are not annotated."""
    known = F.col("expected").isNotNull()
    exact = known & (F.col("expected") == F.col("predicted"))
    add = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).cast("long")
    return cases.groupBy("run").agg(F.count("*").alias("cases"), F.count_if(known).alias("annotated"), F.count_if(exact).alias("exact"), add("tp").alias("tp"), add("fp").alias("fp"), add("fn").alias("fn"))


def changed_area(before: DataFrame, after: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels gained and lost in each box. before, after: image, x, y; boxes: image, id, x1, y1, x2, y2 (ends included)."""
    both = before.select("image", "x", "y", F.lit(-1).alias("d")).union(after.select("image", "x", "y", F.lit(1).alias("d"))).groupBy("image", "x", "y").agg(F.sum("d").alias("d")).where("d <> 0")
    hit = both.join(boxes, "image").where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))).groupBy("image", "id").agg(F.count_if(F.col("d") > 0).alias("gained"), F.count_if(F.col("d") < 0).alias("lost"))
    return boxes.select("image", "id").join(hit, ["image", "id"], "left").na.fill(0, ["gained", "lost"])


def ranked_apart(candidates: DataFrame, most: int = 24, apart: float = 5.0) -> DataFrame:
    """Of the `most` shortest candidates of an image those that no shorter one has its middle within `apart` of. Columns: image, id, length, mid."""
    w = Window.partitionBy("image").orderBy("length", "id")
    few = candidates.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    other = few.select("image", F.col("k").alias("j"), F.col("mid").alias("m"))
    near = few.join(other, "image").where((F.col("j") < F.col("k")) & (F.abs(F.col("m") - F.col("mid")) <= apart)).select("image", "k").distinct()
    return few.join(near, ["image", "k"], "left_anti")


def best_hinge(candidates: DataFrame) -> DataFrame:
    """The candidate with most arc hits for each opening, then the nearest hinge, then the least id."""
    best = F.max(F.struct("hits", (-F.col("distance")).alias("near"), (-F.col("id")).alias("low"))).alias("m")
    return candidates.groupBy("image", "opening").agg(best).select("image", "opening", (-F.col("m.low")).alias("id"))


def selected_buckets(chosen: DataFrame, reserved: DataFrame, bucket: str, key: str) -> DataFrame:
    """bucket, n of the chosen rows, and how many of them are in the reserved list too (a selection that leaks)."""
    r = reserved.select(key).distinct().withColumn("leak", F.lit(1))
    return chosen.join(r, key, "left").groupBy(bucket).agg(F.count("*").alias("n"), F.count("leak").alias("leaks"))


def boundary_class(share: Column, parallel: Column) -> Column:
    """How an unsupported edge is explained by a source boundary along `share` of it."""
    return ladder([(parallel & (share >= 0.55), "supported"), (parallel & (share >= 0.50), "probable"), (share >= 0.15, "partial")], "unsupported")


def side_support(borders: DataFrame) -> DataFrame:
    """For each side of a box the share of supported samples and its longest unsupported run. Columns: image, id, side, pos, on."""
    w = Window.partitionBy("image", "id", "side").orderBy("pos")
    off = borders.withColumn("g", F.sum(F.col("on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = off.groupBy("image", "id", "side", "g").agg(F.count_if(~F.col("on")).alias("off"), F.count_if("on").alias("on_n"))
    return runs.groupBy("image", "id", "side").agg((F.sum("on_n") / F.sum(F.col("on_n") + F.col("off"))).alias("support"), F.max("off").alias("longest_gap"))


def profile_of(images: DataFrame, exact: DataFrame, opaque: DataFrame) -> DataFrame:
    """The profile of each image: by the hash of its bytes, else by that of its opaque pixels, else `default`."""
    a, b = exact.select("byte_hash", F.col("profile").alias("by_bytes")), opaque.select("pixel_hash", F.col("profile").alias("by_pixels"))
    return images.join(a, "byte_hash", "left").join(b, "pixel_hash", "left").select("id", F.coalesce("by_bytes", "by_pixels", F.lit("default")).alias("profile"))

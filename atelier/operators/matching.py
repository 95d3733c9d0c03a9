"""One-to-one matching of predictions to truth, and the reports made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axial_difference, box_iou, distance, ratio
from ..scratch import stored


def greedy_match(pairs: DataFrame, key: str = "image", left: str = "i", right: str = "j", score: str = "score") -> DataFrame:
    """The pairs that a greedy pass over (score, i, j) descending accepts, each left and right once within its key.

    A pair that is first for both its ends would be accepted by the sequential pass too, whatever stands elsewhere. All
    such pairs are taken at once, their ends' other pairs go, and so on: rounds grow with the longest chain of
    contested pairs, not with the data. Rows stay distributed by key and end; each round is a written table.
    """
    order = [F.desc(score), F.desc(left), F.desc(right)]
    first = lambda end: F.row_number().over(Window.partitionBy(key, end).orderBy(*order)) == 1
    left_over, taken = stored(pairs.select(key, left, right, score), "pairs"), None
    while True:
        marked = stored(left_over.withColumn("l1", first(left)).withColumn("r1", first(right)), "pairs")
        now = marked.where("l1 and r1").select(key, left, right, score)
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else taken.union(now)
        left_over = marked.select(key, left, right, score).join(now.select(key, left), [key, left], "left_anti").join(now.select(key, right), [key, right], "left_anti")


def opening_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Openings whose centres, axes and lengths agree. Columns of both: image, kind, id, cx, cy, angle, length.

    Centres within max(12, 0.3 length) of the truth, axes within 25 degrees, length ratio of 0.45 at least; the score is the product
    of what is left of each. Scores of 1e-9 or less don't match.
    """
    t, p = truth.select("image", "kind", *(F.col(c).alias(f"t_{c}") for c in ("id", "cx", "cy", "angle", "length"))), found.select("image", "kind", *(F.col(c).alias(f"p_{c}") for c in ("id", "cx", "cy", "angle", "length")))
    both = t.join(p, ["image", "kind"])
    d, turn = distance(F.col("t_cx"), F.col("t_cy"), F.col("p_cx"), F.col("p_cy")), axial_difference(F.col("t_angle"), F.col("p_angle"))
    limit, part = F.greatest(F.lit(12.0), 0.3 * F.col("t_length")), ratio(F.least("t_length", "p_length"), F.greatest("t_length", "p_length"))
    near = both.where((d <= limit) & (turn <= 25) & (part >= 0.45))
    return near.select("image", "kind", F.col("t_id").alias("i"), F.col("p_id").alias("j"), ((1 - d / limit) * (1 - turn / 180) * part).alias("score")).where("score > 1e-9")


def room_pairs(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of boxes of one image whose intersection over union reaches `least`."""
    t, p = (df.select("image", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "x1", "y1", "x2", "y2"))) for df, s in ((truth, "t"), (found, "p")))
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2"))
    touch = (F.col("t_x1") < F.col("p_x2")) & (F.col("p_x1") < F.col("t_x2")) & (F.col("t_y1") < F.col("p_y2")) & (F.col("p_y1") < F.col("t_y2"))
    return t.join(p, "image").where(touch).select("image", F.col("t_id").alias("i"), F.col("p_id").alias("j"), box_iou(box("t"), box("p")).alias("score")).where(F.col("score") >= least)


def junction_pairs(truth: DataFrame, found: DataFrame, reach: float = 12.0) -> DataFrame:
    """Junctions of one type within `reach`; a pair at exactly that distance matches with score 0."""
    t, p = truth.select("image", "type", F.col("id").alias("i"), F.col("x").alias("tx"), F.col("y").alias("ty")), found.select("image", "type", F.col("id").alias("j"), F.col("x").alias("px"), F.col("y").alias("py"))
    d = distance(F.col("tx"), F.col("ty"), F.col("px"), F.col("py"))
    return t.join(p, ["image", "type"]).where(d <= reach).select("image", "type", "i", "j", (1 - d / reach).alias("score"))


def report(truth: DataFrame, found: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """expected, predicted, tp, fp, fn, precision, recall and f1 for each group that occurs on either side.

    An empty side counts as right: nothing expected and nothing predicted is 1.
    """
    counts = [df.groupBy(*by).agg(F.count("*").alias(n)) for df, n in ((truth, "expected"), (found, "predicted"), (matched, "tp"))]
    all_of = counts[0].join(counts[1], by, "full_outer").join(counts[2], by, "left").na.fill(0, ["expected", "predicted", "tp"])
    return rates(all_of, by)


def rates(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rates of columns expected, predicted and tp."""
    tp, e, p = F.col("tp"), F.col("expected"), F.col("predicted")
    return counts.select(*by, "expected", "predicted", "tp", (p - tp).alias("fp"), (e - tp).alias("fn"), ratio(tp, p).alias("precision"), ratio(tp, e).alias("recall"), ratio(2 * tp, e + p).alias("f1"))


def outside_regions(rows: DataFrame, regions: DataFrame, x: str = "cx", y: str = "cy") -> DataFrame:
    """Rows whose point lies in none of its image's boxes (ends included); images without boxes lose nothing."""
    r = regions.select(F.col("image").alias("r_image"), *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = (F.col("image") == F.col("r_image")) & F.col(x).between(F.col("r_x1"), F.col("r_x2")) & F.col(y).between(F.col("r_y1"), F.col("r_y2"))
    return rows.join(r, inside, "left_anti")


def coverage_report(images: DataFrame, categories: list[str], expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """For every image and category: expected and predicted counts and whether they agree; a missing annotation stays null.

    expected: image, category, expected; a row with a 0 is annotated as empty, no row as not annotated.
    """
    dims = images.select("image").distinct().select("image", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    n = predicted.groupBy("image", "category").agg(F.count("*").alias("predicted"))
    whole = dims.join(expected, ["image", "category"], "left").join(n, ["image", "category"], "left").na.fill(0, ["predicted"])
    return whole.select("image", "category", "expected", "predicted", (F.col("expected") == F.col("predicted")).alias("exact"))

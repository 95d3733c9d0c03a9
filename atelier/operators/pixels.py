"""Raster operators on pixel tables (image, x, y): neighbours are joins, so an image may be larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

KEY = ["image", "x", "y"]


def _offsets(r: int, cross: bool = False):
    cells = [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if not cross or not dx or not dy]
    return F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in cells)))


def dilate(pixels: DataFrame, size: int = 3, cross: bool = False) -> DataFrame:
    """Pixels within the kernel of a set one; the image has no border here."""
    moved = pixels.select(*KEY, _offsets(size // 2, cross).alias("o"))
    return moved.select("image", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()


def erode(pixels: DataFrame, size: int = 3, cross: bool = False) -> DataFrame:
    """Set pixels whose whole kernel is set: each is told by as many neighbours as the kernel has cells."""
    r = size // 2
    cells = 2 * size - 1 if cross else size * size
    told = pixels.select(*KEY).distinct().select(*KEY, _offsets(r, cross).alias("o")).select("image", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return told.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") == cells).drop("n")


def components(pixels: DataFrame, diagonal: bool = True) -> DataFrame:
    """image, root, n, box and centroid of the components of set pixels (8 or 4 neighbours).

    Runs of a row are nodes, so the graph has a node a run and not a pixel.
    """
    from .islands import supported_runs

    runs = supported_runs(pixels.select(*KEY).distinct().withColumn("on", F.lit(True)), ["image", "y"], "x", "on", 1).withColumn("node", F.col("y") * (1 << 31) + F.col("start"))
    reach = 1 if diagonal else 0
    up = runs.select("image", (F.col("y") + 1).alias("y"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("node").alias("above"))
    touch = runs.join(up, ["image", "y"]).where((F.col("start") <= F.col("e") + reach) & (F.col("s") <= F.col("end") + reach))
    root = graph.components(touch.select("image", F.col("node").alias("a"), F.col("above").alias("b")))
    named = runs.join(root, ["image", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    sums = (F.col("start") + F.col("end")) * F.col("length") / 2
    return named.groupBy("image", "root").agg(F.sum("length").alias("n"), F.min("start").alias("x1"), F.max("end").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), (F.sum(sums) / F.sum("length")).alias("cx"))


def excluded(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels within a box of their image, ends included."""
    b = boxes.select("image", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = (pixels.image == b.image) & F.col("x").between(F.col("b_x1"), F.col("b_x2")) & F.col("y").between(F.col("b_y1"), F.col("b_y2"))
    return pixels.join(b, inside, "left_semi")


def painted(shapes: DataFrame, order: dict[str, int]) -> DataFrame:
    """image, x, y, cls: boxes of classes painted in order, later ones over earlier. Columns: image, cls, x1, y1, x2, y2 (ends included)."""
    rank = F.create_map(*(F.lit(v) for kv in order.items() for v in kv))[F.col("cls")]
    cells = shapes.select("image", "cls", rank.alias("rank"), "y1", "y2", F.explode(F.sequence("x1", "x2")).alias("x")).select("image", "cls", "rank", "x", F.explode(F.sequence("y1", "y2")).alias("y"))
    return cells.groupBy(*KEY).agg(F.max_by("cls", "rank").alias("cls"))


def resample(pixels: DataFrame, factor_x: int, factor_y: int, value: str) -> DataFrame:
    """Nearest sampling to a raster smaller by whole factors: the pixel at each cell's middle."""
    at = (F.col("x") % factor_x == factor_x // 2) & (F.col("y") % factor_y == factor_y // 2)
    return pixels.where(at).select("image", F.floor(F.col("x") / factor_x).alias("x"), F.floor(F.col("y") / factor_y).alias("y"), value)

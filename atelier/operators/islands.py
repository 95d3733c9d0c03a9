"""Runs, islands and other ordered scans, as window functions over their own key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values: key, run (from 1), value, n, first and last of the first order column."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    marked = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def supported_runs(samples: DataFrame, key: list[str], pos: str, supported: str, least: float = 3.0) -> DataFrame:
    """Maximal runs of consecutive supported positions that are `least` long at least: key, start, end, length."""
    w = Window.partitionBy(*key).orderBy(pos)
    island = F.col(pos) - F.row_number().over(w)
    found = samples.where(supported).withColumn("island", island).groupBy(*key, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("length"))
    return found.where(F.col("length") >= least).drop("island")


def paired_runs(found: DataFrame, key: list[str], most_gap: float) -> DataFrame:
    """Each run and the next one of its line, where the gap between them is at most `most_gap`."""
    w = Window.partitionBy(*key).orderBy("start")
    ahead = found.withColumn("next_start", F.lead("start").over(w)).withColumn("next_end", F.lead("end").over(w))
    gap = F.col("next_start") - F.col("end") - 1
    return ahead.where(gap <= most_gap).select(*key, "start", "end", "next_start", "next_end", gap.alias("gap"))


def bands(row_gaps: DataFrame, key: list[str], row: str = "row", least: int = 2, most: int = 1 << 30) -> DataFrame:
    """Consecutive rows with the same (start, end) merged to bands of `least` to `most` rows."""
    w = Window.partitionBy(*key, "start", "end").orderBy(row)
    merged = row_gaps.withColumn("island", F.col(row) - F.row_number().over(w)).groupBy(*key, "start", "end", "island")
    return merged.agg(F.min(row).alias("top"), F.max(row).alias("bottom"), F.count("*").alias("height")).where(F.col("height").between(least, most)).drop("island")


def profile_bands(samples: DataFrame, key: list[str], pos: str, value: str, cut: float) -> DataFrame:
    """Of the mean profile along `pos`, the islands at `cut` or more; unique says whether the key has just one."""
    profile = samples.groupBy(*key, pos).agg(F.avg(value).alias("support"))
    found = supported_runs(profile.withColumn("on", F.col("support") >= cut), key, pos, "on", 1)
    return found.withColumn("unique", F.count("*").over(Window.partitionBy(*key)) == 1)


def best_so_far(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds best (greatest before this row) and is_best (strictly over it; the first row is)."""
    before = F.max(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("best", before).withColumn("is_best", F.col("best").isNull() | (F.col(value) > F.col("best")))


def snap_in_order(values: Column, tolerance: float) -> Column:
    """Array of each value moved to the first earlier kept value within the tolerance; other values are kept themselves."""

    def step(state: Column, v: Column) -> Column:
        near = F.filter(state["kept"], lambda k: F.abs(k - v) <= tolerance)
        own = F.coalesce(F.get(near, F.lit(0)), v)
        return F.struct(F.when(F.size(near) == 0, F.concat(state["kept"], F.array(v))).otherwise(state["kept"]).alias("kept"), F.concat(state["out"], F.array(own)).alias("out"))

    none = F.array().cast("array<double>")
    return F.aggregate(values, F.struct(none.alias("kept"), none.alias("out")), step, lambda s: s["out"])

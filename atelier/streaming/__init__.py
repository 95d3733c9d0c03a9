"""Ordered review steps and resumable work, as batch folds and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "image long, id long, choice string, steps long"


def review_state(steps: DataFrame) -> DataFrame:
    """The last choice for each (image, id) and how many steps it had. Columns: image, id, step, choice; `undo` takes a choice back.

    Last by step (ties: the greater choice): a grouped maximum, so no image's log is gathered.
    """
    last = steps.groupBy("image", "id").agg(F.max(F.struct("step", "choice")).alias("m"), F.count("*").alias("steps"))
    return last.select("image", "id", F.when(F.col("m.choice") != "undo", F.col("m.choice")).alias("choice"), "steps")


def review_stream(steps: DataFrame) -> DataFrame:
    """review_state over a stream in update mode: the state of each (image, id) after each batch."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        step, choice, n = state.get if state.exists else (-1, "", 0)
        for pdf in parts:
            for s, c in zip(pdf["step"], pdf["choice"], strict=True):
                step, choice = max((step, choice), (int(s), c))
                n += 1
        state.update((step, choice, n))
        yield pd.DataFrame([(key[0], key[1], None if choice == "undo" else choice, n)], columns=["image", "id", "choice", "steps"])

    return steps.groupBy("image", "id").applyInPandasWithState(fold, STATE, "step long, choice string, steps long", "update", "NoTimeout")


def not_yet_done(work: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key (such as id, settings hash and content hash) no cached result has."""
    return work.join(cache.select(*key).distinct(), key, "left_anti")


def run_stages(start: DataFrame, stages: list[tuple[str, object]], gate=None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Applies named stages in order, each result written; (last result, rows after each). gate(name, df) may raise to stop."""
    from ..scratch import stored

    df, counts = start, []
    for name, stage in stages:
        df = stored(stage(df), name)
        counts.append((name, df.count()))
        if gate:
            gate(name, df)
    return df, counts

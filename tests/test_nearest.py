"""Nearest vectors against plain sums, ties and odd vectors included, and many of them."""

import math
import random
import time

from pyspark.sql import functions as F

from atelier.operators import curation


def _score(q, v):
    if q is None or v is None or len(q) != len(v) or None in q or None in v:
        return None
    total = 0.0
    for x, y in zip(q, v, strict=True):
        total += x * y
    return total


def _order(score):
    return (1, 0.0) if score is None else (0, -math.inf, 0) if math.isnan(score) else (0, 0.0, -score)


def test_agrees_with_plain_sums(spark):
    rnd = random.Random(5)
    odd = [None, [], [1.0], [None, 1.0, 2.0], [math.nan, 0.0, 1.0], [math.inf, 1.0, 0.0], [0.0, 0.0, 0.0], [1e200, 1e200, -1e200]]
    rows = [(k, [rnd.choice([-1.0, 0.1, 0.2, 0.3, 1.0]) for _ in range(3)]) for k in range(150)]
    for cut, k in ((rows, 5), (rows + [(200 + i, v) for i, v in enumerate(odd)], 5), ([(200 + i, v) for i, v in enumerate(odd)], 20), (rows[:3], 5)):
        df = spark.createDataFrame([*cut, (None, [1.0, 1.0, 1.0])], "id long, v array<double>")
        queries = df.where("id % 4 = 0")
        want = set()
        for id_, q in cut:
            if id_ % 4 == 0:
                others = sorted((x for x in cut if x[0] != id_), key=lambda x: (*_order(_score(q, x[1])), x[0]))
                want |= {(id_, o, r + 1) for r, (o, _) in enumerate(others[:k])}
        for block in (5000, 10):
            assert {(r["query"], r["id"], r["rank"]) for r in curation.nearest(queries, df, k, block).collect()} == want


def test_many_vectors(spark):
    """60,000 vectors against 3,000 queries."""
    df = spark.range(60_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: F.sin(F.col("id") * (d + 1) * 0.37)).alias("v"))
    began = time.time()
    assert curation.nearest(df.where("id % 20 = 0"), df).count() == 15_000
    assert time.time() - began < 60

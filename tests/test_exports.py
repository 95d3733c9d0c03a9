"""Exporting operators: closed forms against sampling, crossings against exact arithmetic, hand-worked reports."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from atelier import sources
from atelier.operators import exporting


def test_length_in_a_strip_against_sampling(spark):
    rng = random.Random(4)
    rows = [[rng.uniform(-10, 10) for _ in range(8)] + [rng.uniform(0.5, 6)] for _ in range(60)]
    rows += [[0.0, 1.0, 8.0, 1.0, 2.0, 0.0, 6.0, 0.0, 2.0], [0.0, 3.0, 8.0, 3.0, 2.0, 0.0, 6.0, 0.0, 2.0], [0.0, 0.0, 5.0, 0.0, 1.0, 1.0, 1.0, 1.0, 2.0], [4.0, -9.0, 4.0, 9.0, 2.0, 0.0, 6.0, 0.0, 2.0]]
    names = ["ax", "ay", "bx", "by", "x1", "y1", "x2", "y2", "half"]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} double" for n in names))
    got = [r["v"] for r in df.select(exporting.length_in_strip(*(F.col(n) for n in names)).alias("v")).collect()]
    for (ax, ay, bx, by, x1, y1, x2, y2, half), v in zip(rows, got, strict=True):
        size, own = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5, ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        hit = 0
        for k in range(2000):
            t = (k + 0.5) / 2000
            px, py = ax + t * (bx - ax) - x1, ay + t * (by - ay) - y1
            if size:
                s, d = (px * (x2 - x1) + py * (y2 - y1)) / size, (py * (x2 - x1) - px * (y2 - y1)) / size
                hit += 0 <= s <= size and -half <= d <= half
        assert v == pytest.approx(hit / 2000 * own, abs=own / 500)


def test_crossings_against_fractions(spark):
    """Edges that meet anywhere but in a common end, by exact intersection of lines."""
    rng = random.Random(9)
    spots = [(x, y) for x in range(5) for y in range(5)]
    nodes = [(k, i, float(x), float(y)) for k in range(12) for i, (x, y) in enumerate(rng.sample(spots, 10))]
    at = {(k, i): (Fraction(int(x)), Fraction(int(y))) for k, i, x, y in nodes}
    edges = [(k, e, rng.randrange(10), rng.randrange(10), 4.0) for k in range(12) for e in range(14)]

    def meets(k, e, f):
        a, b, c, d = at[k, e[2]], at[k, e[3]], at[k, f[2]], at[k, f[3]]
        cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
        common = {a, b} & {c, d}
        if cross(a, b, c) == cross(a, b, d) == 0:
            along = lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
            lo, hi = max(0, min(along(c), along(d))), min(along(b), max(along(c), along(d)))
            return hi > lo or (hi == lo and not common)
        sides = cross(a, b, c) * cross(a, b, d) <= 0 and cross(c, d, a) * cross(c, d, b) <= 0
        return sides and not common

    want = {(k, f"{e[1]}-{f[1]}") for k in range(12) for e in edges if e[0] == k for f in edges if f[0] == k and e[1] < f[1] and e[2] != e[3] and f[2] != f[3] and meets(k, e, f)}
    found = exporting.graph_faults(spark.createDataFrame(nodes, "image long, id long, x double, y double"), spark.createDataFrame(edges, "image long, id long, a long, b long, thickness double"))
    assert {(r["image"], r["subject"]) for r in found.where("fault = 'unnoded_crossing'").collect()} == want and len(want) > 50


def test_preflight_and_placement(spark):
    o = spark.createDataFrame([(1, 1, 15.0, 2.0, 40.0, True), (1, 2, 60.0, 40.0, 40.0, True), (1, 3, 50.0, 0.0, 30.0, True), (2, 9, 0.0, 0.0, 30.0, True)], "image long, id long, cx double, cy double, length double, horizontal boolean")
    s = spark.createDataFrame([(1, 7, 0.0, 0.0, 100.0, 0.0, 20.0)], "image long, id long, x1 double, y1 double, x2 double, y2 double, thickness double")
    got = {r["opening"]: r for r in exporting.placed(o, s).collect()}
    assert (got[1]["index"], got[1]["width"], got[1]["position"], got[1]["fitted"]) == (1, 40.0, 20.0, True)
    assert got[2]["unplaced"] == "" and not got[2]["fitted"] and got[3]["position"] == 50.0
    assert (got[9]["unplaced"], got[9]["width"], got[9]["index"]) == ("no_wall_segments", None, 1)
    report = {r["image"]: r.asDict() for r in exporting.preflight_summary(exporting.preflight(o, s)).collect()}
    assert report[1] == {"image": 1, "examined": 3, "suspect": 1, "no_wall_segments": 0, "misaligned_wall": 0, "far_from_wall": 1, "exceeds_segment": 0}
    assert report[2]["suspect"] == report[2]["no_wall_segments"] == 1


def test_pruned_svg(spark):
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><g class="Wall"><rect id="a"/><g class="x TextLabel"><rect id="b" class="Name"/></g></g><g class="FixedFurniture"/></svg>'
    out = sources.pruned_svg(svg)
    assert 'id="a"' in out and 'id="b"' not in out and "FixedFurniture" not in out
    rows = spark.createDataFrame([(svg,), (None,), ("<svg",)], "s string").select(sources.pruned(F.col("s")).alias("p")).collect()
    assert rows[0]["p"] == out and rows[1]["p"] is None and rows[2]["p"] is None

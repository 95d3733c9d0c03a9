"""Rules whose expected values are worked out by hand, kernels against brute force, and sizes beyond old limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atelier import sources
from atelier.functions import polygons, raster, scalars
from atelier.operators import binding, gate, graph, matching, metrics
from atelier.plans import gate_cases


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fit_opening(spark):
    fit = lambda w, pos, n, th, least: one(spark, scalars.fit_opening(*(F.lit(float(x)) for x in (w, pos, n, th, least))))
    assert tuple(fit(40, 15, 100, 20, 20)) == (40.0, 20.0)  # -5..35 is shifted to 0..40
    assert fit(40, 15, 100, 8, 20) is None  # over half the thickness
    assert fit(40, 50, 100, 20, 20) is None  # fits already
    assert tuple(fit(40, 50, 32, 20, 20)) == (32.0, 50.0)
    assert fit(40, 50, 32, 20, 35) is None and fit(40, 50, 29, 20, 20) is None


def test_door_width(spark):
    width = lambda w, c, r=0.0, n=1.0, ok=None: one(spark, scalars.door_width(F.lit(float(w)), F.lit(c), F.lit(r), F.lit(n), F.lit(ok).cast("boolean")))
    assert width(80, "measured_swing", 30.0, 40.0) == 60 and width(80, "measured_swing", 50.0, 40.0) == 80
    assert width(80, "surveyed_door") == 80 and width(80, "unmarked_interior_gap", ok=True) == 80
    assert width(80, "unmarked_interior_gap") == pytest.approx(89.6) and width(10, None) == 40


def test_shown_time_is_the_same_in_every_session_zone(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(spark, scalars.shown_time(scalars.offset_time(F.lit("2026-03-08T02:30:05+00:00")))) == "08.03.2026 05:30 МСК"
            assert one(spark, scalars.shown_time(scalars.offset_time(F.lit("2026-03-08T02:30:05")))) == "не указана"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_hidden_shapes():
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><g class="Wall">%s</g><rect class="Door Wall" width="2" height="1"/></svg>'
    for hidden in ('<g style="visibility: hidden"><rect width="1" height="1"/></g>', '<rect display="none" width="1" height="1"/>', '<g visibility="hidden"><g><rect width="1" height="1"/></g></g>', '<rect style="fill:red; display : none" width="1" height="1"/>'):
        assert sources.flatten_svg(svg % hidden) == [("Door", [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)])]
    assert [c for c, _ in sources.flatten_svg(svg % '<polygon style="display:block" points="0,0 1,0 1,1 5"/>')] == ["Wall", "Door"]


def test_binding_statuses(spark):
    openings = [(1, 1, 50.0, 2.0, 20.0, True), (2, 1, 50.0, 2.0, 20.0, True), (3, 1, 50.0, 2.0, 20.0, True), (4, 1, 50.0, 2.0, 20.0, True), (5, 1, 0.0, 0.0, 20.0, True)]
    walls = [(1, 10, 0.0, 0.0, 100.0, 0.0, 10.0)]  # aligned and wide enough
    walls += [(2, 10, 50.0, 0.0, 50.0, 90.0, 10.0), (2, 11, 0.0, 4.0, 100.0, 4.0, 10.0)]  # a crossing wall is nearer
    walls += [(3, 10, 50.0, 0.0, 50.0, 90.0, 10.0), (3, 11, 0.0, 4.0, 100.0, 4.0, 10.0), (3, 12, 0.0, 0.0, 100.0, 0.0, None)]
    walls += [(4, 10, 50.0, 60.0, 50.0, 90.0, 10.0)]
    got = binding.bind_nearest(spark.createDataFrame(openings, "image long, id long, cx double, cy double, length double, horizontal boolean"), spark.createDataFrame(walls, "image long, id long, x1 double, y1 double, x2 double, y2 double, thickness double"))
    assert {(r["image"], r["segment"], r["status"], ",".join(r["reasons"])) for r in got.collect()} == {
        (1, 10, "nearest", ""), (2, 11, "span_aware", ""), (3, 10, "ambiguous", "perpendicular_wall"), (4, 10, "nearest", "perpendicular_wall,far_from_wall"), (5, None, None, "no_wall_segments"),
    }


def test_fusion(spark):
    rows = [(1, 0, [0.1, 0.8, 0.05, 0.05], [0.75, 0.2, 0.03, 0.02]), (1, 1, [0.1, 0.8, 0.05, 0.05], [0.81, 0.18, 0.01, 0.0]), (1, 2, [0.1, 0.05, 0.8, 0.05], [0.7, 0.1, 0.1, 0.1]), (2, 0, [0.1, 0.05, 0.8, 0.05], [0.2, 0.6, 0.1, 0.1]), (2, 1, [0.1, 0.05, 0.8, 0.05], [0.7, 0.1, 0.1, 0.1])]
    got = {(r["image"], r["pixel"]): (r["class"], [round(p, 6) for p in r["probabilities"]]) for r in metrics.fuse_passes(spark.createDataFrame(rows, "image long, pixel long, original array<double>, normalized array<double>")).collect()}
    assert got[1, 0] == (0, [0.75, 0.736, 0.03, 0.02])  # wall rescued to 0.92 of 0.8; floor at 0.75 still wins
    assert got[1, 1][1][1] == 0.18 and got[1, 2] == (2, [0.7, 0.1, 0.72, 0.1])
    assert got[2, 1] == (0, [0.7, 0.1, 0.1, 0.1])  # the original pass sees no wall there: nothing is rescued


def test_hashes_of_turned_plans():
    image = np.full((110, 160), 255.0)
    image[10:98, 12:17] = image[10:98, 140:145] = image[10:15, 12:145] = image[93:98, 12:145] = 0
    image[10:70, 60:64] = image[30:43, 91:118] = 0
    margin = np.pad(image, 30, constant_values=255.0)
    base = raster.signatures(image)
    assert raster.signatures(margin) == base
    turned = raster.signatures(np.rot90(image))
    assert turned[3] == base[0] and turned[0] == base[1]
    flat = np.tile(np.arange(0, 180, 2.0), (40, 1))
    assert raster.difference_hash(flat) == (1 << 64) - 1 and raster.difference_hash(flat[:, ::-1]) == 0
    assert raster.resample(np.full((7, 5), 93.0), 8, 9).tolist() == [[93.0] * 9] * 8
    assert np.abs(raster.resample(flat, 40, 45) - raster.block_mean(flat, 40, 45)).max() <= 4


def thin_by_pixels(mask):
    """The two-step rule, pixel by pixel."""
    m = np.pad(mask.astype(int), 1)
    while True:
        changed = False
        for step in range(2):
            out = []
            for y, x in zip(*np.nonzero(m), strict=True):
                ring = [m[y + dy, x + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                turns = sum(a == 0 and b == 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
                n, e, s, w = ring[0], ring[2], ring[4], ring[6]
                if 2 <= sum(ring) <= 6 and turns == 1 and ((n * e * s == 0 and e * s * w == 0) if step == 0 else (n * e * w == 0 and n * s * w == 0)):
                    out.append((y, x))
            for p in out:
                m[p] = 0
            changed |= bool(out)
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def test_thinning_against_pixels():
    rng = np.random.default_rng(3)
    for _ in range(6):
        mask = rng.random((18, 22)) < 0.7
        assert (raster.thin(mask) == thin_by_pixels(mask)).all()


def test_shared_area_against_a_grid():
    rng = np.random.default_rng(5)
    grid = np.stack(np.meshgrid(np.arange(0.005, 1, 0.01), np.arange(0.005, 1, 0.01)), -1).reshape(-1, 2)

    def star(n):
        angle, radius, center = np.sort(rng.random(n)) * 2 * np.pi, rng.uniform(0.1, 0.45, n), rng.uniform(0.4, 0.6, 2)
        return center + np.stack([np.cos(angle), np.sin(angle)], 1) * radius[:, None]

    def inside(x):
        a, b = x, np.roll(x, -1, axis=0)
        crossed = (a[None, :, 1] > grid[:, None, 1]) != (b[None, :, 1] > grid[:, None, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[:, 0] + (grid[:, None, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        return (crossed & (grid[:, None, 0] < at)).sum(1) % 2 == 1

    for n in (3, 5, 8, 12):
        a, b = star(n), star(n + 1)
        if polygons.is_simple(a) and polygons.is_simple(b):
            assert polygons.shared_area(a, b) == pytest.approx((inside(a) & inside(b)).mean(), abs=0.01)
            assert polygons.shared_area(a, a[::-1]) == pytest.approx(abs(polygons.area(a)))


def test_simple_rings():
    ring = lambda *p: np.array(p, float)
    assert polygons.is_simple(ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)))
    assert not polygons.is_simple(ring((0, 0), (4, 4), (4, 0), (0, 4)))  # crossing
    assert not polygons.is_simple(ring((0, 0), (4, 0), (2, 0), (2, 3)))  # folding back
    assert not polygons.is_simple(ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4)))  # touching an edge
    assert not polygons.is_simple(ring((0, 0), (4, 0)))


def test_gate_of_empty_plans(spark):
    plans = gate_cases.plans(spark, "/root/testdata/sf0.001").limit(0)
    assert gate.gate_issues(plans).count() == 0
    graph_only = spark.createDataFrame([(1, '{"rooms":[],"doors":[],"windows":[{"id":1}]}', '{"levels":[{"segments":[1]}]}', None, None, 1.0)], "image long, rooms string, project string, bindings string, geometry string, scale double")
    p = gate.parsed(graph_only)
    assert [(r["code"], r["severity"]) for r in gate.room_issues(p, True).collect()] == [("no_rooms", "warning")]
    assert [(r["code"], r["severity"]) for r in gate.room_issues(p).collect()] == [("no_rooms", "error")]


def test_long_chains(spark):
    """A chain of contested pairs, and a path of over 1,000 edges."""
    chain = [(1, i // 2 + i % 2, i // 2, float(i)) for i in range(60)]
    pairs = spark.createDataFrame([(1, a, b, s) for _, a, b, s in chain], "image long, i long, j long, score double")
    used, want = (set(), set()), set()
    for _, a, b, s in sorted(chain, key=lambda r: (-r[3], -r[1], -r[2])):
        if a not in used[0] and b not in used[1]:
            want.add((a, b))
            used[0].add(a)
            used[1].add(b)
    assert {(r["i"], r["j"]) for r in matching.greedy_match(pairs).collect()} == want
    edges = [(1, i, i + 1) for i in range(1200)] + [(1, 1200, 2000), (1, 1200, 2001), (2, 1, 2), (2, 2, 3), (2, 3, 1)]
    got = graph.dangling_paths(spark.createDataFrame(edges, "image long, a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 1200, 1200), (1, 2000, 1200, 1), (1, 2001, 1200, 1)}

import random

import pytest
from pyspark.sql import functions as F

from atelier.functions import geometry as geo
from atelier.functions import scalars
from atelier.operators import binding, graph, islands, matching, metrics, quality


def sequential(pairs, least=None):
    out, used_i, used_j = [], set(), set()
    for s, i, j in sorted(pairs, reverse=True):
        if i not in used_i and j not in used_j:
            out.append((i, j))
            used_i.add(i)
            used_j.add(j)
    return sorted(out)


def test_greedy_equals_the_sequential_pass(spark):
    rng = random.Random(1)
    groups = {k: [(rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), i, j) for i in range(6) for j in range(6) if rng.random() < 0.5] for k in range(30)}
    df = spark.createDataFrame([(k, i, j, s) for k, p in groups.items() for s, i, j in p], "image long, i long, j long, score double")
    got = {}
    for r in matching.greedy_match(df).collect():
        got.setdefault(r["image"], []).append((r["i"], r["j"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sequential(p) for k, p in groups.items() if p}
    assert matching.greedy_match(df.limit(0)).count() == 0


def test_opening_limits_and_types(spark):
    cols = "image long, kind string, id long, cx double, cy double, angle double, length double"
    truth = spark.createDataFrame([(1, "door", 1, 0.0, 0.0, 0.0, 40.0), (1, "window", 2, 100.0, 0.0, 90.0, 40.0)], cols)
    found = spark.createDataFrame([(1, "door", 7, 12.0, 0.0, 0.0, 40.0), (1, "door", 8, 6.0, 0.0, 170.0, 40.0), (1, "door", 9, 100.0, 0.0, 90.0, 40.0)], cols)
    pairs = matching.opening_pairs(truth, found).collect()
    assert [(r["i"], r["j"]) for r in pairs] == [(1, 8)]  # at the distance limit the score is 0; 170 and 0 degrees are 10 apart
    matched = matching.greedy_match(matching.opening_pairs(truth, found).select("image", "i", "j", "score")).join(truth.select("image", F.col("id").alias("i"), "kind"), ["image", "i"])
    rep = {r["kind"]: r for r in matching.report(truth, found, matched, ["image", "kind"]).collect()}
    assert (rep["door"]["tp"], rep["door"]["fp"], rep["door"]["fn"]) == (1, 2, 0)
    assert (rep["window"]["tp"], rep["window"]["fn"], rep["window"]["precision"]) == (0, 1, 1.0)


def test_missing_annotation_is_not_empty(spark):
    images = spark.createDataFrame([(1,), (2,)], "image long")
    expected = spark.createDataFrame([(1, "door", 0)], "image long, category string, expected long")
    none = spark.createDataFrame([], "image long, category string")
    got = {r["image"]: r for r in matching.coverage_report(images, ["door"], expected, none).collect()}
    assert got[1]["exact"] is True and got[2]["exact"] is None and got[2]["expected"] is None


def test_priority_dedup_a_removed_row_removes_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (1, 4, 9.0), (2, 5, 0.0)], "image long, id long, pos double")
    same = F.abs(F.col("a_pos") - F.col("b_pos")) <= 1
    kept = binding.priority_dedup(rows, same, ["id"]).select("id").collect()
    assert sorted(r["id"] for r in kept) == [1, 3, 4, 5]


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(50)] + [(1, 100, 101), (2, 5, 6), (2, 7, 7)], "image long, a long, b long")
    got = {(r["image"], r["node"]): r["root"] for r in graph.components(edges).collect()}
    assert all(got[1, i] == 0 for i in range(51)) and got[1, 101] == 100 and got[2, 6] == 5 and got[2, 7] == 7
    paths = {r["tip"]: (r["stop"], r["n_edges"]) for r in graph.dangling_paths(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 3, 5)], "image long, a long, b long")).collect()}
    assert paths == {0: (2, 2), 4: (2, 1), 5: (2, 2)}


def test_islands(spark):
    s = spark.createDataFrame([(1, p, p not in (3, 7)) for p in range(12)], "line long, pos long, on boolean")
    assert [(r["start"], r["end"]) for r in islands.supported_runs(s, ["line"], "pos", "on").orderBy("start").collect()] == [(0, 2), (4, 6), (8, 11)]
    assert spark.range(1).select(islands.snap_in_order(F.array(*map(F.lit, (10.0, 11.0, 30.0, 10.5, 29.0))), 2.0).alias("v")).first()["v"] == [10.0, 10.0, 30.0, 10.0, 30.0]


def test_status(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image long")
    issues = spark.createDataFrame([(1, "a", "warning", "x"), (1, "a", "warning", "y"), (1, "b", "info", "y"), (2, "c", "error", "x")], "image long, code string, severity string, subject string")
    got = {r["image"]: (r["status"], r["quality"], r["export_allowed"]) for r in quality.status(images, issues).collect()}
    assert got == {1: ("review", 0.92, True), 2: ("invalid", 0.0, False), 3: ("good", 1.0, True)}


def test_geometry(spark):
    row = spark.range(1).select(geo.box_ring(*map(F.lit, (0, 0, 4, 3))).alias("ring")).select(
        geo.ring_area(F.col("ring")).alias("area"), geo.in_ring(F.lit(1.0), F.lit(1.0), F.col("ring")).alias("inside"), geo.in_ring(F.lit(5.0), F.lit(1.0), F.col("ring")).alias("outside"),
        geo.segment_distance(*(F.lit(float(v)) for v in (0, 5, 0, 0, 0, 0))).alias("point"), geo.axial_difference(F.lit(175.0), F.lit(5.0)).alias("turn"), geo.ratio(F.lit(0), F.lit(0)).alias("zero"),
        geo.span_angle(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("angle"), geo.ring_box(F.col("ring"))["horizontal"].alias("flat"),
    ).first()
    assert (row["area"], row["inside"], row["outside"], row["point"], row["turn"], row["zero"], row["flat"]) == (12.0, True, False, 5.0, 10.0, 1.0, True)
    assert row["angle"] == pytest.approx(45)


def test_confusion_ignores_255_and_empty_classes(spark):
    px = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (255, 1)], "truth int, pred int")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"], r["iou"]) for r in metrics.confusion(px, [0, 1, 2]).collect()}
    assert got == {0: (1, 0, 1, 0.5), 1: (1, 1, 0, 0.5), 2: (0, 0, 0, 0.0)}


def test_scalars(spark):
    assert scalars.canonical('{"b": 1e-7, "a": [true, "é"]}') == '{"a":[true,"é"],"b":1e-07}' and scalars.canonical("NaN") is None and scalars.canonical("{") is None
    df = spark.createDataFrame([("c12", "true", "2024-01-02T03:04:05Z"), ("x", "1.5", "2024-01-02T03:04:05"), ("c-3", "Infinity", None)], "n string, v string, t string")
    got = df.select(scalars.connector_number(F.col("n")).alias("n"), scalars.finite_number(F.col("v")).alias("v"), scalars.shown_time(scalars.offset_time(F.col("t"))).alias("t")).collect()
    assert [tuple(r) for r in got] == [(12, None, "02.01.2024 06:04 МСК"), (0, 1.5, "не указана"), (-3, None, "не указана")]

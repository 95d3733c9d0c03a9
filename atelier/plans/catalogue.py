"""The queries of the plan operators, each with the same result written as SQL from the operator's definition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import geometry as geo
from ..functions import scalars
from ..operators import binding, curation, evidence, gate, graph, islands, matching, metrics, pixels, quality, rules, topology
from . import gate_cases
from .derived import sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- matching and evaluation -------------------------------------------------------------------------------------------

def _greedy_sql(pairs: str) -> str:
    """Sequential greedy matching of (image, i, j, score): one pair after another in order, with lists of used ends."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, i DESC, j DESC) AS k FROM ({pairs})),
    walk(image, k, ui, uj) AS (SELECT DISTINCT image, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM ranked
      UNION ALL SELECT w.image, r.k, CASE WHEN list_contains(ui, r.i) OR list_contains(uj, r.j) THEN ui ELSE list_append(ui, r.i) END,
        CASE WHEN list_contains(ui, r.i) OR list_contains(uj, r.j) THEN uj ELSE list_append(uj, r.j) END
      FROM walk w JOIN ranked r ON r.image = w.image AND r.k = w.k + 1),
    last AS (SELECT image, ui, uj FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k DESC) AS n FROM walk) WHERE n = 1),
    matched AS (SELECT image, unnest(ui) AS i, unnest(uj) AS j FROM last)"""


_OPENING_PAIRS = f"""SELECT t.image, t.kind, t.id AS i, p.id AS j,
    (1 - sqrt((t.cx-p.cx)*(t.cx-p.cx) + (t.cy-p.cy)*(t.cy-p.cy)) / greatest(12.0, 0.3*t.length)) * (1 - least(abs(t.angle-p.angle), 180 - abs(t.angle-p.angle)) / 180)
      * (least(t.length, p.length) / greatest(t.length, p.length)) AS score
  FROM {sql("truth")} t JOIN {sql("found")} p ON t.image = p.image AND t.kind = p.kind
  WHERE sqrt((t.cx-p.cx)*(t.cx-p.cx) + (t.cy-p.cy)*(t.cy-p.cy)) <= greatest(12.0, 0.3*t.length)
    AND least(abs(t.angle-p.angle), 180 - abs(t.angle-p.angle)) <= 25 AND least(t.length, p.length) / greatest(t.length, p.length) >= 0.45"""


@query(f"""WITH RECURSIVE {_greedy_sql(f"SELECT image, i, j, score FROM ({_OPENING_PAIRS}) WHERE score > 1e-9")},
  e AS (SELECT image, kind, count(*) AS expected FROM {sql("truth")} GROUP BY ALL), p AS (SELECT image, kind, count(*) AS predicted FROM {sql("found")} GROUP BY ALL),
  m AS (SELECT t.image, t.kind, count(*) AS tp FROM matched JOIN {sql("truth")} t ON t.id = matched.i GROUP BY ALL)
  SELECT image, kind, coalesce(expected, 0) AS expected, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp, coalesce(predicted, 0) - coalesce(tp, 0) AS fp, coalesce(expected, 0) - coalesce(tp, 0) AS fn,
    CASE WHEN coalesce(predicted, 0) = 0 THEN CASE WHEN coalesce(tp, 0) = 0 THEN 1.0e0 ELSE 0 END ELSE coalesce(tp, 0) / predicted END AS "precision",
    CASE WHEN coalesce(expected, 0) = 0 THEN CASE WHEN coalesce(tp, 0) = 0 THEN 1.0e0 ELSE 0 END ELSE coalesce(tp, 0) / expected END AS recall,
    2 * coalesce(tp, 0) / (coalesce(expected, 0) + coalesce(predicted, 0)) AS f1
  FROM e FULL JOIN p USING (image, kind) LEFT JOIN m USING (image, kind)""")
def eval_openings_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors and windows of every plan: candidates by place, axis and length, greedy one-to-one, precision and recall."""
    truth, found = table(spark, sf_dir, "truth"), table(spark, sf_dir, "found")
    matched = matching.greedy_match(matching.opening_pairs(truth, found).select("image", "i", "j", "score"))
    kinds = matched.join(truth.select("image", F.col("id").alias("i"), "kind"), ["image", "i"])
    return matching.report(truth, found, kinds, ["image", "kind"])


@query(f"""WITH RECURSIVE {_greedy_sql(f'''SELECT * FROM (SELECT t.image, t.id AS i, p.id AS j, both_area / ((t.x2-t.x1)*(t.y2-t.y1) + (p.x2-p.x1)*(p.y2-p.y1) - both_area) AS score
    FROM {sql("rooms")} t JOIN {sql("found_rooms")} p USING (image), LATERAL (SELECT greatest(0, least(t.x2,p.x2)-greatest(t.x1,p.x1)) * greatest(0, least(t.y2,p.y2)-greatest(t.y1,p.y1)) AS both_area)) WHERE score >= 0.5''')}
  SELECT image, i, j FROM matched""")
def eval_rooms_iou_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.room_pairs(table(spark, sf_dir, "rooms"), table(spark, sf_dir, "found_rooms"))
    return matching.greedy_match(pairs).select("image", "i", "j")


@query(f"""WITH RECURSIVE {_greedy_sql(f'''SELECT t.image, t.id AS i, p.id AS j, 1 - sqrt((t.x-p.x)*(t.x-p.x)+(t.y-p.y)*(t.y-p.y)) / 12.0 AS score FROM {sql("junctions")} t JOIN {sql("found_junctions")} p USING (image, type)
    WHERE sqrt((t.x-p.x)*(t.x-p.x)+(t.y-p.y)*(t.y-p.y)) <= 12.0''')}
  SELECT type, count(*) AS matched FROM matched JOIN {sql("junctions")} t ON t.id = matched.i GROUP BY type""")
def eval_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "junctions")
    pairs = matching.junction_pairs(truth, table(spark, sf_dir, "found_junctions"))
    matched = matching.greedy_match(pairs.select("image", "i", "j", "score"))
    return matched.join(truth.select("image", F.col("id").alias("i"), "type"), ["image", "i"]).groupBy("type").agg(F.count("*").alias("matched"))


@query(f"""SELECT f.image, f.id FROM {sql("found")} f WHERE NOT EXISTS (SELECT 1 FROM {sql("rooms")} r WHERE r.image = f.image AND f.cx BETWEEN r.x1 AND r.x2 AND f.cy BETWEEN r.y1 AND r.y2)""")
def eval_openings_region_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.outside_regions(table(spark, sf_dir, "found"), table(spark, sf_dir, "rooms")).select("image", "id")


@query(f"""WITH e AS (SELECT image, kind AS category, count(*) AS expected FROM {sql("truth")} WHERE image % 3 <> 0 GROUP BY ALL), p AS (SELECT image, kind AS category, count(*) AS predicted FROM {sql("found")} GROUP BY ALL)
  SELECT image, category, expected, coalesce(predicted, 0) AS predicted, expected = coalesce(predicted, 0) AS exact
  FROM (SELECT c_custkey AS image FROM customer) CROSS JOIN (VALUES ('door'), ('window'), ('room')) AS c(category) LEFT JOIN e USING (image, category) LEFT JOIN p USING (image, category)""")
def eval_count_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against annotations; images divisible by 3 are not annotated, which is not the same as empty."""
    truth, found = table(spark, sf_dir, "truth").withColumnRenamed("kind", "category"), table(spark, sf_dir, "found").withColumnRenamed("kind", "category")
    expected = truth.where("image % 3 <> 0").groupBy("image", "category").agg(F.count("*").alias("expected"))
    return matching.coverage_report(table(spark, sf_dir, "images"), ["door", "window", "room"], expected, found)


@query(f"""SELECT image, region, CASE WHEN region IS NULL THEN 1 ELSE 0 END AS whole, CASE WHEN p = 0 THEN CASE WHEN b = 0 THEN 1.0e0 ELSE 0 END ELSE b / p END AS "precision", CASE WHEN t = 0 THEN CASE WHEN b = 0 THEN 1.0e0 ELSE 0 END ELSE b / t END AS recall,
    CASE WHEN t + p = 0 THEN 1.0e0 ELSE 2 * b / (t + p) END AS f1, CASE WHEN t + p - b = 0 THEN 1.0e0 ELSE b / (t + p - b) END AS iou
  FROM (SELECT image, region, count(*) FILTER (truth = 1 AND pred = 1) AS b, count(*) FILTER (truth = 1) AS t, count(*) FILTER (pred = 1) AS p FROM {sql("pixels")} GROUP BY GROUPING SETS ((image), (image, region)))""")
def wall_area_prf_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "pixels").select("image", "region", (F.col("truth") == 1).alias("truth"), (F.col("pred") == 1).alias("pred"))
    return metrics.area_rates(px)


# --- binding -----------------------------------------------------------------------------------------------------------

_BIND = f"""SELECT image, opening, w, segment, th, d, over, CASE WHEN flat THEN dy <= 0.27 * dx ELSE dx <= 0.27 * dy END AS aligned, CASE WHEN flat THEN dy > 3.7 * dx ELSE dx > 3.7 * dy END AS across
  FROM (SELECT *, round(sqrt((cx-x1-t*(x2-x1))*(cx-x1-t*(x2-x1)) + (cy-y1-t*(y2-y1))*(cy-y1-t*(y2-y1))), 9) AS d, greatest(0.0e0, w/2 - t*n, t*n + w/2 - n) AS over
  FROM (SELECT *, least(1.0e0, greatest(0.0e0, ((cx-x1)*(x2-x1) + (cy-y1)*(y2-y1)) / (n*n))) AS t
  FROM (SELECT o.image, o.id AS opening, o.length AS w, o.horizontal AS flat, cx, cy, s.id AS segment, s.thickness AS th, x1, y1, x2, y2, abs(x2-x1) AS dx, abs(y2-y1) AS dy, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS n FROM {sql("openings")} o JOIN {sql("segments")} s ON s.image = o.image)))"""


#: Common tables c (candidates) and bound (image, opening, segment, status, reasons).
BOUND_SQL = f"""c AS ({_BIND}), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY d, segment) AS k FROM c) WHERE k = 1),
  f AS (SELECT c.opening, count(*) AS feasible, arg_min(c.segment, (c.d, c.segment)) AS segment FROM c JOIN n USING (opening) WHERE NOT (n.aligned AND n.over <= 5) AND c.aligned AND c.over <= 1 AND c.d <= n.d + greatest(3, 0.05 * c.w) AND c.d <= greatest(20, 1.5 * c.th) GROUP BY c.opening),
  u AS (SELECT n.opening, CASE WHEN feasible = 1 THEN f.segment ELSE n.segment END AS segment, CASE WHEN feasible = 1 THEN 'span_aware' WHEN feasible > 1 THEN 'ambiguous' ELSE 'nearest' END AS status FROM n LEFT JOIN f USING (opening)),
  bound AS (SELECT o.image, o.id AS opening, u.segment, round(c.d, 6) AS distance, u.status, concat_ws(',', CASE WHEN u.segment IS NULL THEN 'no_wall_segments' END, CASE WHEN across THEN 'perpendicular_wall' END, CASE WHEN d > 2 * greatest(20, 1.5 * th) THEN 'far_from_wall' END,
    CASE WHEN over > greatest(20, 0.25 * w) THEN 'exceeds_segment' END) AS reasons FROM {sql("openings")} o LEFT JOIN u ON u.opening = o.id LEFT JOIN c ON c.opening = u.opening AND c.segment = u.segment)"""


@query(f"WITH {BOUND_SQL} SELECT * FROM bound")
def bind_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each opening's wall, how it was chosen, and why the choice must be rejected."""
    found = binding.bind_nearest(table(spark, sf_dir, "openings"), table(spark, sf_dir, "segments"))
    return found.select("image", "opening", "segment", F.round("distance", 6).alias("distance"), "status", F.array_join("reasons", ",").alias("reasons"))


def _axis(segments: DataFrame) -> DataFrame:
    return segments.select("image", "id", "horizontal", F.when(F.col("horizontal"), F.col("y1")).otherwise(F.col("x1")).alias("pos"), F.when(F.col("horizontal"), F.col("x1")).otherwise(F.col("y1")).alias("low"), F.when(F.col("horizontal"), F.col("x2")).otherwise(F.col("y2")).alias("high"))


@query(f"""WITH e AS (SELECT image, id, horizontal, CASE WHEN horizontal THEN y1 ELSE x1 END AS pos, CASE WHEN horizontal THEN x1 ELSE y1 END AS low, CASE WHEN horizontal THEN x2 ELSE y2 END AS high FROM {sql("segments")}),
  hit AS (SELECT w.id, count(*) AS n, min(e.id) AS edge FROM {sql("windows")} w JOIN e ON e.image = w.image AND e.horizontal = w.horizontal AND abs(e.pos - w.pos) <= 2 AND e.low <= w.low AND w.high <= e.high GROUP BY w.id)
  SELECT w.image, w.id AS cut, CASE WHEN n = 1 THEN edge END AS edge, CASE WHEN n IS NULL THEN 'no_carrier' WHEN n > 1 THEN 'several_carriers' ELSE 'bound' END AS reason FROM {sql("windows")} w LEFT JOIN hit USING (id)""")
def bind_unique_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.unique_carrier(table(spark, sf_dir, "windows"), _axis(table(spark, sf_dir, "segments")))


@query(f"""SELECT g.image, g.id FROM {sql("segments")} g WHERE NOT EXISTS (SELECT 1 FROM {sql("segments")} b WHERE b.image = g.image AND b.id % 3 = 0 AND ((b.x1 = g.x1 AND b.y1 = g.y1 AND b.x2 = g.x2 AND b.y2 = g.y2) OR (b.x1 = g.x2 AND b.y1 = g.y2 AND b.x2 = g.x1 AND b.y2 = g.y1)))""")
def gaps_without_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges are every third segment, with their ends swapped."""
    s = table(spark, sf_dir, "segments")
    bridges = s.where("id % 3 = 0").select("image", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return binding.gaps_without_bridge(s, bridges).select("image", "id")


_W, _L = sql("windows"), sql("layers")


@query(f"""SELECT a.image, a.id AS strip, min(b.id) AS parent FROM {_L} a JOIN {_L} b ON a.image = b.image AND a.id <> b.id AND a.horizontal = b.horizontal WHERE a.thickness <= 0.4 * b.thickness AND a.high - a.low <= 1.05 * (b.high - b.low)
  AND least(a.high, b.high) - greatest(a.low, b.low) >= 0.9 * (a.high - a.low) AND abs(a.pos - b.pos) <= b.thickness / 2 + 2 GROUP BY ALL""")
def window_strip_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.strips_in_windows(table(spark, sf_dir, "layers"))


@query(f"""SELECT a.image, a.id AS "window", b.id AS partner FROM {_W} a JOIN {_W} b ON a.image = b.image AND a.id <> b.id AND a.horizontal = b.horizontal WHERE abs(a.pos - b.pos) <= 20 AND greatest(0, least(a.high, b.high) - greatest(a.low, b.low)) >= 0.75 * least(a.high - a.low, b.high - b.low)""")
def parallel_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.parallel_windows(table(spark, sf_dir, "windows"))


@query(f"""SELECT a.image, a.id AS "window", min(b.id) AS crossed_by FROM {_W} a JOIN {_W} b ON a.image = b.image AND a.horizontal <> b.horizontal WHERE b.pos BETWEEN a.low AND a.high AND a.pos BETWEEN b.low AND b.high AND b.high - b.low >= 1.2 * (a.high - a.low) GROUP BY ALL""")
def crossing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.crossing_windows(table(spark, sf_dir, "windows"))


@query(f"""WITH c AS (SELECT d.image, d.id AS door, w.id AS "window", greatest(0, w.low - d.high, d.low - w.high) AS gap, abs(d.pos - w.pos) AS "offset" FROM {_W} d JOIN {_W} w ON d.image = w.image AND d.horizontal = w.horizontal
    WHERE d.id % 3 = 0 AND w.id % 3 <> 0 AND abs(d.pos - w.pos) <= 6 AND least(d.high - d.low, w.high - w.low) >= 0.5 * greatest(d.high - d.low, w.high - w.low))
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY gap, "offset", "window") AS k FROM c WHERE gap <= 15) WHERE k = 1""")
def door_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "windows")
    return binding.door_window_pairs(w.where("id % 3 = 0"), w.where("id % 3 <> 0"))


@query(f"""WITH RECURSIVE s AS (SELECT *, high - low AS n, row_number() OVER (PARTITION BY image ORDER BY thickness, id) AS k FROM {_L}),
  walk(image, k, kept) AS (SELECT DISTINCT image, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM s UNION ALL
    SELECT s.image, s.k, CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.image = s.image AND list_contains(kept, o.id) AND o.horizontal = s.horizontal AND least(o.n, s.n) >= 12 AND greatest(o.thickness / o.n, s.thickness / s.n) <= 0.3 AND least(o.n, s.n) >= 0.85 * greatest(o.n, s.n)
      AND greatest(0, least(o.high, s.high) - greatest(o.low, s.low)) >= 0.9 * least(o.n, s.n) AND greatest(0, abs(o.pos - s.pos) - (o.thickness + s.thickness) / 2) <= greatest(4, 0.5 * least(o.thickness, s.thickness)) AND abs(o.pos - s.pos) <= 1.75 * greatest(o.thickness, s.thickness)) THEN kept ELSE list_append(kept, s.id) END
    FROM walk w JOIN s ON s.image = w.image AND s.k = w.k + 1)
  SELECT image, unnest(kept) AS id FROM (SELECT image, kept, row_number() OVER (PARTITION BY image ORDER BY k DESC) AS n FROM walk) WHERE n = 1""")
def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers in order of thickness; a kept one removes those after it that are layers of one window with it."""
    return binding.priority_dedup(table(spark, sf_dir, "layers"), binding.same_layer(), ["thickness", "id"]).select("image", "id")


@query(f"""SELECT a.image AS wall, a.id AS earlier, b.id AS hole, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS area FROM {sql("rooms")} a JOIN {sql("rooms")} b ON a.image = b.image AND a.id < b.id
  WHERE least(a.x2, b.x2) - greatest(a.x1, b.x1) > 3 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 3""")
def hole_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(spark, sf_dir, "rooms").withColumn("ord", F.col("id")).withColumnRenamed("image", "wall")
    return binding.hole_overlaps(holes, 3.0)


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN length / thickness < 1.8 THEN 'elongation' END, CASE WHEN length < 15 THEN 'too_short' END, CASE WHEN thickness > 12 THEN 'too_thick' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (length / thickness < 1.8 OR length < 15 OR thickness > 12) AS accepted FROM {sql("openings")}""")
def opening_acceptance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("length") / F.col("thickness") < 1.8, "elongation"), F.when(F.col("length") < 15, "too_short"), F.when(F.col("thickness") > 12, "too_thick")))
    return table(spark, sf_dir, "openings").select("id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


@query(f"""SELECT o.image, o.id, min(r.id) AS room, count(r.id) AS n_rooms FROM {sql("openings")} o LEFT JOIN {sql("rooms")} r ON r.image = o.image AND o.cx >= r.x1 AND o.cx < r.x2 AND o.cy >= r.y1 AND o.cy < r.y2 GROUP BY ALL""")
def rooms_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = table(spark, sf_dir, "rooms").select("image", F.col("id").alias("room"), geo.box_ring(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("ring"))
    o = table(spark, sf_dir, "openings").select("image", "id", "cx", "cy")
    hit = o.join(rooms, "image").where(geo.in_ring(F.col("cx"), F.col("cy"), F.col("ring"))).groupBy("image", "id").agg(F.min("room").alias("room"), F.count("*").alias("n_rooms"))
    return o.select("image", "id").join(hit, ["image", "id"], "left").na.fill(0, ["n_rooms"])


@query(f"""SELECT image, id, least(120, greatest(0, (cx - 10) * 120 / 100)) AS source_x, greatest(length, thickness) AS long_side, CASE WHEN horizontal THEN cx - length / 2 ELSE cx END AS axis_x1, CASE WHEN horizontal THEN cy ELSE cy - length / 2 END AS axis_y1, (length * thickness) AS area FROM {sql("openings")}""")
def opening_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring, box and axis of each opening, and its centre in source pixels."""
    o = table(spark, sf_dir, "openings")
    half_x, half_y = F.when(F.col("horizontal"), F.col("length") / 2).otherwise(F.col("thickness") / 2), F.when(F.col("horizontal"), F.col("thickness") / 2).otherwise(F.col("length") / 2)
    o = o.withColumn("ring", geo.box_ring(F.col("cx") - half_x, F.col("cy") - half_y, F.col("cx") + half_x, F.col("cy") + half_y)).withColumn("box", geo.ring_box(F.col("ring")))
    flat = F.col("horizontal")
    return o.select("image", "id", geo.letterbox_to_source(F.col("cx"), F.lit(10.0), F.lit(110.0), F.lit(120.0)).alias("source_x"), F.col("box.length").alias("long_side"), F.when(flat, F.col("box.x1")).otherwise((F.col("box.x1") + F.col("box.x2")) / 2).alias("axis_x1"), F.when(flat, (F.col("box.y1") + F.col("box.y2")) / 2).otherwise(F.col("box.y1")).alias("axis_y1"), geo.ring_area(F.col("ring")).alias("area"))


# --- quality gate ------------------------------------------------------------------------------------------------------

_ISSUES = f"""SELECT image, CASE WHEN s >= 0.2 THEN 'massive_overlap' ELSE 'room_overlap' END AS code, CASE WHEN s >= 0.2 THEN 'error' ELSE 'warning' END AS severity, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS subject FROM (
    SELECT a.image, a.id AS i, b.id AS j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1)) AS s FROM {sql("rooms")} a JOIN {sql("rooms")} b ON a.image = b.image AND a.id < b.id) WHERE s >= 0.05
  UNION ALL SELECT image, 'opening_size', 'error', CAST(id AS VARCHAR) FROM {sql("openings")} WHERE length < 12
  UNION ALL SELECT image, 'thick_opening', 'warning', CAST(id AS VARCHAR) FROM {sql("openings")} WHERE thickness > 13
  UNION ALL SELECT image, 'no_windows', 'warning', CAST(image AS VARCHAR) FROM (SELECT c_custkey AS image FROM customer) c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = image AND o_orderkey % 3 <> 0)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, images = table(spark, sf_dir, "openings"), table(spark, sf_dir, "images")
    windows = table(spark, sf_dir, "truth").where("kind = 'window'")
    return quality.all_issues([
        quality.room_overlaps(table(spark, sf_dir, "rooms")), quality.rule(o, "opening_size", "error", F.col("length") < 12, F.col("id")),
        quality.rule(o, "thick_opening", "warning", F.col("thickness") > 13, F.col("id")),
        quality.missing(images, ["image"], windows, ["image"], "no_windows", F.col("image")).withColumn("severity", F.lit("warning")),
    ])


@query(_ISSUES)
def project_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"""WITH n AS (SELECT image, count(*) FILTER (severity = 'error') AS e, count(DISTINCT code) FILTER (severity = 'warning') AS w FROM ({_ISSUES}) GROUP BY image)
  SELECT c_custkey AS image, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings, CASE WHEN coalesce(e, 0) > 0 THEN 'invalid' WHEN coalesce(w, 0) > 0 THEN 'review' ELSE 'good' END AS status,
    CASE WHEN coalesce(e, 0) > 0 THEN 0.0e0 ELSE greatest(0.1e0, round(1 - 0.08e0 * coalesce(w, 0), 2)) END AS quality, coalesce(e, 0) = 0 AS export_allowed FROM customer LEFT JOIN n ON image = c_custkey""")
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status(table(spark, sf_dir, "images"), _issues(spark, sf_dir))


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY severity <> 'error', code, subject) AS position FROM ({_ISSUES})) WHERE position <= 50""")
def review_questions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 questions a plan, errors first: the report's own limit."""
    return quality.questions(_issues(spark, sf_dir), 50)


@query("""SELECT 'lineitem_without_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'negative_price', count(*) FROM lineitem WHERE l_extendedprice <= 0""")
def referential_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders = read(spark, sf_dir, "lineitem").withColumn("image", F.col("l_orderkey")), read(spark, sf_dir, "orders").withColumn("image", F.col("o_orderkey"))
    parts = {
        "lineitem_without_order": quality.missing(li, ["l_orderkey"], orders, ["o_orderkey"], "x", F.col("l_orderkey")),
        "order_without_customer": quality.missing(orders, ["o_custkey"], read(spark, sf_dir, "customer"), ["c_custkey"], "x", F.col("o_custkey")),
        "repeated_line": quality.repeated(li, ["l_orderkey", "l_linenumber"], "x", F.col("l_linenumber")),
        "negative_price": quality.rule(li, "x", "error", F.col("l_extendedprice") <= 0, F.col("l_orderkey")),
    }
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(gate_cases.issues_sql())
def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the export gate over JSON documents with one planted fault a plan."""
    return gate.gate_issues(gate_cases.plans(spark, sf_dir), gate_cases.verified(spark, sf_dir))


@query(f"""WITH p AS (SELECT c_custkey AS image, {gate_cases.column_sql("project")} FROM customer), e AS (SELECT *, coalesce(from_json(json_extract(project, '$.levels[0].elements'), '["JSON"]'), []) AS items FROM p)
  SELECT image, {", ".join(f"CAST(coalesce(json_array_length(project, '$.levels[0].{k}'), 0) AS BIGINT) AS {n}" for n, k in (("rooms", "areas"), ("segments", "segments"), ("connectors", "connectors")))},
    {", ".join(f"CAST(len(list_filter(items, lambda x: json_extract_string(x, '$.type') = '{k}')) AS BIGINT) AS {n}" for k, n, _ in gate.KINDS)} FROM e""")
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each project's first level."""
    return gate.project_totals(gate_cases.plans(spark, sf_dir))


@query(f"""WITH n AS (SELECT image, count(*) FILTER (severity = 'error') AS e, count(DISTINCT code) FILTER (severity = 'warning') AS w FROM ({gate_cases.issues_sql()}) GROUP BY image)
  SELECT image, e AS n_errors, w AS n_warnings, CASE WHEN e > 0 THEN 'invalid' WHEN w > 0 THEN 'review' ELSE 'good' END AS status, CASE WHEN e > 0 THEN 0.0e0 ELSE greatest(0.1e0, round(1 - 0.08e0 * w, 2)) END AS quality, e = 0 AS export_allowed FROM n""")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export gate's verdict on each plan; infos lower nothing."""
    plans = gate_cases.plans(spark, sf_dir)
    return quality.status(plans, gate.gate_issues(plans, gate_cases.verified(spark, sf_dir)))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY id) AS k, count(*) OVER (PARTITION BY image) AS m FROM {sql("segments")}),
  nxt AS (SELECT a.image, a.id AS a, b.id AS b FROM n a JOIN n b ON a.image = b.image AND b.k = CASE WHEN a.k = a.m THEN 1 ELSE a.k + 1 END)
  SELECT DISTINCT image, 'unclosed_area' AS code, 'error' AS severity, CAST(image AS VARCHAR) AS subject FROM nxt WHERE (a + b) % 9 = 0""")
def unclosed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One area a plan, its cycle all segment ids in order; the edges are the steps whose ends' sum 9 does not divide."""
    cycles = table(spark, sf_dir, "segments").groupBy("image").agg(F.array_sort(F.collect_list("id")).alias("nodes")).withColumn("area", F.col("image"))
    steps = cycles.select("image", F.posexplode("nodes").alias("pos", "a"), "nodes").withColumn("b", F.get("nodes", (F.col("pos") + 1) % F.size("nodes")))
    return quality.unclosed_areas(cycles, steps.where("(a + b) % 9 <> 0").select("image", F.col("b").alias("a"), F.col("a").alias("b")))


# --- runs and ordered scans --------------------------------------------------------------------------------------------

_RUNS = """SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, event_type, g"""


@query(f"SELECT user_id, event_type, n, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us FROM ({_RUNS}) WHERE n >= 2")
def supported_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two and more equal events of a user."""
    found = islands.runs(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").where("n >= 2")
    return found.select("user_id", "event_type", "n", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


_HOURS = "(SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS hour FROM events)"
_ISLANDS = f'(SELECT user_id, min(hour) AS "start", max(hour) AS "end", count(*) AS length FROM (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS g FROM {_HOURS}) GROUP BY user_id, g)'


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour")).distinct()


@query(f"""SELECT user_id, "start", "end", next_start, next_end, next_start - "end" - 1 AS gap FROM (SELECT *, lead("start") OVER w AS next_start, lead("end") OVER w AS next_end FROM {_ISLANDS} WINDOW w AS (PARTITION BY user_id ORDER BY "start")) WHERE next_start - "end" - 1 <= 6""")
def paired_runs_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with events, and the next run of the user at most six hours later."""
    found = islands.supported_runs(_hours(spark, sf_dir).withColumn("on", F.lit(True)), ["user_id"], "hour", "on", 1).drop("length")
    return islands.paired_runs(found, ["user_id"], 6)


@query(f"""SELECT "start", "end", min(user_id) AS top, max(user_id) AS bottom, count(*) AS height FROM (SELECT *, user_id - row_number() OVER (PARTITION BY "start", "end" ORDER BY user_id) AS g FROM {_ISLANDS}) GROUP BY "start", "end", g HAVING count(*) >= 2""")
def gap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users next to one another with the same run of hours, merged to bands."""
    found = islands.supported_runs(_hours(spark, sf_dir).withColumn("on", F.lit(True)), ["user_id"], "hour", "on", 1)
    return islands.bands(found.withColumn("k", F.lit(0)), ["k"], row="user_id").drop("k")


@query(f"""WITH p AS (SELECT l_suppkey AS image, CAST(l_quantity AS BIGINT) AS pos, avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0 END) AS s FROM lineitem GROUP BY ALL),
  i AS (SELECT image, min(pos) AS "start", max(pos) AS "end", count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY image ORDER BY pos) AS g FROM p WHERE s >= 0.5) GROUP BY image, g)
  SELECT *, count(*) OVER (PARTITION BY image) = 1 AS "unique" FROM i""")
def support_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_quantity").cast("long").alias("pos"), (F.col("l_returnflag") == "R").cast("double").alias("v"))
    return islands.profile_bands(px, ["image"], "pos", "v", 0.5)


@query("""SELECT user_id, event_id, value, max(value) OVER w AS best, coalesce(value > max(value) OVER w, true) AS is_best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.best_so_far(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").drop("ts")


@query("""WITH RECURSIVE s AS (SELECT c_custkey // 40 AS line, c_custkey, round(c_acctbal) AS v, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS k FROM customer),
  walk(line, k, kept, own, v) AS (SELECT DISTINCT line, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM s UNION ALL
    SELECT s.line, s.k, CASE WHEN len(list_filter(kept, lambda x: abs(x - s.v) <= 200)) = 0 THEN list_append(kept, s.v) ELSE kept END, coalesce(list_filter(kept, lambda x: abs(x - s.v) <= 200)[1], s.v), s.v FROM walk w JOIN s ON s.line = w.line AND s.k = w.k + 1)
  SELECT line, k, v, own AS snapped FROM walk WHERE k > 0""")
def snap_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of forty customers, in order, snapped to the first kept one within 200; a line's values are one row."""
    rows = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 40).alias("line"), F.struct("c_custkey", F.round("c_acctbal").alias("v")).alias("p"))
    folded = rows.groupBy("line").agg(F.array_sort(F.collect_list("p")).alias("p")).withColumn("values", F.transform("p", lambda x: x["v"]))
    out = folded.select("line", F.posexplode(F.arrays_zip(F.col("values").alias("v"), islands.snap_in_order(F.col("values"), 200.0).alias("snapped"))).alias("k", "z"))
    return out.select("line", (F.col("k") + 1).cast("long").alias("k"), "z.v", "z.snapped")


# --- graphs ------------------------------------------------------------------------------------------------------------

_EDGES = "(SELECT o_custkey AS image, o_orderkey % 30 AS a, (o_orderkey * 7 + 3) % 30 AS b FROM orders)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey % 30 AS a", "(o_orderkey * 7 + 3) % 30 AS b")


@query(f"""WITH RECURSIVE e AS (SELECT image, a, b FROM {_EDGES} UNION SELECT image, b, a FROM {_EDGES}), r(image, node, other) AS (SELECT DISTINCT image, a, a FROM e UNION SELECT r.image, r.node, e.b FROM r JOIN e ON e.image = r.image AND e.a = r.other)
  SELECT image, node, min(other) AS root FROM r GROUP BY ALL""")
def components_min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir))


_GRID = "(SELECT o_custkey AS image, o_orderkey AS id, o_orderkey % 12 AS a, (o_orderkey + 1 + o_orderkey % 2) % 12 AS b, CASE WHEN o_orderkey % 4 = 3 THEN 90.0e0 ELSE 3.0e0 END AS angle, CAST(5 + o_orderkey % 9 AS DOUBLE) AS length FROM orders)"


@query(f"""WITH RECURSIVE ends AS (SELECT image, id, angle, a AS node FROM {_GRID} UNION ALL SELECT image, id, angle, b FROM {_GRID}), two AS (SELECT image, node FROM ends GROUP BY ALL HAVING count(*) = 2),
  link AS (SELECT u.image, u.id AS u, v.id AS v FROM ends u JOIN ends v USING (image, node) JOIN two USING (image, node) WHERE u.id <> v.id AND abs(u.angle - v.angle) <= 5),
  r(image, id, other) AS (SELECT image, id, id FROM {_GRID} UNION SELECT r.image, r.id, l.v FROM r JOIN link l ON l.image = r.image AND l.u = r.other)
  SELECT r.image, r.id, min(r.other) AS chain, sum(g.length) AS chain_length FROM r JOIN {_GRID} g ON g.id = r.other GROUP BY r.image, r.id""")
def collinear_chain_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey AS id", "o_orderkey % 12 AS a", "(o_orderkey + 1 + o_orderkey % 2) % 12 AS b", "CASE WHEN o_orderkey % 4 = 3 THEN 90.0D ELSE 3.0D END AS angle", "CAST(5 + o_orderkey % 9 AS DOUBLE) AS length")
    return graph.collinear_chains(seg)


_TREE = "(SELECT DISTINCT o_custkey AS image, 1 + o_orderkey % 39 AS a, (1 + o_orderkey % 39) // 2 AS b FROM orders)"


@query(f"""WITH RECURSIVE e AS (SELECT image, a, b FROM {_TREE} UNION SELECT image, b, a FROM {_TREE}), d AS (SELECT image, a AS node, count(*) AS deg FROM e GROUP BY ALL),
  w(image, tip, before, pos, n) AS (SELECT e.image, e.a, e.a, e.b, CAST(1 AS BIGINT) FROM e JOIN d ON d.image = e.image AND d.node = e.a AND deg = 1
    UNION ALL SELECT w.image, w.tip, w.pos, e.b, w.n + 1 FROM w JOIN d ON d.image = w.image AND d.node = w.pos AND deg = 2 JOIN e ON e.image = w.image AND e.a = w.pos AND e.b <> w.before)
  SELECT w.image, w.tip, w.pos AS stop, w.n AS n_edges FROM w JOIN d ON d.image = w.image AND d.node = w.pos AND deg <> 2""")
def dangling_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "1 + o_orderkey % 39 AS a", "(1 + o_orderkey % 39) div 2 AS b").distinct()
    return graph.dangling_paths(tree)


@query(f"""WITH s AS (SELECT image, horizontal, pos, low, high, id FROM {_W}), c AS (SELECT image, horizontal, pos, low AS v FROM s UNION SELECT image, horizontal, pos, high FROM s),
  e AS (SELECT image, horizontal, pos, v AS low, min(n) AS high FROM (SELECT c.*, d.v AS n FROM c JOIN c d USING (image, horizontal, pos) WHERE d.v > c.v) GROUP BY ALL)
  SELECT e.image, e.horizontal, e.pos, e.low, e.high, string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.id) AS owners FROM e JOIN s ON s.image = e.image AND s.horizontal = e.horizontal AND s.pos = e.pos AND s.low <= e.low AND e.high <= s.high WHERE e.high - e.low >= 1 GROUP BY ALL""")
def atomic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "windows").withColumnRenamed("id", "owner")
    return graph.atomic_edges(sides).withColumn("owners", F.array_join("owners", ","))


# --- metrics -----------------------------------------------------------------------------------------------------------

_PX = sql("pixels")


@query(f"""SELECT CAST(c AS INTEGER) AS "class", count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth <> c AND pred = c) AS fp, count(*) FILTER (truth = c AND pred <> c) AS fn, count(*) FILTER (truth = c AND pred = c) / greatest(1, count(*) FILTER (truth = c OR pred = c)) AS iou
  FROM {_PX}, (VALUES (0), (1), (2), (3)) AS k(c) WHERE truth <> 255 GROUP BY c""")
def confusion_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "pixels"), [0, 1, 2, 3])


@query(f"SELECT region, count(*) FILTER (truth = 0) AS class_0, count(*) FILTER (truth = 1) AS class_1, count(*) FILTER (truth = 2) AS class_2, count(*) FILTER (truth = 255) AS ignored FROM {_PX} GROUP BY region")
def class_pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_counts(table(spark, sf_dir, "pixels"), ["region"], "truth", [0, 1, 2])


@query(f"SELECT image, count(*) FILTER (t0 <> pred) AS changed, count(*) FILTER (t0 <> pred) / count(*) AS fraction FROM {_PX} GROUP BY image")
def pass_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.count_if(F.col("t0") != F.col("pred"))
    return table(spark, sf_dir, "pixels").groupBy("image").agg(changed.alias("changed"), (changed / F.count("*")).alias("fraction"))


@query("""WITH a AS (SELECT c_nationkey AS k, avg(CASE WHEN c_custkey % 7 < 3 THEN 1.0e0 ELSE 0 END) AS wall, avg(CASE WHEN c_custkey % 5 < 2 THEN 1.0e0 ELSE 0 END) AS door FROM customer WHERE c_nationkey <> 3 GROUP BY 1),
  b AS (SELECT s_nationkey AS k, avg(CASE WHEN s_suppkey % 7 < 3 THEN 1.0e0 ELSE 0 END) AS wall, avg(CASE WHEN s_suppkey % 5 < 2 THEN 1.0e0 ELSE 0 END) AS door FROM supplier WHERE s_nationkey <> 5 GROUP BY 1),
  j AS (SELECT k, b.wall - a.wall AS d_wall, b.door - a.door AS d_door, concat_ws(',', CASE WHEN a.wall IS NULL OR b.wall IS NULL THEN 'cohort' END, CASE WHEN a.wall - b.wall > 0.05 THEN 'wall' END, CASE WHEN a.door - b.door > 0.1 THEN 'door' END) AS failed FROM a FULL JOIN b USING (k))
  SELECT *, failed = '' AS accepted FROM j""")
def screen_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares before and after (customers against suppliers of a nation): what fell too far, or lacks a side."""
    share = lambda c, m, n: F.avg((F.col(c) % m < n).cast("double"))
    a = read(spark, sf_dir, "customer").where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("k")).agg(share("c_custkey", 7, 3).alias("wall"), share("c_custkey", 5, 2).alias("door"))
    b = read(spark, sf_dir, "supplier").where("s_nationkey <> 5").groupBy(F.col("s_nationkey").alias("k")).agg(share("s_suppkey", 7, 3).alias("wall"), share("s_suppkey", 5, 2).alias("door"))
    return metrics.screen(a, b, ["k"], {"wall": 0.05, "door": 0.1})


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.6) AS p60, quantile_cont(l_extendedprice, 0.95) AS p95, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag")
def percentile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.percentile("l_extendedprice", F.lit(q))
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(p(0.01).alias("p01"), p(0.6).alias("p60"), p(0.95).alias("p95"), F.median("l_quantity").alias("mid"))


@query("""SELECT event_type, peak, n FROM (SELECT event_type, hour(ts) AS peak, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, hour(ts)) AS k FROM events GROUP BY 1, 2) WHERE k = 1""")
def histogram_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.peak(read(spark, sf_dir, "events").select("event_type", F.hour("ts").cast("long").alias("level")), ["event_type"], "level")


@query("""SELECT l_suppkey, l_quantity, votes FROM (SELECT l_suppkey, l_quantity, count(*) AS votes, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, min(l_orderkey), l_quantity DESC) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1 AND votes >= 10""")
def band_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.votes(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey"), ["l_suppkey"], "l_quantity", "l_orderkey", 10)


@query("""SELECT o_custkey AS image, o_orderkey AS line, CASE WHEN NOT bool_or(o_orderkey % 97 = 0) OVER (PARTITION BY o_custkey) THEN abs(o_totalprice - o_orderkey / 2.0e0) END AS error FROM orders""")
def scale_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dimension lines at a scale of 2; every 97th has none, which leaves its customer's lines unjudged."""
    o = read(spark, sf_dir, "orders")
    lines = o.select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("line"), F.col("o_totalprice").alias("pixels"), F.col("o_orderkey").alias("length"), F.when(F.col("o_orderkey") % 97 == 0, 0.0).otherwise(2.0).alias("scale"))
    return metrics.scale_errors(lines)


@query("""WITH p AS (SELECT l_suppkey AS image, [0.1e0, l_tax * 11.0e0, l_discount * 9.0e0, l_quantity / 55.0e0] AS o, [l_quantity / 52.0e0, l_discount * 4.0e0, 0.1e0, l_tax * 2.0e0] AS n FROM lineitem),
  c AS (SELECT *, list_position(o, list_max(o)) - 1 AS oc, list_position(n, list_max(n)) - 1 AS nc FROM p),
  g AS (SELECT *, count(*) FILTER (oc = 1) OVER w * 20 >= greatest(count(*) FILTER (nc = 1) OVER w, 1) * 9 AND nc = 0 AS gate FROM c WINDOW w AS (PARTITION BY image)),
  f AS (SELECT image, nc, [n[1], CASE WHEN gate AND oc = 1 AND o[2] >= 0.72 AND n[2] >= 0.18 AND n[1] < 0.80 THEN greatest(n[2], o[2] * 0.92) ELSE n[2] END, CASE WHEN gate AND oc = 2 AND o[3] >= 0.75 AND n[2] + n[3] + n[4] >= 0.25 THEN greatest(n[3], o[3] * 0.90) ELSE n[3] END,
    CASE WHEN gate AND oc = 3 AND o[4] >= 0.75 AND n[2] + n[3] + n[4] >= 0.25 THEN greatest(n[4], o[4] * 0.90) ELSE n[4] END] AS q FROM g)
  SELECT image, CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS "class", count(*) AS n, round(sum(q[2]), 6) AS wall FROM f GROUP BY ALL""")
def fuse_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the pixels of an image (a supplier), fused."""
    t, d, q = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    px = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pixel"), F.array(F.lit(0.1), t * 11.0, d * 9.0, q / 55.0).alias("original"), F.array(q / 52.0, d * 4.0, F.lit(0.1), t * 2.0).alias("normalized"))
    return metrics.fuse_passes(px).groupBy("image", "class").agg(F.count("*").alias("n"), F.round(F.sum(F.col("probabilities")[1]), 6).alias("wall"))


# --- curation ----------------------------------------------------------------------------------------------------------

@query("SELECT sha256(text) AS sha, count(*) AS n, count(DISTINCT source) AS n_splits FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1")
def exact_duplicates_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return curation.cross_split_duplicates(docs, F.col("text").cast("binary"), "source")


@query("""SELECT 'duplicate_id' AS "check", count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'key_crosses_splits', count(*) FROM (SELECT md5(text) FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1) UNION ALL SELECT 'missing_key', count(*) FROM documents WHERE text IS NULL""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("sha"), "source")
    return curation.leakage_report(docs, "sha", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def train_minus_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those that a label excludes."""
    return curation.without(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


def _plan_hash(k: str, r: str, salt: int) -> tuple[str, str]:
    """A plan's hash in rotation r: four customers share one but for a few bits, the third is turned, the fourth differs in 14 bits."""
    turned = f"(({r}) + CASE WHEN {k} % 4 = 2 THEN 1 ELSE 0 END) % 4"
    base = f"((({k} - {k} % 4) * 7919 + {turned} * 104729 + {salt}) * 2654435761) % 4611686018427387903"
    return base, f"CASE {k} % 4 WHEN 0 THEN 0 WHEN 1 THEN 33 WHEN 2 THEN 1025 ELSE 524256 END"


_SIGNATURES = ", ".join(f"{{'p': xor({_plan_hash('c_custkey', str(r), 5)[0]}, {_plan_hash('c_custkey', str(r), 5)[1]}), 'd': xor({_plan_hash('c_custkey', str(r), 99)[0]}, {_plan_hash('c_custkey', str(r), 99)[1]}), 'r': {90 * r}}}" for r in range(4))


@query(f"""WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 2 THEN c_custkey // 20 ELSE -c_custkey END AS sha, CASE WHEN c_custkey % 7 < 2 THEN c_custkey // 14 END AS grp, [{_SIGNATURES}] AS s FROM customer),
  p AS (SELECT a.id AS a, b.id AS b, a.sha = b.sha AS exact, coalesce(a.grp = b.grp, false) AS same_group, list_min(list_transform(b.s, lambda x: {{'p': CAST(bit_count(xor(a.s[1].p, x.p)) AS INTEGER), 'd': CAST(bit_count(xor(a.s[1].d, x.d)) AS INTEGER), 'r': x.r}})) AS m FROM i a JOIN i b ON a.id < b.id)
  SELECT a, b, exact, same_group, m.d AS d_bits, m.p AS p_bits, m.r AS rotation FROM p WHERE exact OR same_group OR (m.p <= 12 AND m.d <= 12)""")
def near_duplicate_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images (customers) that may show one plan, by content, group, or hashes of any rotation.

    The hashes' product leaves 64 bits from about customer 438,000 on, so it is taken in decimals; what is left of the division fits again.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    customers = read(spark, sf_dir, "customer").select("c_custkey").repartition(tasks, "c_custkey")  # a short file would be one task
    key = "CAST(c_custkey AS DECIMAL(20))"
    hashed = lambda r, salt: "CAST({} AS BIGINT) ^ ({})".format(_plan_hash(key, str(r), salt)[0], _plan_hash("c_custkey", str(r), salt)[1])
    turns = ", ".join(f"struct({hashed(r, 99)} AS d, {hashed(r, 5)} AS p)" for r in range(4))
    images = customers.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 10 < 2 THEN c_custkey div 20 ELSE -c_custkey END AS sha", "CASE WHEN c_custkey % 7 < 2 THEN c_custkey div 14 END AS group_id", f"array({turns}) AS signatures")
    return curation.related_images(images)


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT query, id, rank FROM (SELECT q.id AS query, b.id, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, b.v) DESC, b.id) AS rank FROM v q JOIN v b ON q.id <> b.id WHERE q.id % 20 = 0) WHERE rank <= 5""")
def nearest_k_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for the queries, ids that 20 divides."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return curation.nearest(v.where("id % 20 = 0"), v, 5).select("query", "id", "rank")


@query("""SELECT doc_id, lang, round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS round FROM documents) ORDER BY round, lang, doc_id LIMIT 100""")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 in turn from the languages: a sampling operator's own size."""
    return curation.round_robin(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100, seed=7).select("doc_id", "lang", "round")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 1 THEN 'door' WHEN c_custkey % 2 = 0 THEN 'window' ELSE 'passage' END AS type, c_custkey % 4 = 0 AND c_custkey % 3 <> 1 AS confirmed FROM customer""")
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers turn every fourth opening to a door; those with a stale fingerprint have no effect."""
    items = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("fingerprint"), F.when(F.col("c_custkey") % 2 == 0, "window").otherwise("passage").alias("type"))
    answers = items.where("id % 4 = 0").select("id", F.when(F.col("id") % 3 == 1, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit("door").alias("choice"))
    return curation.apply_answers(items, answers).select("id", "type", "confirmed")


@query("SELECT c_custkey AS id, 'stale' AS reason FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 'duplicate' FROM customer WHERE c_custkey % 20 = 0")
def review_stale_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("fingerprint"))
    answers = items.where("id % 4 = 0").select("id", F.when(F.col("id") % 3 == 1, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return curation.stale_answers(items, answers.union(answers.where("id % 20 = 0"))).select("id", "reason")


@query("""SELECT o_custkey AS image, o_orderkey AS id, 'old' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT n.image, coalesce(top, 0) + k, 'new' FROM (SELECT o_custkey AS image, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1) n LEFT JOIN (SELECT o_custkey AS image, max(o_orderkey) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) USING (image)""")
def append_with_fresh_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("id"))
    return curation.append_with_fresh_ids(o.where("id % 2 = 0").withColumn("kind", F.lit("old")), o.where("id % 2 = 1").withColumn("kind", F.lit("new")), ["id"]).select("image", "id", "kind")


@query("""SELECT id, source, CAST(source_ordinal AS INTEGER) AS source_ordinal FROM (SELECT c_custkey AS id, 'svg' AS source, 0 AS source_ordinal FROM customer UNION ALL (SELECT s_suppkey, 'raster', 1 FROM supplier ORDER BY s_suppkey LIMIT 7))""")
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources in order, the second with a limit of its own."""
    return curation.concat_sources({"svg": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "raster": read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))}, "id", {"raster": 7})


@query("""SELECT v, CASE WHEN bool_or(s = 'l') THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_partkey AS v, 'l' AS s FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT l_partkey, 'r' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25) GROUP BY v HAVING count(*) = 1""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("v", F.col("l_partkey"))
    return curation.set_difference(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R' and l_quantity > 25"), "v")


# --- pixel tables ------------------------------------------------------------------------------------------------------

_DOTS = "(SELECT DISTINCT l_suppkey AS image, l_partkey % 60 AS x, CAST(l_quantity AS BIGINT) AS y FROM lineitem)"


def _dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image", "l_partkey % 60 AS x", "CAST(l_quantity AS BIGINT) AS y").distinct()


@query(f"SELECT DISTINCT image, x + dx AS x, y + dy AS y FROM {_DOTS}, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)")
def pixel_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dilate(_dots(spark, sf_dir))


@query(f"SELECT d.image, d.x, d.y FROM {_DOTS} d WHERE (SELECT count(*) FROM {_DOTS} e WHERE e.image = d.image AND abs(e.x - d.x) + abs(e.y - d.y) <= 1) = 5")
def pixel_erode_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.erode(_dots(spark, sf_dir), cross=True)


@query(f"""WITH RECURSIVE d AS MATERIALIZED (SELECT image, x, y, y * 2147483648 + x AS p FROM {_DOTS}), e AS MATERIALIZED (SELECT a.image, a.p, b.p AS q FROM d a JOIN d b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
  r(image, p, q) AS (SELECT image, p, p FROM d UNION SELECT r.image, r.p, e.q FROM r JOIN e ON e.image = r.image AND e.p = r.q), l AS (SELECT image, p, min(q) AS root FROM r GROUP BY ALL)
  SELECT l.image, count(*) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, sum(x) / count(*) AS cx FROM l JOIN d USING (image, p) GROUP BY l.image, root""")
def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.components(_dots(spark, sf_dir), diagonal=False).drop("root")


@query(f"SELECT d.image, d.x, d.y FROM {_DOTS} d WHERE (x BETWEEN 5 AND 20 AND y BETWEEN 5 AND 15) OR (x BETWEEN 15 AND 40 AND y BETWEEN 10 AND 12)")
def exclusion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dots(spark, sf_dir)
    box = lambda *b: F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)))
    boxes = d.select("image").distinct().select("image", F.explode(F.array(box(5, 5, 20, 15), box(15, 10, 40, 12))).alias("b")).select("image", "b.*")
    return pixels.excluded(d, boxes)


@query("""WITH s AS (SELECT o_custkey AS image, CASE o_orderkey % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' ELSE 'window' END AS cls, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS k, o_orderkey % 30 AS x1, o_orderkey * 7 % 20 AS y1 FROM orders),
  p AS (SELECT image, cls, k, x, unnest(range(y1, y1 + 4)) AS y FROM (SELECT *, unnest(range(x1, x1 + 6)) AS x FROM s)) SELECT image, x, y, CASE max(k) WHEN 1 THEN 'wall' WHEN 2 THEN 'door' ELSE 'window' END AS cls FROM p GROUP BY image, x, y""")
def painted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "CASE o_orderkey % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' ELSE 'window' END AS cls", "o_orderkey % 30 AS x1", "o_orderkey * 7 % 20 AS y1", "o_orderkey % 30 + 5 AS x2", "o_orderkey * 7 % 20 + 3 AS y2")
    return pixels.painted(o, {"wall": 1, "door": 2, "window": 3})


@query(f"SELECT image, x // 3 AS x, y // 2 AS y FROM {_DOTS} WHERE x % 3 = 1 AND y % 2 = 1")
def nearest_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.resample(_dots(spark, sf_dir).withColumn("v", F.lit(1)), 3, 2, "v").drop("v")


# --- scalars, reviews, resumable work ----------------------------------------------------------------------------------

@query("""SELECT event_id, substr(sha256('{"k":' || json_extract_string(props, '$.k') || '}'), 1, 20) AS fingerprint FROM events""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of the events' properties (one integer key), and its hash."""
    return read(spark, sf_dir, "events").select("event_id", scalars.fingerprint(scalars.canonical_json(F.col("props"))).alias("fingerprint"))


@query("SELECT o_custkey AS image, o_orderkey % 7 AS id, CASE WHEN arg_max(o_orderpriority, o_orderkey) = '5-LOW' THEN NULL ELSE arg_max(o_orderpriority, o_orderkey) END AS choice, count(*) AS steps FROM orders GROUP BY 1, 2")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as review steps of a customer's seven questions; low priority takes the choice back."""
    choice = F.when(F.col("o_orderpriority") == "5-LOW", "undo").otherwise(F.col("o_orderpriority"))
    steps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 7).alias("id"), F.col("o_orderkey").alias("step"), choice.alias("choice"))
    return streaming.review_state(steps)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND sha256(c.text) = sha256(d.text))")
def not_yet_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content no third document has: what a resumed audit still has to do."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return streaming.not_yet_done(d, d.where("doc_id % 3 = 0"), ["sha"]).select("doc_id")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 97 * least(1.0e0, c_custkey % 50 / 40.0e0) WHEN 1 THEN c_custkey % 97 WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 ELSE greatest(40.0e0, c_custkey % 97 * 1.12e0) END ELSE greatest(40.0e0, c_custkey % 97 * 1.12e0) END AS width FROM customer""")
def door_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    source = F.element_at(F.array(F.lit("measured_swing"), F.lit("surveyed_door"), F.lit("unmarked_interior_gap"), F.lit("door")), (k % 4 + 1).cast("int"))
    width = scalars.door_width((k % 97).cast("double"), source, (k % 50).cast("double"), F.lit(40.0), k % 3 == 0)
    return read(spark, sf_dir, "customer").select(k.alias("id"), width.alias("width"))


@query(f"""WITH p AS (SELECT o.image, o.id AS opening, s.id AS segment, o.length AS w, s.x2 - s.x1 AS n, (o.cx - s.x1) * 100 / (s.x2 - s.x1) AS pos, 2 * o.thickness AS th FROM {sql("openings")} o JOIN {sql("segments")} s ON s.image = o.image WHERE s.horizontal AND o.horizontal),
  q AS (SELECT *, n * pos / 100 AS c, least(w, n) AS f FROM p), r AS (SELECT *, least(greatest(c, f / 2), n - f / 2) AS moved FROM q)
  SELECT image, opening, segment, f AS width, round(100 * moved / n, 6) AS position FROM r WHERE NOT (c - w / 2 >= 0 AND c + w / 2 <= n) AND f >= greatest(12, 0.75 * w) AND abs(moved - c) <= th / 2""")
def fitted_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "openings").where("horizontal").select("image", F.col("id").alias("opening"), "cx", "length", "thickness")
    s = table(spark, sf_dir, "segments").where("horizontal").select("image", F.col("id").alias("segment"), "x1", (F.col("x2") - F.col("x1")).alias("n"))
    fit = scalars.fit_opening(F.col("length"), (F.col("cx") - F.col("x1")) * 100 / F.col("n"), F.col("n"), 2 * F.col("thickness"), F.lit(12.0))
    return o.join(s, "image").withColumn("fit", fit).where("fit is not null").select("image", "opening", "segment", F.col("fit.width").alias("width"), F.round("fit.position", 6).alias("position"))


@query("""WITH e AS (SELECT o_orderkey AS element, o_custkey AS wall, o_orderkey % 101 AS position, 10 + o_orderkey % 40 AS width FROM orders)
  SELECT element, (s_suppkey * 10) + (300 + s_suppkey % 50) * position / 100.0e0 - width / 2.0e0 AS low, (s_suppkey * 10) + (300 + s_suppkey % 50) * position / 100.0e0 + width / 2.0e0 AS high FROM e JOIN supplier ON s_suppkey = wall""")
def element_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements placed on their carrying segment by position in percent and width; those on unknown walls drop out."""
    e = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS element", "o_custkey AS wall", "o_orderkey % 101 AS position", "10 + o_orderkey % 40 AS width")
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS wall", "s_suppkey * 10 AS x1", "s_suppkey * 10 + 300 + s_suppkey % 50 AS x2")
    mid = F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("position") / F.lit(100.0)
    return e.join(s, "wall").select("element", (mid - F.col("width") / F.lit(2.0)).alias("low"), (mid + F.col("width") / F.lit(2.0)).alias("high"))


@query("""SELECT image, region, score, runner_up, coalesce(runner_up > 0.65 * score, false) AS ambiguous FROM (SELECT o_custkey AS image, o_orderkey AS region, o_totalprice AS score, row_number() OVER w AS k, lead(o_totalprice) OVER w AS runner_up FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE k = 1""")
def best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best region of a plan; it is ambiguous if the next one has over 65 % of its score."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("region"), F.col("o_totalprice").alias("score"))
    w = Window.partitionBy("image").orderBy(F.desc("score"), "region")
    best = o.withColumn("k", F.row_number().over(w)).withColumn("runner_up", F.lead("score").over(w)).where("k = 1")
    return best.select("image", "region", "score", "runner_up", F.coalesce(F.col("runner_up") > 0.65 * F.col("score"), F.lit(False)).alias("ambiguous"))


@query("""WITH RECURSIVE w(doc, depth, cur) AS (SELECT c_custkey, 0, c_custkey FROM customer UNION ALL SELECT doc, depth + 1, cur // 3 FROM w WHERE cur % 3 = 0 AND cur > 0) SELECT doc, max(depth) AS depth, min(cur) AS origin FROM w GROUP BY doc""")
def previous_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows each document's `previous` while it was replaced (ids that 3 divides), up to where the chain ends."""
    spark_docs = read(spark, sf_dir, "customer").select("c_custkey")
    step = lambda s: F.when((s["cur"] % 3 == 0) & (s["cur"] > 0), F.struct((s["depth"] + 1).alias("depth"), F.floor(s["cur"] / 3).alias("cur"))).otherwise(s)
    most = F.ceil(F.log(3.0, F.greatest("c_custkey", F.lit(3)))).cast("int") + 1  # no chain is longer
    walk = F.aggregate(F.sequence(F.lit(1), most), F.struct(F.lit(0).alias("depth"), F.col("c_custkey").alias("cur")), lambda s, _: step(s))
    return spark_docs.withColumn("w", walk).select(F.col("c_custkey").alias("doc"), "w.depth", F.col("w.cur").alias("origin"))


# --- evidence ----------------------------------------------------------------------------------------------------------

@query(f"""SELECT image, edge, thickness FROM (SELECT o.image, o.id AS edge, s.id % 17 AS thickness, row_number() OVER (PARTITION BY o.id ORDER BY round(sqrt((o.cx-qx)*(o.cx-qx)+(o.cy-qy)*(o.cy-qy)), 9), s.id) AS k FROM {sql("openings")} o JOIN {sql("segments")} s ON s.image = o.image,
  LATERAL (SELECT least(greatest(o.cx, s.x1), s.x2) AS qx, least(greatest(o.cy, s.y1), s.y2) AS qy)) WHERE k = 1""")
def nearest_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments").select("image", F.col("id").alias("ordinal"), "x1", "y1", "x2", "y2", (F.col("id") % 17).alias("thickness"))
    return evidence.nearest_thickness(table(spark, sf_dir, "openings"), s)


@query(f"""SELECT image, l AS "left", r AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY total, r) AS k FROM (SELECT a.image, a.id AS l, b.id AS r, least(CASE WHEN p <= 20 AND q <= 20 THEN p + q END, CASE WHEN u <= 20 AND v <= 20 THEN u + v END) AS total
  FROM {sql("segments")} a JOIN {sql("segments")} b ON a.image = b.image AND b.id % 2 = 0, LATERAL (SELECT sqrt((a.x1-b.x1)*(a.x1-b.x1)+(a.y1-b.y1)*(a.y1-b.y1)) AS p, sqrt((a.x2-b.x2)*(a.x2-b.x2)+(a.y2-b.y2)*(a.y2-b.y2)) AS q, sqrt((a.x1-b.x2)*(a.x1-b.x2)+(a.y1-b.y2)*(a.y1-b.y2)) AS u, sqrt((a.x2-b.x1)*(a.x2-b.x1)+(a.y2-b.y1)*(a.y2-b.y1)) AS v)) WHERE total IS NOT NULL) WHERE k = 1""")
def fuzzy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments")
    return evidence.fuzzy_spans(s, s.where("id % 2 = 0"), 20.0)


@query("""WITH m AS (SELECT o_custkey AS image, o_orderkey // 3 * 3 AS opening, o_orderkey % 5 AS wall, 10 + o_orderkey % 4 AS t FROM orders WHERE o_orderkey % 3 < 2), n AS (SELECT image, opening, count(*) AS n, min(wall) AS wall, min(t) AS t FROM m GROUP BY ALL)
  SELECT o.o_custkey AS image, o.o_orderkey AS opening, CASE WHEN n IS NULL THEN 'no_measurement' WHEN n > 1 THEN 'several_measurements' WHEN n.wall = 4 THEN 'missing_wall' WHEN abs(t - (8 + n.wall)) > 0.25 * (8 + n.wall) THEN 'thickness_mismatch' ELSE 'confirmed' END AS status
  FROM orders o LEFT JOIN n ON n.image = o_custkey AND opening = o_orderkey""")
def measurement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    m = o.where("o_orderkey % 3 < 2").selectExpr("o_custkey AS image", "o_orderkey AS id", "array(o_orderkey div 3 * 3) AS opening_ids", "o_orderkey % 5 AS wall", "10 + o_orderkey % 4 AS thickness")
    walls = o.select(F.col("o_custkey").alias("image")).distinct().select("image", F.explode(F.array(*(F.lit(k).cast("long") for k in range(4)))).alias("wall")).withColumn("thickness", F.col("wall") + 8)
    return evidence.measurement_status(o.selectExpr("o_custkey AS image", "o_orderkey AS id"), m, walls)


@query("""WITH l AS (SELECT o_custkey AS image, o_orderkey % 6 AS jamb, o_orderkey % 7 AS stub FROM orders) SELECT image, jamb, stub FROM l WHERE (image, jamb) IN (SELECT image, jamb FROM l GROUP BY ALL HAVING count(*) = 1) AND (image, stub) IN (SELECT image, stub FROM l GROUP BY ALL HAVING count(*) = 1)""")
def one_to_one_jambs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.one_to_one(read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey % 6 AS jamb", "o_orderkey % 7 AS stub"), "jamb", "stub")


@query("""SELECT l_suppkey AS image, l_linenumber AS segment, median(l_quantity) AS width, count(*) AS n, max(l_quantity) <= 1.4 * min(l_quantity) AS consistent FROM lineitem GROUP BY 1, 2""")
def cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.cross_sections(read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image", "l_linenumber AS segment", "l_quantity AS width"))


@query(f"""SELECT image, id, CASE WHEN thickness < 5 THEN 'interior' WHEN length < 15 AND horizontal THEN 'endcap' WHEN thickness > 12 OR length / thickness < 1.5 THEN 'duplicate' WHEN cx < 20 THEN 'one_sided' ELSE 'kept' END AS route FROM {sql("openings")}""")
def opening_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings leave at the first rule of a fixed precedence that claims them."""
    t, n = F.col("thickness"), F.col("length")
    steps = [(t < 5, "interior"), ((n < 15) & F.col("horizontal"), "endcap"), ((t > 12) | (n / t < 1.5), "duplicate"), (F.col("cx") < 20, "one_sided")]
    return evidence.routed(table(spark, sf_dir, "openings"), steps).select("image", "id", "route")


@query(f"""SELECT image, min(id) AS id FROM {sql("openings")} WHERE length > 30 GROUP BY image HAVING count(*) = 1""")
def only_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.only_proposal(table(spark, sf_dir, "openings").where("length > 30"), ["image"]).select("image", "id")


@query("""WITH n AS (SELECT o_custkey AS image, o_orderkey AS id, CAST(o_orderkey * 53 % 200 AS DOUBLE) AS x, CAST(o_orderkey * 29 % 5 AS DOUBLE) AS y, CASE WHEN o_orderkey % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS dx FROM orders)
  SELECT image, a, b, distance FROM (SELECT a.image, a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance, a.dx * (b.x - a.x) AS ca, -b.dx * (b.x - a.x) AS cb FROM n a JOIN n b ON a.image = b.image AND a.id < b.id)
  WHERE distance BETWEEN 20 AND 90 AND ca / distance >= 0.98 AND cb / distance >= 0.98""")
def endpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey AS id", "CAST(o_orderkey * 53 % 200 AS DOUBLE) AS x", "CAST(o_orderkey * 29 % 5 AS DOUBLE) AS y", "CASE WHEN o_orderkey % 2 = 0 THEN 1.0D ELSE -1.0D END AS dx", "0.0D AS dy")
    return evidence.endpoint_pairs(nodes, 20.0, 90.0)


@query(f"""SELECT image, node, count(*) AS degree, CASE count(*) WHEN 1 THEN 'end' WHEN 2 THEN 'line' WHEN 3 THEN 'T' ELSE 'X' END AS kind FROM (SELECT image, a AS node FROM {_EDGES} UNION ALL SELECT image, b FROM {_EDGES}) GROUP BY ALL""")
def junction_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.node_degrees(_edges(spark, sf_dir))


@query("""WITH s AS (SELECT c_custkey AS image, [c_custkey % 7, c_custkey % 5, c_custkey % 11, c_custkey % 3] AS v FROM customer), m AS (SELECT image, k, list_sum(list_filter(v, lambda x, i: (k >> (i - 1)) & 1 = 1)) AS total FROM s, range(1, 16) AS r(k))
  SELECT c_custkey AS image, best FROM customer LEFT JOIN (SELECT image, arg_min(k, CAST(bit_count(k) AS INTEGER) * 100 + k) AS best FROM m WHERE total >= 12 GROUP BY image) ON image = c_custkey""")
def least_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest subset of four candidates whose sizes add up to twelve, as a bit mask."""
    v = F.array(*(F.col("c_custkey") % k for k in (7, 5, 11, 3)))
    enough = lambda chosen: F.aggregate(chosen, F.lit(0).cast("long"), lambda s, x: s + x) >= 12
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"), evidence.least_subset(v, 4, enough).alias("best"))


@query("""SELECT lang, count(*) FILTER (e IS NULL) AS ok, count(*) FILTER (e IS NOT NULL) AS failed, min(e) AS first_error FROM (SELECT lang, CASE WHEN n_chars < 500 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' END AS e FROM documents) GROUP BY lang""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an audit passed or failed, with the reason, for each language."""
    error = F.when(F.col("n_chars") < 500, "too_short").when(F.col("n_chars") > 8000, "too_long")
    return evidence.captured(read(spark, sf_dir, "documents"), ["lang"], error)


@query(f"""SELECT image, id FROM (SELECT *, row_number() OVER (PARTITION BY image, least(x1, x2), least(y1, y2), greatest(x1, x2), greatest(y1, y2) ORDER BY id) AS k FROM {sql("segments")}) WHERE k = 1""")
def first_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of segments with the same ends the first one."""
    return binding.first_by_ends(table(spark, sf_dir, "segments"), ["id"]).select("image", "id")


@query(f"""SELECT image, count(*) AS segments, sum(x2 - x1 + y2 - y1) AS total_length, count(*) FILTER (horizontal) AS horizontal FROM {sql("segments")} GROUP BY image""")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and summed edge lengths of each plan."""
    s = table(spark, sf_dir, "segments")
    length = geo.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return s.groupBy("image").agg(F.count("*").alias("segments"), F.sum(length).alias("total_length"), F.count_if("horizontal").alias("horizontal"))


# --- topology ----------------------------------------------------------------------------------------------------------

@query(f"""WITH RECURSIVE ends AS (SELECT image, id, angle, a AS node FROM {_GRID} UNION ALL SELECT image, id, angle, b FROM {_GRID}), two AS (SELECT image, node FROM ends GROUP BY ALL HAVING count(*) = 2),
  link AS (SELECT u.image, u.id AS u, v.id AS v FROM ends u JOIN ends v USING (image, node) JOIN two USING (image, node) WHERE u.id <> v.id AND abs(u.angle - v.angle) <= 8),
  r(image, id, other) AS (SELECT image, id, id FROM {_GRID} UNION SELECT r.image, r.id, l.v FROM r JOIN link l ON l.image = r.image AND l.u = r.other), c AS (SELECT image, id, min(other) AS chain FROM r GROUP BY ALL)
  SELECT c.image, chain, count(*) AS n, sum(length) AS length, sum(length * (g.id % 6)) / sum(length) AS thickness FROM c JOIN {_GRID} g USING (id) GROUP BY c.image, chain""")
def contracted_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey AS id", "o_orderkey % 12 AS a", "(o_orderkey + 1 + o_orderkey % 2) % 12 AS b", "CASE WHEN o_orderkey % 4 = 3 THEN 90.0D ELSE 3.0D END AS angle", "CAST(5 + o_orderkey % 9 AS DOUBLE) AS length", "CAST(o_orderkey % 6 AS DOUBLE) AS thickness")
    return topology.contracted(seg)


@query(f"""SELECT n.image, n.id, CASE WHEN count(a.id) = 1 THEN min(a.pos) ELSE n.pos END AS pos, CASE count(a.id) WHEN 0 THEN 'free' WHEN 1 THEN 'snapped' ELSE 'ambiguous' END AS status
  FROM (SELECT image, id, cx AS pos FROM {sql("openings")}) n LEFT JOIN (SELECT image, id, pos FROM {_W}) a ON a.image = n.image AND abs(n.pos - a.pos) <= 3.5 GROUP BY n.image, n.id, n.pos""")
def snapped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "openings").select("image", "id", F.col("cx").alias("pos"))
    return topology.snapped_to_axes(nodes, table(spark, sf_dir, "windows"))


_GAPS = "(SELECT o_custkey % 40 AS image, o_orderkey AS id, CAST(o_orderkey % 3 AS DOUBLE) AS pos, CAST(o_orderkey * 37 % 200 AS DOUBLE) AS low, CAST(o_orderkey * 37 % 200 + 20 + o_orderkey % 30 AS DOUBLE) AS high FROM orders WHERE o_orderkey % 2 = 0)"
_PIECES = "(SELECT o_custkey % 40 AS image, o_orderkey AS id, CASE WHEN o_orderkey % 8 = 1 THEN 'opening' ELSE 'solid' END AS kind, CAST(o_orderkey % 3 AS DOUBLE) AS pos, CAST(o_orderkey * 53 % 220 AS DOUBLE) AS low, CAST(o_orderkey * 53 % 220 + 1 + o_orderkey % 4 AS DOUBLE) AS high FROM orders WHERE o_orderkey % 2 = 1)"


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    line = ["o_custkey % 40 AS image", "o_orderkey AS id", "CAST(o_orderkey % 3 AS DOUBLE) AS pos"]
    gaps = o.where("o_orderkey % 2 = 0").selectExpr(*line, "CAST(o_orderkey * 37 % 200 AS DOUBLE) AS low", "CAST(o_orderkey * 37 % 200 + 20 + o_orderkey % 30 AS DOUBLE) AS high")
    pieces = o.where("o_orderkey % 2 = 1").selectExpr(*line, "CASE WHEN o_orderkey % 8 = 1 THEN 'opening' ELSE 'solid' END AS kind", "CAST(o_orderkey * 53 % 220 AS DOUBLE) AS low", "CAST(o_orderkey * 53 % 220 + 1 + o_orderkey % 4 AS DOUBLE) AS high")
    return gaps, pieces


_UNITS = f"(SELECT g.image, g.id, g.high - g.low AS length, u.k AS unit, count(*) FILTER (p.kind = 'solid') > 0 AS s, count(*) FILTER (p.kind = 'opening') > 0 AS o FROM {_GAPS} g, LATERAL (SELECT unnest(range(CAST(g.low AS BIGINT), CAST(g.high AS BIGINT))) AS k) u LEFT JOIN {_PIECES} p ON p.image = g.image AND p.pos = g.pos AND p.low <= u.k AND u.k < p.high GROUP BY ALL)"


@query(f"""SELECT image, id, length, CAST(count(*) FILTER (s) AS DOUBLE) AS solid, CAST(count(*) FILTER (o) AS DOUBLE) AS opening, greatest(0.0e0, length - count(*) FILTER (s) - count(*) FILTER (o)) AS uncovered FROM {_UNITS} GROUP BY image, id, length""")
def covered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.covered_lengths(*_gaps(spark, sf_dir))


@query(f"""WITH f AS (SELECT image, id, unit - row_number() OVER (PARTITION BY id ORDER BY unit) AS g FROM {_UNITS} WHERE NOT s AND NOT o), m AS (SELECT id, max(n) AS free FROM (SELECT id, g, count(*) AS n FROM f GROUP BY ALL) GROUP BY id)
  SELECT g.image, g.id, CAST(coalesce(free, 0) AS DOUBLE) AS free, coalesce(free, 0) >= greatest(12, 0.6e0 * (high - low)) AS passable FROM {_GAPS} g LEFT JOIN m USING (id)""")
def passable_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.longest_free(*_gaps(spark, sf_dir), least=12.0)


@query(f"""WITH p AS (SELECT image, id AS opening, s AS side, cx + d AS x, cy + CASE WHEN s = 0 THEN -9 ELSE 9 END AS y FROM {sql("openings")}, (VALUES (0), (1)) AS a(s), (VALUES (-4), (0), (4)) AS b(d)),
  h AS (SELECT opening, side, count(*) FILTER (EXISTS (SELECT 1 FROM {sql("rooms")} r WHERE r.image = p.image AND p.x >= r.x1 AND p.x < r.x2 AND p.y >= r.y1 AND p.y < r.y2)) AS n FROM p GROUP BY ALL), k AS (SELECT opening, count(*) FILTER (2 * n > 3) AS sides FROM h GROUP BY ALL)
  SELECT o.image, opening, CASE sides WHEN 2 THEN 'interior' WHEN 1 THEN 'exterior' ELSE 'unknown' END AS status FROM k JOIN {sql("openings")} o ON o.id = opening""")
def probed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three probes on each side of an opening tell whether it is inside, on the facade, or unknown."""
    o = table(spark, sf_dir, "openings").select("image", F.col("id").alias("opening"), "cx", "cy", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(float(d)).alias("d")) for s in (0, 1) for d in (-4, 0, 4)))).alias("p"))
    probes = o.select("image", "opening", "p.side", (F.col("cx") + F.col("p.d")).alias("x"), (F.col("cy") + F.when(F.col("p.side") == 0, -9.0).otherwise(9.0)).alias("y"))
    return topology.probe_sides(probes, table(spark, sf_dir, "rooms"))


@query("""WITH a AS (SELECT l_suppkey AS image, l_linenumber AS n, [l_orderkey % 10 < 8, l_orderkey % 7 < 6, l_orderkey % 5 > 0, l_orderkey % 3 > 0, l_orderkey % 11 < 9, l_partkey % 4 > 0, l_partkey % 3 > 0, l_partkey % 7 < 5, l_partkey % 2 = 0] AS h FROM lineitem)
  SELECT image, count(*) FILTER (len(list_filter(h, lambda x: x)) >= 7 AND list_bool_or(h[1:3]) AND list_bool_or(h[4:6]) AND list_bool_or(h[7:9])) AS supported FROM a GROUP BY image""")
def supported_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine samples of an arc: seven hits, and one in each third."""
    hits = F.array(*(F.expr(e) for e in ("l_orderkey % 10 < 8", "l_orderkey % 7 < 6", "l_orderkey % 5 > 0", "l_orderkey % 3 > 0", "l_orderkey % 11 < 9", "l_partkey % 4 > 0", "l_partkey % 3 > 0", "l_partkey % 7 < 5", "l_partkey % 2 = 0")))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image")).agg(F.count_if(topology.arc_supported(hits)).alias("supported"))


@query("""SELECT c_custkey AS image, CASE WHEN c_custkey % 7 < 2 THEN 'rooms_lost' WHEN c_custkey % 5 = 0 THEN 'area_lost' WHEN (c_custkey % 10) / 100.0e0 <= 0.02 THEN 'no_gain' ELSE 'accepted' END AS reason FROM customer""")
def accepted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology passes that are kept, or the first rule that stops them."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"))
    k = F.col("image")
    before = c.select("image", F.lit(5).alias("rooms"), ((k % 10) / F.lit(100.0)).alias("leak"), F.lit(100.0).alias("area"))
    after = c.select("image", F.when(k % 7 < 2, 4).otherwise(5).alias("rooms"), F.lit(0.0).alias("leak"), F.when(k % 5 == 0, 97.0).otherwise(99.0).alias("area"))
    return topology.accepted_pass(before, after)


@query(f"""WITH s AS (SELECT a.image, a.id, max(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1))) AS best FROM {sql("rooms")} a LEFT JOIN {sql("found_rooms")} b ON a.image = b.image GROUP BY ALL) SELECT image, bool_and(coalesce(best, 0) >= 0.8) AS preserved FROM s GROUP BY image""")
def preserved_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.rooms_preserved(table(spark, sf_dir, "rooms"), table(spark, sf_dir, "found_rooms"), 0.8)


@query("SELECT l_suppkey AS image, l_linenumber AS segment, count(*) AS n, CASE WHEN max(l_quantity + 200) <= 1.2 * min(l_quantity + 200) THEN min(l_quantity + 200) END AS thickness FROM lineitem GROUP BY 1, 2")
def facade_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.facade_votes(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("segment"), (F.col("l_quantity") + 200).alias("vote")))


@query(f"SELECT image, least(a, b) AS lo, greatest(a, b) AS hi, min(a % 6) AS room FROM {_EDGES} GROUP BY image, least(a, b), greatest(a, b) HAVING count(DISTINCT a % 6) = 1")
def facade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.boundary_edges(_edges(spark, sf_dir).withColumn("room", F.col("a") % 6))


@query("""SELECT o_custkey AS image, o_orderkey AS opening, o_orderkey % 50 AS wall, round(greatest(30.0e0, o_orderkey % 90 + 0.5e0), 3) AS width, round(100 * (o_orderkey % 64) / 256.0e0, 6) AS position FROM orders WHERE o_orderkey % 50 < 40""")
def exported_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows on known walls as elements; walls of every plan are 0 to 39, 256 long."""
    o = read(spark, sf_dir, "orders")
    b = o.selectExpr("o_custkey AS image", "o_orderkey AS opening", "o_orderkey % 50 AS wall", "o_orderkey % 90 + 0.5D AS width", "o_orderkey % 64 AS along")
    walls = o.select(F.col("o_custkey").alias("image")).distinct().select("image", F.explode(F.array(*(F.lit(k).cast("long") for k in range(40)))).alias("wall"), F.lit(256.0).alias("length"))
    return topology.exported_windows(b, walls)


@query("""WITH s AS (SELECT c_nationkey AS k, c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS v FROM customer)
  SELECT a.k, a.n, coalesce((SELECT arg_min(b.v, b.n) FROM s b WHERE b.k = a.k AND b.n >= a.n AND b.v IS NOT NULL), (SELECT arg_min(b.v, b.n) FROM s b WHERE b.k = a.k AND b.v IS NOT NULL)) AS used FROM s a""")
def substituted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that can't be loaded is replaced by the next one that can, around the end."""
    s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("v"))
    return topology.circular_fallback(s, ["k"], "n", "v").select("k", "n", "used")


@query(f"""SELECT o.image, o.id AS point, r.id AS box FROM {sql("openings")} o JOIN {sql("rooms")} r ON r.image = o.image AND o.cx BETWEEN r.x1 AND r.x2 AND o.cy BETWEEN r.y1 AND r.y2""")
def grid_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "openings").select("image", "id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return topology.grid_join(points, table(spark, sf_dir, "rooms"), 16.0)


# --- rules and rollups -------------------------------------------------------------------------------------------------

@query(f"""WITH r AS (SELECT *, thickness > 8 AS thick, high - low < 15 AS short FROM {_W} WHERE id % 3 = 0) SELECT image, id FROM r WHERE thick AND NOT short AND NOT EXISTS (SELECT 1 FROM {_W} k WHERE k.id % 3 <> 0 AND k.image = r.image AND k.pos = r.pos AND greatest(0, least(k.high, r.high) - greatest(k.low, r.low)) / (r.high - r.low) > 0.2)""")
def recoverable_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "windows")
    reasons = F.array_compact(F.array(F.when(F.col("thickness") > 8, "too_thick"), F.when(F.col("high") - F.col("low") < 15, "too_short")))
    return rules.recoverable(w.where("id % 3 = 0").withColumn("reasons", reasons), w.where("id % 3 <> 0")).select("image", "id")


@query(f"SELECT image, count(*) FILTER ((x2 - x1 - 9) / (x2 - x1) < 0.9) AS n, count(*) AS polygons FROM {sql('rooms')} GROUP BY image")
def non_rectangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rooms").select("image", ((F.col("x2") - F.col("x1") - 9) * (F.col("y2") - F.col("y1"))).alias("area"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("box_area"))
    return rules.non_rectangular(r)


@query("SELECT o_custkey AS image, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'door' ELSE 'passage' END AS kind FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 AND o_orderkey % 5 > 0")
def confirmed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey AS id", "o_orderkey % 2 = 0 AS interior", "o_orderkey % 5 > 0 AS confirmed")
    return rules.confirmed_passages(o.where("id % 3 = 0"), o.where("id % 3 = 1")).select("image", "id", "kind")


@query("""SELECT c_custkey AS answer, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 6 = 5 THEN 'id_keys' ELSE 'choice' END AS error FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 6 = 5 OR (c_custkey % 3 = 1 AND c_custkey % 4 > 1) OR (c_custkey % 3 = 2 AND c_custkey % 4 < 2)""")
def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with one id key each and a choice that fits it, or what is wrong."""
    k = F.col("c_custkey")
    a = read(spark, sf_dir, "customer").select(k.alias("answer"), F.when((k % 3 == 1) | (k % 6 == 5), k).alias("opening_id"), F.when(k % 3 == 2, k).alias("room_id"), F.element_at(F.array(*map(F.lit, ("door", "window", "keep", "merge"))), (k % 4 + 1).cast("int")).alias("choice"))
    return rules.answer_errors(a, ["opening_id", "room_id"], {"opening_id": ["door", "window"], "room_id": ["keep", "merge"]})


@query("""SELECT o_custkey % 20 AS run, count(*) AS cases, count(*) FILTER (o_orderkey % 3 > 0) AS annotated, count(*) FILTER (o_orderkey % 3 > 0 AND o_orderkey % 7 = o_orderkey % 5) AS exact, coalesce(sum(least(o_orderkey % 7, o_orderkey % 5)) FILTER (o_orderkey % 3 > 0), 0)::BIGINT AS tp,
  coalesce(sum(greatest(0, o_orderkey % 5 - o_orderkey % 7)) FILTER (o_orderkey % 3 > 0), 0)::BIGINT AS fp, coalesce(sum(greatest(0, o_orderkey % 7 - o_orderkey % 5)) FILTER (o_orderkey % 3 > 0), 0)::BIGINT AS fn FROM orders GROUP BY 1""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "orders").selectExpr("o_custkey % 20 AS run", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS expected", "o_orderkey % 5 AS predicted", "least(o_orderkey % 7, o_orderkey % 5) AS tp", "greatest(0, o_orderkey % 5 - o_orderkey % 7) AS fp", "greatest(0, o_orderkey % 7 - o_orderkey % 5) AS fn")
    return rules.run_rollup(cases)


@query(f"""WITH a AS (SELECT * FROM {_DOTS} WHERE x % 3 > 0), b AS (SELECT * FROM {_DOTS} WHERE x % 4 > 0), bx AS (SELECT i AS image, k AS id, 7 * k AS x1, 5 * k AS y1, 7 * k + 9 AS x2, 5 * k + 8 AS y2 FROM (SELECT DISTINCT image AS i FROM a) AS r, range(6) AS s(k))
  SELECT bx.image, bx.id, (SELECT count(*) FROM b WHERE b.image = bx.image AND b.x BETWEEN x1 AND x2 AND b.y BETWEEN y1 AND y2 AND b.x % 3 = 0) AS gained, (SELECT count(*) FROM a WHERE a.image = bx.image AND a.x BETWEEN x1 AND x2 AND a.y BETWEEN y1 AND y2 AND a.x % 4 = 0) AS lost FROM bx""")
def changed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dots(spark, sf_dir)
    boxes = d.where("x % 3 > 0").select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("id")).selectExpr("image", "CAST(id AS BIGINT) AS id", "7 * id AS x1", "5 * id AS y1", "7 * id + 9 AS x2", "5 * id + 8 AS y2")
    return rules.changed_area(d.where("x % 3 > 0"), d.where("x % 4 > 0"), boxes)


@query(f"""WITH f AS (SELECT * FROM (SELECT image, id, length, cx AS mid, row_number() OVER (PARTITION BY image ORDER BY length, id) AS k FROM {sql("openings")}) WHERE k <= 24) SELECT image, id FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.image = f.image AND o.k < f.k AND abs(o.mid - f.mid) <= 5)""")
def ranked_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 shortest candidates of a plan, the operator's own number, without those near a shorter one."""
    return rules.ranked_apart(table(spark, sf_dir, "openings").select("image", "id", "length", F.col("cx").alias("mid"))).select("image", "id")


@query("""SELECT image, opening, id FROM (SELECT o_custkey AS image, o_orderkey % 4 AS opening, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey * 7 % 10 DESC, o_orderkey * 3 % 17, o_orderkey) AS k FROM orders) WHERE k = 1""")
def best_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.best_hinge(read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey % 4 AS opening", "o_orderkey AS id", "o_orderkey * 7 % 10 AS hits", "o_orderkey * 3 % 17 AS distance"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS leaks FROM documents GROUP BY lang")
def selected_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection (all documents) against a reserved list (labels of low quality)."""
    return rules.selected_buckets(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 0"), "lang", "doc_id")


@query("SELECT l_suppkey AS image, count(*) FILTER (c = 'supported') AS supported, count(*) FILTER (c = 'probable') AS probable, count(*) FILTER (c = 'partial') AS partial, count(*) FILTER (c = 'unsupported') AS unsupported FROM (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 AND l_quantity / 50 >= 0.55 THEN 'supported' WHEN l_linenumber % 2 = 0 AND l_quantity / 50 >= 0.5 THEN 'probable' WHEN l_quantity / 50 >= 0.15 THEN 'partial' ELSE 'unsupported' END AS c FROM lineitem) GROUP BY 1")
def boundary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.boundary_class(F.col("l_quantity") / 50, F.col("l_linenumber") % 2 == 0)
    names = ["supported", "probable", "partial", "unsupported"]
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), kind.alias("c")).groupBy("image").pivot("c", names).count().na.fill(0)


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS image, l_linenumber % 2 AS id, l_linenumber % 4 AS side, l_partkey % 50 AS pos FROM lineitem), o AS (SELECT *, pos % 7 > 2 AS "on", row_number() OVER (PARTITION BY image, id, side ORDER BY pos) AS n FROM b),
  g AS (SELECT image, id, side, n - row_number() OVER (PARTITION BY image, id, side ORDER BY pos) AS k FROM o WHERE NOT "on"), l AS (SELECT image, id, side, max(c) AS longest FROM (SELECT image, id, side, k, count(*) AS c FROM g GROUP BY ALL) GROUP BY ALL)
  SELECT o.image, o.id, o.side, count(*) FILTER ("on") / count(*) AS support, coalesce(max(longest), 0) AS longest_gap FROM o LEFT JOIN l ON l.image = o.image AND l.id = o.id AND l.side = o.side GROUP BY o.image, o.id, o.side""")
def side_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image", "l_linenumber % 2 AS id", "l_linenumber % 4 AS side", "l_partkey % 50 AS pos").distinct()
    return rules.side_support(b.withColumn("on", F.col("pos") % 7 > 2))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 50 % 4 = 0 THEN 'bytes' WHEN c_nationkey % 3 = 0 THEN 'pixels' ELSE 'default' END AS profile FROM customer""")
def image_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.sha2((F.col("c_custkey") % 50).cast("string").cast("binary"), 256).alias("byte_hash"), F.sha2(F.col("c_nationkey").cast("string").cast("binary"), 256).alias("pixel_hash"))
    sha = lambda ks: spark.createDataFrame([(str(k),) for k in ks], "k string").select(F.sha2(F.col("k").cast("binary"), 256).alias("h"))
    exact = sha(range(0, 50, 4)).select(F.col("h").alias("byte_hash"), F.lit("bytes").alias("profile"))
    return rules.profile_of(images, exact, sha(range(0, 25, 3)).select(F.col("h").alias("pixel_hash"), F.lit("pixels").alias("profile")))


from . import exports  # noqa: E402, F401

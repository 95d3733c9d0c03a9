"""Queries of the exporting operators, with their SQL; the catalogue imports this module last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import exporting
from .catalogue import BOUND_SQL, query, read
from .derived import sql, table

_CHOICES = "CASE WHEN c_custkey % 5 < 2 THEN 'door,open_passage,ignore' WHEN c_custkey % 5 = 2 THEN 'door,window,open_passage,ignore' ELSE 'door,window,ignore' END"


@query(f"SELECT c_custkey AS id, {_CHOICES} AS choices FROM customer")
def review_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*(F.lit(x) for x in ("unmarked_exterior_gap", "unmarked_interior_gap", "outlined_wall_frame", "door", None))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(exporting.opening_choices(source), ",").alias("choices"))


@query("""SELECT c_custkey AS id, round((c_custkey % 97 + 60) / 200.0e0, 5) AS x0, round(-((c_custkey % 97 + 60) / 200.0e0), 5) AS x1, round((c_custkey % 31 + 180) / 100.0e0, 5) AS y0, 0.0e0 AS y2, 5 AS n, round(round((c_custkey % 97 + 60) / 200.0e0, 5) * 1.25e0, 5) AS scaled_x, round(round((c_custkey % 31 + 180) / 100.0e0, 5) * 0.5e0, 5) AS scaled_y,
  round((c_custkey % 31 + 180) / 100.0e0, 5) AS sill_y FROM customer""")
def hole_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", exporting.hole_shape((F.col("c_custkey") % 97 + 60).cast("double"), (F.col("c_custkey") % 31 + 180).cast("double")).alias("h"))
    c = c.withColumn("s", exporting.scaled_hole(F.col("h"), F.lit(1.25), F.lit(0.5))).withColumn("sill", exporting.scaled_sill(F.col("h"), F.lit(1.25)))
    at = lambda name, i, k: F.col(name)[i][k]
    return c.select(F.col("c_custkey").alias("id"), at("h", 0, "x").alias("x0"), at("h", 1, "x").alias("x1"), at("h", 0, "y").alias("y0"), at("h", 2, "y").alias("y2"), F.size("h").alias("n"), at("s", 0, "x").alias("scaled_x"), at("s", 0, "y").alias("scaled_y"), at("sill", 0, "y").alias("sill_y"))


@query(f"""SELECT image, id, CASE WHEN id % 4 = 0 THEN x1 ELSE x1 + 3 END AS low, CASE WHEN id % 4 = 0 THEN x2 ELSE x2 - 3 END AS high FROM {sql("segments")}""")
def carrier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of trimmed cuts (ids that 4 divides) and clear spans of the others."""
    s = table(spark, sf_dir, "segments")
    span = exporting.carrier_span(F.when(F.col("id") % 4 == 0, "visible_window_jambs").when(F.col("id") % 4 == 1, "other"), F.struct(F.col("x1").alias("low"), F.col("x2").alias("high")), F.struct((F.col("x1") + 3).alias("low"), (F.col("x2") - 3).alias("high")))
    return s.select("image", "id", span["low"].alias("low"), span["high"].alias("high"))


_BAY = f"""SELECT image, id, x1, y1, x2, y2, x1 + id % 3 AS sx1, y1 + (y2 - y1) / 2 AS sy1, x2 - id % 5 AS sx2, y1 + (y2 - y1) / 2 + id % 7 AS sy2, x1 + id % 3 + id % 4 AS bay1, x2 - id % 5 AS bay2, CASE WHEN id % 6 = 0 THEN 0.7e0 ELSE 0.9e0 END AS support, id % 8 <> 0 AS is_bay
  FROM (SELECT image, id, cx - length AS x1, cy - thickness AS y1, cx + length AS x2, cy + thickness AS y2 FROM {sql("openings")})"""


@query(f"""WITH b AS ({_BAY}), e AS (SELECT *, x2 - x1 >= y2 - y1 AS wide, abs(sx2 - sx1) >= abs(sy2 - sy1) AS flat, abs(sx2 - sx1) AS dx, abs(sy2 - sy1) AS dy FROM b),
  f AS (SELECT *, CASE WHEN flat THEN least(sx1, sx2) ELSE least(sy1, sy2) END AS lo, CASE WHEN flat THEN greatest(sx1, sx2) ELSE greatest(sy1, sy2) END AS hi, CASE WHEN flat THEN x1 ELSE y1 END AS blo, CASE WHEN flat THEN x2 ELSE y2 END AS bhi FROM e),
  g AS (SELECT *, is_bay AND support >= 0.8 AND least(dx, dy) <= 0.1 * greatest(dx, dy) AND flat = wide AND abs(lo - bay1) <= 2 AND abs(hi - bay2) <= 2 AND hi - lo >= greatest(20, 0.4 * (bhi - blo)) AND greatest(0, least(hi, bhi) - greatest(lo, blo)) >= 0.7 * (hi - lo) AND hi - lo <= bhi - blo + 20 AS ok FROM f)
  SELECT image, id, CASE WHEN ok THEN (sx1 + sx2) / 2 ELSE (x1 + x2) / 2 END AS cx, CASE WHEN ok THEN (sy1 + sy2) / 2 ELSE (y1 + y2) / 2 END AS cy, CASE WHEN ok THEN hi - lo ELSE greatest(x2 - x1, y2 - y1) END AS length, CASE WHEN ok THEN 'raster_clear_bay' ELSE 'segmentation_bbox' END AS source FROM g""")
def export_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of openings, and measured bays that agree with some of them."""
    o = table(spark, sf_dir, "openings").selectExpr("image", "id", "cx - length AS x1", "cy - thickness AS y1", "cx + length AS x2", "cy + thickness AS y2")
    k = F.col("id")
    mid = F.col("y1") + (F.col("y2") - F.col("y1")) / 2
    span = (F.col("x1") + k % 3, mid, F.col("x2") - k % 5, mid + k % 7)
    found = exporting.export_geometry(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), span, (F.col("x1") + k % 3 + k % 4, F.col("x2") - k % 5), F.when(k % 6 == 0, 0.7).otherwise(0.9), k % 8 != 0)
    return o.withColumn("g", found).select("image", "id", "g.cx", "g.cy", "g.length", "g.source")


@query(f"""SELECT image, id, CASE WHEN horizontal THEN x1 ELSE x1 - thickness / 2 END AS x_low, CASE WHEN horizontal THEN y1 + thickness / 2 ELSE y2 END AS y_high, (x2 - x1 + y2 - y1) * thickness AS area FROM {sql("segments")}""")
def strip_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "segments").withColumn("ring", exporting.strip_ring(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "thickness")))).withColumn("box", geo.ring_box(F.col("ring")))
    return s.select("image", "id", F.col("box.x1").alias("x_low"), F.col("box.y2").alias("y_high"), geo.ring_area(F.col("ring")).alias("area"))


_AXES = f"(SELECT image, id, horizontal, length, CASE WHEN horizontal THEN cx - length / 2 ELSE cx END AS x1, CASE WHEN horizontal THEN cy ELSE cy - length / 2 END AS y1, CASE WHEN horizontal THEN cx + length / 2 ELSE cx END AS x2, CASE WHEN horizontal THEN cy ELSE cy + length / 2 END AS y2, thickness AS width FROM {sql('openings')})"


@query(f"""SELECT DISTINCT o.image, o.id FROM {_AXES} o JOIN {sql("segments")} b ON b.image = o.image AND b.id % 2 = 0 WHERE o.horizontal = b.horizontal AND CASE WHEN o.horizontal THEN abs(o.y1 - b.y1) ELSE abs(o.x1 - b.x1) END <= greatest(2, o.width / 2)
  AND CASE WHEN o.horizontal THEN least(o.x2, b.x2) - greatest(o.x1, b.x1) ELSE least(o.y2, b.y2) - greatest(o.y1, b.y1) END >= 0.5 * o.length""")
def on_existing_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges are the segments with even ids."""
    o, flat, half = table(spark, sf_dir, "openings"), F.col("horizontal"), F.col("length") / 2
    axis = o.select("image", "id", F.when(flat, F.col("cx") - half).otherwise(F.col("cx")).alias("x1"), F.when(flat, F.col("cy")).otherwise(F.col("cy") - half).alias("y1"), F.when(flat, F.col("cx") + half).otherwise(F.col("cx")).alias("x2"), F.when(flat, F.col("cy")).otherwise(F.col("cy") + half).alias("y2"), F.col("thickness").alias("width"))
    return exporting.on_existing_carrier(axis, table(spark, sf_dir, "segments").where("id % 2 = 0"))


@query(f"""WITH {BOUND_SQL}, p AS (SELECT u.image, u.opening, u.segment, u.status, u.reasons, row_number() OVER (PARTITION BY u.image ORDER BY u.opening) AS "index", c.w, c.th, c.d, c.aligned, n.len, least(1.0e0, greatest(0.0e0, n.t)) AS t FROM bound u LEFT JOIN c ON c.opening = u.opening AND c.segment = u.segment
    LEFT JOIN (SELECT o.id AS opening, s.id AS segment, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len, ((cx-x1)*(x2-x1) + (cy-y1)*(y2-y1)) / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS t FROM {sql("openings")} o JOIN {sql("segments")} s ON s.image = o.image) n ON n.opening = u.opening AND n.segment = u.segment),
  q AS (SELECT *, len * (100 * t) / 100 AS c0, least(w, len) AS f FROM p), r AS (SELECT *, least(greatest(c0, f / 2), len - f / 2) AS moved FROM q),
  z AS (SELECT *, coalesce(reasons = '' AND aligned AND status <> 'ambiguous' AND d <= th / 2 AND NOT (c0 - w / 2 >= 0 AND c0 + w / 2 <= len) AND f >= greatest(12, 0.75 * w) AND abs(moved - c0) <= th / 2, false) AS fitted FROM r)
  SELECT image, opening, "index", segment, CASE WHEN reasons = '' THEN CASE WHEN fitted THEN f ELSE w END END AS width, CASE WHEN reasons = '' THEN round(CASE WHEN fitted THEN 100 * moved / len ELSE 100 * t END, 6) END AS position, fitted, reasons AS unplaced FROM z""")
def placed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exporting.placed(table(spark, sf_dir, "openings"), table(spark, sf_dir, "segments"))
    return found.withColumn("position", F.round("position", 6)).withColumn("index", F.col("index").cast("long"))


@query(f"""WITH {BOUND_SQL} SELECT u.image, count(*) AS examined, count(*) FILTER (u.segment IS NULL OR NOT aligned OR d > greatest(20, 1.5 * th) OR over > 5) AS suspect, count(*) FILTER (u.segment IS NULL) AS no_wall_segments, count(*) FILTER (NOT aligned) AS misaligned_wall,
  count(*) FILTER (d > greatest(20, 1.5 * th)) AS far_from_wall, count(*) FILTER (over > 5) AS exceeds_segment FROM bound u LEFT JOIN c ON c.opening = u.opening AND c.segment = u.segment GROUP BY u.image""")
def preflight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.preflight_summary(exporting.preflight(table(spark, sf_dir, "openings"), table(spark, sf_dir, "segments")))


_NODES = "(SELECT o_custkey AS image, o_orderkey % 23 AS id, (o_orderkey * 37) % 40 AS x, (o_orderkey * 91) % 30 AS y FROM orders)"
_LINKS = "(SELECT o_custkey AS image, o_orderkey AS id, o_orderkey % 23 AS a, (o_orderkey * 7 + 5) % 23 AS b, o_orderkey % 9 - 1 AS thickness FROM orders)"


@query(f"""WITH nodes AS {_NODES}, e AS {_LINKS}, n1 AS (SELECT image, id, min(x) AS x, min(y) AS y, count(*) AS k FROM nodes GROUP BY ALL),
  l AS (SELECT e.*, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM e LEFT JOIN n1 p ON p.image = e.image AND p.id = e.a AND p.k = 1 LEFT JOIN n1 q ON q.image = e.image AND q.id = e.b AND q.k = 1)
  SELECT image, 'duplicate_id' AS fault, CAST(id AS VARCHAR) AS subject FROM n1 WHERE k > 1
  UNION ALL SELECT image, 'duplicate_position', CAST(min(id) AS VARCHAR) FROM nodes GROUP BY image, x, y HAVING count(*) > 1
  UNION ALL SELECT image, 'missing_node', CAST(id AS VARCHAR) FROM e WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.image = e.image AND n1.id = e.a) OR NOT EXISTS (SELECT 1 FROM n1 WHERE n1.image = e.image AND n1.id = e.b)
  UNION ALL SELECT image, 'degenerate_edge', CAST(id AS VARCHAR) FROM e WHERE a = b
  UNION ALL SELECT image, 'invalid_thickness', CAST(id AS VARCHAR) FROM e WHERE thickness <= 0
  UNION ALL SELECT image, 'duplicate_edge', CAST(max(id) AS VARCHAR) FROM e WHERE a <> b GROUP BY image, least(a, b), greatest(a, b) HAVING count(*) > 1""")
def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of node and edge lists; crossings are tested by tests/test_exports.py."""
    o = read(spark, sf_dir, "orders")
    nodes = o.selectExpr("o_custkey AS image", "o_orderkey % 23 AS id", "(o_orderkey * 37) % 40 AS x", "(o_orderkey * 91) % 30 AS y")
    edges = o.selectExpr("o_custkey AS image", "o_orderkey AS id", "o_orderkey % 23 AS a", "(o_orderkey * 7 + 5) % 23 AS b", "CAST(o_orderkey % 9 - 1 AS DOUBLE) AS thickness")
    return exporting.graph_faults(nodes, edges).where("fault <> 'unnoded_crossing'")


_INK = "SELECT l_suppkey % 7 AS image, CASE WHEN l_quantity < 48 THEN 0 ELSE l_suppkey % 3 + 1 END AS component, CASE WHEN l_quantity < 48 THEN 1 + l_linenumber ELSE 1 + l_linenumber % 2 END AS radius, l_discount > 0.05 AS support FROM lineitem"


@query(f"""WITH p AS ({_INK}), t AS (SELECT image, greatest(2.0e0, 2 * quantile_cont(radius, 0.75) FILTER (radius > 1)) AS th FROM p GROUP BY image), o AS (SELECT image, component, count(*) AS area, quantile_cont(radius, 0.9) AS radius FROM p GROUP BY ALL), m AS (SELECT *, max(area) OVER (PARTITION BY image) AS largest FROM o)
  SELECT image, component, area, CAST(radius AS DOUBLE) AS radius FROM m JOIN t USING (image) WHERE area >= greatest(64, 0.01 * largest) AND area < 0.05 * largest AND radius < 0.25 * th""")
def detached_linework(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.detached_components(_ink(spark, sf_dir)).withColumn("radius", F.col("radius").cast("double"))


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, main = read(spark, sf_dir, "lineitem"), F.col("l_quantity") < 48
    return li.select((F.col("l_suppkey") % 7).alias("image"), F.when(main, 0).otherwise(F.col("l_suppkey") % 3 + 1).alias("component"), F.when(main, 1 + F.col("l_linenumber")).otherwise(1 + F.col("l_linenumber") % 2).alias("radius"), (F.col("l_discount") > 0.05).alias("support"))


@query(f"SELECT image, component, count(*) AS area, count(*) FILTER (support) AS supported FROM ({_INK}) GROUP BY ALL HAVING count(*) >= 24 AND count(*) FILTER (support) >= 0.45 * count(*)")
def supported_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.supported_components(_ink(spark, sf_dir))


@query(f"""SELECT image, round(sum(CAST(id % 17 AS DOUBLE) * (x2 - x1 + y2 - y1)) / sum(x2 - x1 + y2 - y1), 6) AS mean, median(CAST(id % 17 AS DOUBLE)) AS median FROM {sql("segments")} GROUP BY image""")
def weighted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a value of each image's segments, weighted by their length, and its median."""
    s = table(spark, sf_dir, "segments").selectExpr("image", "CAST(id % 17 AS DOUBLE) AS value", "x2 - x1 + y2 - y1 AS length")
    return exporting.weighted_means(s, ["image"], "value", "length").withColumn("mean", F.round("mean", 6))


_MESSAGES = "SELECT o_custkey AS image, o_orderkey AS ord, 'c' || CAST(o_orderkey % 5 AS VARCHAR) AS code, CASE o_orderkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, 'm' || CAST(o_orderkey % 6 AS VARCHAR) AS message FROM orders"


@query(f"""WITH i AS ({_MESSAGES}), o AS (SELECT image, severity = 'error' AS bad, message, min(ord) AS ord FROM i GROUP BY ALL)
  SELECT image, coalesce(string_agg(message, ',' ORDER BY ord) FILTER (bad), '') AS errors, coalesce(string_agg(message, ',' ORDER BY ord) FILTER (NOT bad), '') AS warnings, coalesce(min(codes), '') AS codes
  FROM o LEFT JOIN (SELECT image, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT DISTINCT image, code FROM i WHERE severity = 'warning') GROUP BY image) USING (image) GROUP BY image""")
def issue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    issues = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), k.alias("ord"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("code"), F.when(k % 3 == 0, "error").when(k % 3 == 1, "warning").otherwise("info").alias("severity"), F.concat(F.lit("m"), (k % 6).cast("string")).alias("message"))
    return exporting.messages(issues).select("image", *(F.array_join(c, ",").alias(c) for c in ("errors", "warnings", "codes")))


@query("""SELECT c_custkey AS id, 'floor ' || printf('%.3f', c_custkey % 8 / 8.0e0) || ' | wall ' || printf('%.3f', c_custkey % 4 / 4.0e0) AS line, strftime(make_timestamp(1700000000000000 + c_custkey * 3723000125), '%Y-%m-%d_%H-%M-%S_%f') AS run, c_custkey % 3 <> 0 AS valid FROM customer""")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lines and run folders; a name with a capital is no run id."""
    k = F.col("c_custkey")
    local = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=((F.lit(1700000000000000) + k * 3723000125) / 1_000_000).cast("decimal(18,6)")))
    return read(spark, sf_dir, "customer").select(k.alias("id"), exporting.iou_line(["floor", "wall"], F.array(k % 8 / 8.0, k % 4 / 4.0)).alias("line"), exporting.run_name(local).alias("run"), exporting.is_run_id(F.concat(F.when(k % 3 == 0, "Run-").otherwise("run-"), k.cast("string"))).alias("valid"))


_SAMPLES = "SELECT CASE WHEN doc_id % 50 = 0 THEN 'Bad id' WHEN doc_id % 41 = 0 THEN 'twice' ELSE 's' || CAST(doc_id AS VARCHAR) END AS sample_id, CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'g' || CAST(doc_id // 4 AS VARCHAR) END AS group_id, CASE WHEN doc_id % 37 = 0 THEN 'dev' WHEN doc_id // 4 % 10 = 0 AND doc_id % 4 = 1 THEN 'val' WHEN doc_id // 4 % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CAST(doc_id // 2 * 2 AS VARCHAR) END AS sha256, doc_id % 13 <> 0 AS ready, CASE WHEN doc_id % 17 = 0 THEN 'pending' ELSE 'reviewed' END AS review, CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE CAST(doc_id // 2 * 2 AS VARCHAR) END AS actual FROM documents"


@query(f"""WITH s AS ({_SAMPLES}), t AS (SELECT sample_id FROM s GROUP BY 1 HAVING count(*) > 1), g AS (SELECT group_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1), h AS (SELECT sha256 FROM s WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
  SELECT sample_id, 'invalid_id' AS fault FROM s WHERE sample_id = 'Bad id' OR sample_id IN (SELECT sample_id FROM t) UNION ALL SELECT sample_id, 'missing_metadata' FROM s WHERE group_id = '' OR split = 'dev' OR sha256 IS NULL
  UNION ALL SELECT sample_id, 'crosses_splits' FROM s WHERE group_id IN (SELECT group_id FROM g) OR sha256 IN (SELECT sha256 FROM h) UNION ALL SELECT sample_id, 'not_reviewed' FROM s WHERE split = 'val' AND NOT (ready AND review = 'reviewed') UNION ALL SELECT sample_id, 'changed_source' FROM s WHERE split = 'val' AND (sha256 IS NULL OR sha256 <> actual)""")
def mask_manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").selectExpr(
        "CASE WHEN doc_id % 50 = 0 THEN 'Bad id' WHEN doc_id % 41 = 0 THEN 'twice' ELSE concat('s', doc_id) END AS sample_id", "CASE WHEN doc_id % 29 = 0 THEN '' ELSE concat('g', doc_id div 4) END AS group_id",
        "CASE WHEN doc_id % 37 = 0 THEN 'dev' WHEN doc_id div 4 % 10 = 0 AND doc_id % 4 = 1 THEN 'val' WHEN doc_id div 4 % 3 = 0 THEN 'test' ELSE 'train' END AS split", "CASE WHEN doc_id % 31 = 0 THEN NULL ELSE string(doc_id div 2 * 2) END AS sha256",
        "doc_id % 13 <> 0 AS training_ready", "CASE WHEN doc_id % 17 = 0 THEN 'pending' ELSE 'reviewed' END AS group_review", "CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE string(doc_id div 2 * 2) END AS actual_sha256",
    )
    return exporting.manifest_faults(d, "val")


@query("""WITH o AS (SELECT o_custkey AS image, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'doorItem' WHEN 1 THEN 'windowItem' ELSE 'wallOpening' END AS kind, CAST(60 + o_orderkey % 90 AS DOUBLE) AS width, CAST(80 + o_orderkey % 4 * 10 AS DOUBLE) AS tx, CASE WHEN o_orderkey % 50 = 0 THEN 0.0e0 ELSE 200.0e0 END AS ty, -0.4e0 AS low, CASE WHEN o_orderkey % 49 = 0 THEN -0.4e0 ELSE 0.4e0 END AS high FROM orders)
  SELECT image, kind AS type, substring(sha256(concat_ws(':', image, kind, id)), 1, 8) AS head, CASE WHEN kind = 'windowItem' THEN round(tx * (width / ((high - low) * 100)), 4) ELSE width END AS size_x, ty AS size_y, CASE WHEN kind = 'windowItem' THEN 4 ELSE 5 END AS n FROM o WHERE ty > 0 AND (kind <> 'windowItem' OR high > low)""")
def exported_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("o_custkey AS image", "o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'doorItem' WHEN 1 THEN 'windowItem' ELSE 'wallOpening' END AS kind", "CAST(60 + o_orderkey % 90 AS DOUBLE) AS width", "50.0e0 AS position", "CAST(80 + o_orderkey % 4 * 10 AS DOUBLE) AS template_x", "CASE WHEN o_orderkey % 50 = 0 THEN 0.0e0 ELSE 200.0e0 END AS template_y", "-0.4e0 AS low", "CASE WHEN o_orderkey % 49 = 0 THEN -0.4e0 ELSE 0.4e0 END AS high")
    return exporting.exported_elements(o).select("image", "type", F.substring("uuid", 1, 8).alias("head"), "size_x", "size_y", F.size("hole").alias("n"))

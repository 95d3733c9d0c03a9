"""Plan tables derived from the star-schema tables, so that the plan operators run at any scale.

Each table is a select list in SQL that Spark and other engines read alike; an image is a customer, its rows are orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source table, select list, condition)
TABLES: dict[str, tuple[str, str, str]] = {
    "images": ("customer", "c_custkey AS image", "true"),
    "truth": (
        "orders",
        "o_custkey AS image, CASE WHEN o_orderkey % 3 = 0 THEN 'door' ELSE 'window' END AS kind, o_orderkey AS id, CAST((o_orderkey * 37) % 120 AS DOUBLE) AS cx, CAST((o_orderkey * 91) % 100 AS DOUBLE) AS cy, CASE WHEN o_orderkey % 2 = 0 THEN 0.0e0 ELSE 90.0e0 END AS angle, CAST(20 + (o_orderkey * 13) % 60 AS DOUBLE) AS length",
        "true",
    ),
    "found": (
        "orders",
        "o_custkey AS image, CASE WHEN o_orderkey % 3 = 0 THEN 'door' ELSE 'window' END AS kind, o_orderkey AS id, CAST((o_orderkey * 37) % 120 + (o_orderkey * 17) % 15 - 7 AS DOUBLE) AS cx, CAST((o_orderkey * 91) % 100 + (o_orderkey * 5) % 9 - 4 AS DOUBLE) AS cy, CASE WHEN o_orderkey % 2 = 0 THEN 10.0e0 ELSE 80.0e0 END AS angle, CAST(16 + (o_orderkey * 13) % 60 AS DOUBLE) AS length",
        "o_orderkey % 11 <> 0",
    ),
    "rooms": (
        "orders",
        "o_custkey AS image, o_orderkey AS id, CAST((o_orderkey * 37) % 120 AS DOUBLE) AS x1, CAST((o_orderkey * 91) % 100 AS DOUBLE) AS y1, CAST((o_orderkey * 37) % 120 + 10 + (o_orderkey * 13) % 40 AS DOUBLE) AS x2, CAST((o_orderkey * 91) % 100 + 8 + (o_orderkey * 7) % 30 AS DOUBLE) AS y2",
        "true",
    ),
    "found_rooms": (
        "orders",
        "o_custkey AS image, o_orderkey AS id, CAST((o_orderkey * 37) % 120 + o_orderkey % 5 AS DOUBLE) AS x1, CAST((o_orderkey * 91) % 100 AS DOUBLE) AS y1, CAST((o_orderkey * 37) % 120 + 12 + (o_orderkey * 13) % 40 AS DOUBLE) AS x2, CAST((o_orderkey * 91) % 100 + 7 + (o_orderkey * 7) % 30 AS DOUBLE) AS y2",
        "o_orderkey % 7 <> 0",
    ),
    "junctions": ("orders", "o_custkey AS image, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE 'T' END AS type, o_orderkey AS id, CAST((o_orderkey * 37) % 60 AS DOUBLE) AS x, CAST((o_orderkey * 91) % 50 AS DOUBLE) AS y", "true"),
    "found_junctions": ("orders", "o_custkey AS image, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE 'T' END AS type, o_orderkey AS id, CAST((o_orderkey * 37) % 60 + o_orderkey % 13 AS DOUBLE) AS x, CAST((o_orderkey * 91) % 50 AS DOUBLE) AS y", "o_orderkey % 6 <> 1"),
    "segments": (
        "orders",
        "o_custkey AS image, o_orderkey AS id, o_orderkey % 4 < 2 AS horizontal, CAST((o_orderkey * 53) % 100 AS DOUBLE) AS x1, CAST((o_orderkey * 29) % 90 AS DOUBLE) AS y1, CAST((o_orderkey * 53) % 100 + CASE WHEN o_orderkey % 4 < 2 THEN 30 + o_orderkey % 70 ELSE 0 END AS DOUBLE) AS x2, CAST((o_orderkey * 29) % 90 + CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 30 + o_orderkey % 70 END AS DOUBLE) AS y2, CAST(4 + o_orderkey % 13 AS DOUBLE) AS thickness",
        "true",
    ),
    "openings": (
        "orders",
        "o_custkey AS image, o_orderkey AS id, CAST((o_orderkey * 37) % 120 AS DOUBLE) AS cx, CAST((o_orderkey * 91) % 100 AS DOUBLE) AS cy, CAST(10 + (o_orderkey * 13) % 30 AS DOUBLE) AS length, CAST(4 + (o_orderkey * 7) % 12 AS DOUBLE) AS thickness, o_orderkey % 2 = 0 AS horizontal",
        "true",
    ),
    "windows": (
        "orders",
        "o_custkey AS image, o_orderkey AS id, o_orderkey % 2 = 0 AS horizontal, CAST((o_orderkey * 19) % 40 AS DOUBLE) AS pos, CAST((o_orderkey * 37) % 60 AS DOUBLE) AS low, CAST((o_orderkey * 37) % 60 + 10 + (o_orderkey * 13) % 50 AS DOUBLE) AS high, CAST(2 + (o_orderkey * 7) % 14 AS DOUBLE) AS thickness",
        "true",
    ),
    "layers": (
        "orders",
        "o_custkey AS image, o_orderkey AS id, o_custkey % 2 = 0 AS horizontal, CAST((o_custkey * 19) % 40 + o_orderkey % 3 AS DOUBLE) AS pos, CAST((o_custkey * 37) % 60 + o_orderkey % 2 * 3 AS DOUBLE) AS low, CAST((o_custkey * 37) % 60 + 45 - o_orderkey % 5 * 2 AS DOUBLE) AS high, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 3 + o_orderkey % 4 END AS DOUBLE) AS thickness",
        "true",
    ),
    "pixels": ("lineitem", "l_suppkey AS image, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t0, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS region, CASE WHEN l_tax > 0.075 THEN 255 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS truth, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) % 3 AS pred", "true"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, condition = TABLES[name]
    view = spark.read.parquet(f"{sf_dir}/{source}.parquet").where(condition)
    return view.selectExpr(*_split(columns))


def sql(name: str) -> str:
    source, columns, condition = TABLES[name]
    return f"(SELECT {columns} FROM {source} WHERE {condition})"


def _split(columns: str) -> list[str]:
    """The select list cut at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]

"""Components, chains and atomic edges of plan graphs. Loops over written tables, so that lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axial_difference
from ..scratch import stored


def components(edges: DataFrame, key: str = "image", a: str = "a", b: str = "b") -> DataFrame:
    """key, node, root: the least node of each node's component within its key, for nodes that have an edge.

    Each round a node takes the least label among its neighbours' and its label's own label, which shortens long chains.
    """
    pairs = edges.select(key, F.col(a).alias("a"), F.col(b).alias("b"))
    both = stored(pairs.union(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(key, F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(key, F.col("node").alias("b"), "root"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = labels.join(near, [key, "node"]).select(key, "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(key, F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = stored(closer.join(up, [key, "root"], "left").select(key, "node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        labels = nxt.drop("was")
        if nxt.where("was <> root").isEmpty():
            return labels


def collinear_chains(segments: DataFrame, turn: float = 5.0) -> DataFrame:
    """image, id, chain, chain_length: segments joined through nodes of degree two that turn by at most `turn` degrees.

    Columns: image, id, a and b (nodes), angle, length. A chain is named by its least segment.
    """
    ends = segments.select("image", "id", "angle", F.explode(F.array("a", "b")).alias("node"))
    w = Window.partitionBy("image", "node")
    pairs = ends.withColumn("degree", F.count("*").over(w)).where("degree = 2").groupBy("image", "node").agg(F.min(F.struct("id", "angle")).alias("u"), F.max(F.struct("id", "angle")).alias("v"))
    links = pairs.where((F.col("u.id") != F.col("v.id")) & (axial_difference(F.col("u.angle"), F.col("v.angle")) <= turn))
    root = components(links.select("image", F.col("u.id").alias("a"), F.col("v.id").alias("b")))
    named = segments.join(root.select("image", F.col("node").alias("id"), "root"), ["image", "id"], "left").withColumn("chain", F.coalesce("root", "id"))
    total = named.groupBy("image", "chain").agg(F.sum("length").alias("chain_length"))
    return named.join(total, ["image", "chain"]).select("image", "id", "chain", "chain_length")


def dangling_paths(edges: DataFrame) -> DataFrame:
    """image, tip, stop, n_edges: from each node of degree one the path to the first node whose degree is not two.

    Directed steps through nodes of degree two are joined with themselves, so a step's length doubles each round: rounds grow with the
    logarithm of the longest path. A ring without an end has no tip and is left out.
    """
    both = stored(edges.select("image", "a", "b").where("a <> b").union(edges.where("a <> b").select("image", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    degree = stored(both.groupBy("image", "a").agg(F.count("*").alias("degree")), "degrees")
    inner = degree.where("degree = 2").select("image", F.col("a").alias("b"), F.lit(True).alias("through"))
    # a step a -> b goes on at b if b has degree two; its state is the last directed edge (p, b) that it has taken
    steps = stored(both.join(inner, ["image", "b"], "left").select("image", F.col("a").alias("p0"), F.col("b").alias("q0"), F.col("a").alias("p"), F.col("b").alias("q"), F.lit(1).cast("long").alias("n"), F.coalesce("through", F.lit(False)).alias("open")), "steps")
    follow = both.select("image", F.col("a").alias("q"), F.col("b").alias("r"))
    steps = stored(  # each open edge and the one after it
        steps.where("open").join(follow, ["image", "q"]).where("r <> p").join(inner.select("image", F.col("b").alias("r"), "through"), ["image", "r"], "left")
        .select("image", "p0", "q0", F.col("q").alias("p"), F.col("r").alias("q"), F.lit(2).cast("long").alias("n"), F.coalesce("through", F.lit(False)).alias("open"))
        .union(steps.where("not open").select("image", "p0", "q0", "p", "q", "n", "open")), "steps",
    )
    size = -1
    while True:
        left = steps.where("open").count()
        if left in (0, size):  # what stays open is a ring
            break
        size = left
        jump = steps.select("image", F.col("p0").alias("p"), F.col("q0").alias("q"), F.col("p").alias("np"), F.col("q").alias("nq"), F.col("n").alias("m"), F.col("open").alias("still"))
        longer = steps.where("open").join(jump, ["image", "p", "q"]).select("image", "p0", "q0", F.col("np").alias("p"), F.col("nq").alias("q"), (F.col("n") + F.col("m") - 1).alias("n"), F.col("still").alias("open"))
        steps = stored(longer.union(steps.where("not open")), "steps")
    tips = degree.where("degree = 1").select("image", F.col("a").alias("p0"))
    return steps.where("not open").join(tips, ["image", "p0"]).select("image", F.col("p0").alias("tip"), F.col("q").alias("stop"), F.col("n").alias("n_edges"))


def atomic_edges(sides: DataFrame, least: float = 1.0) -> DataFrame:
    """Axis-parallel sides split at all cuts of their line into atomic edges, with their owners.

    Columns: image, horizontal, pos, low, high, owner. Cuts are the ends of all sides on the same line (equal `pos`); a cut's next
    one by `lead` bounds an edge, and a range join with the sides finds the owners. Edges shorter than `least` go.
    """
    line = ["image", "horizontal", "pos"]
    cuts = sides.select(*line, F.explode(F.array("low", "high")).alias("low")).distinct()
    edges = cuts.withColumn("high", F.lead("low").over(Window.partitionBy(*line).orderBy("low"))).where(F.col("high") - F.col("low") >= least)
    s = sides.select(*line, F.col("low").alias("s_low"), F.col("high").alias("s_high"), "owner")
    held = edges.join(s, line).where("s_low <= low and high <= s_high").groupBy(*line, "low", "high").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    return held

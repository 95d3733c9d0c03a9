"""Readers and writers of plan data on Spark's own file sources."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The classes that SVG shapes are read as, most important first.
SHAPE_CLASSES = ("Window", "Door", "Wall")


def split_list(spark: SparkSession, path: str, split: str) -> DataFrame:
    """split, ordinal, sample: one path a line, without blanks and slashes around it; blank lines go."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "line"))
    sample = F.trim(F.trim(F.col("line")), F.lit("/"))
    return lines.select(F.lit(split).alias("split"), "ordinal", sample.alias("sample")).where("sample <> ''")


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row for each JSON file, strict: a broken file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json_once(df: DataFrame, path: str) -> None:
    """Committed as a whole by Spark's protocol; a path that exists is an error."""
    df.write.mode("errorifexists").json(path)


def append_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """Doubles are written with `decimals` places; each part has the header."""
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("append").option("header", True).csv(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, content of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def svg_size(content: Column) -> Column:
    """(width, height) struct of an SVG text: its attributes, else the viewBox; null unless both are positive."""
    box = F.split(F.regexp_extract(content, r'<svg[^>]*viewBox="([^"]*)"', 1), r"[\s,]+")
    side = lambda name, k: F.coalesce(F.regexp_extract(content, rf'<svg[^>]*\s{name}="([0-9.]+)', 1).try_cast("double"), F.get(box, F.lit(k)).try_cast("double"))
    w, h = side("width", 2), side("height", 3)
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


_HIDDEN = {"display": "none", "visibility": "hidden"}


def _drawn(attributes: dict[str, str]) -> bool:
    """Whether neither the attributes nor the declarations of `style` hide an element."""
    style = attributes.get("style", "").replace(" ", "")
    return not any(attributes.get(k) == v or f"{k}:{v}" in style for k, v in _HIDDEN.items())


def _outline(tag: str, attributes: dict[str, str]) -> list[tuple[float, float]]:
    """Corners of a polygon or rectangle, none for other elements."""
    if tag == "polygon":
        numbers = iter(map(float, attributes.get("points", "").replace(",", " ").split()))
        return list(zip(numbers, numbers, strict=False))
    if tag != "rect":
        return []
    left, top, wide, high = (float(attributes.get(k, 0)) for k in ("x", "y", "width", "height"))
    return [(left + wide * i, top + high * j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]


def flatten_svg(content: str) -> list[tuple[str, list[tuple[float, float]]]]:
    """(class, points) of the polygons and rectangles of an SVG; class tokens are inherited, hidden subtrees dropped.

    A pull parser in one pass: a stack holds, for each open element, the class of shapes in it, or None below a hidden one.
    """
    parser, out = ET.XMLPullParser(("start", "end")), []
    parser.feed(content)
    parser.close()
    open_elements: list[frozenset[str] | None] = [frozenset()]
    for event, element in parser.read_events():
        if event == "end":
            open_elements.pop()
            continue
        above = open_elements[-1]
        below = None if above is None or not _drawn(element.attrib) else above.union(element.get("class", "").split())
        open_elements.append(below)
        names = [c for c in SHAPE_CLASSES if below and c in below]
        corners = _outline(element.tag.rpartition("}")[2], element.attrib) if names else []
        if len(corners) > 2:
            out.append((names[0], corners))
    return out


#: Class tokens of subtrees that an input image leaves out.
DROPPED_CLASSES = frozenset(
    (
        "FixedFurniture", "FixedFurnitureSet", "Faucet", "Hanger", "Railing", "InnerDrain", "OuterDrain", "OuterCircle", "Dimension", "DimensionMark", "Direction", "TextLabel", "Name",
        "SpaceDimensionsLabel", "electricitySign",
    )
)


def pruned_svg(content: str) -> str:
    """The SVG without the subtrees of which a class token is among DROPPED_CLASSES; the root stays."""
    root = ET.fromstring(content)
    doomed = [(parent, child) for parent in root.iter() for child in parent if not DROPPED_CLASSES.isdisjoint(child.get("class", "").split())]
    for parent, child in doomed:
        parent.remove(child)
    return ET.tostring(root, encoding="unicode")


def pruned(content: Column) -> Column:
    """pruned_svg() of a column in Arrow batches; null for a null or what is no XML."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for text in values:
            try:
                out.append(None if text is None else pruned_svg(text))
            except ET.ParseError:
                out.append(None)
        return pd.Series(out, index=values.index, dtype=object)

    return run(content)


def svg_shapes(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, cls, points (array of (x, y)), error: the shapes of SVG files, or why a file can't be read."""
    schema = "path string, ordinal int, cls string, points array<struct<x: double, y: double>>, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, k, c, [{"x": x, "y": y} for x, y in pts], None) for k, (c, pts) in enumerate(flatten_svg(bytes(content).decode()))]
                except (ET.ParseError, ValueError) as e:
                    rows.append((p, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "cls", "points", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def bundle_entries(spark: SparkSession, path: str, most_entries: int = 115, most_bytes: int = 100 << 20) -> DataFrame:
    """bundle, name, size, sha256 of the entries of ZIP files; error says why a bundle is refused."""
    schema = "bundle string, name string, size long, content binary, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[tuple] = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, n, len(c), c, None) for n, c in read_bundle(bytes(content), most_entries, most_bytes).items()]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((p, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["bundle", "name", "size", "content", "error"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return found.select("bundle", "name", "size", F.sha2("content", 256).alias("sha256"), "error")


def read_bundle(content: bytes, most_entries: int, most_bytes: int) -> dict[str, bytes]:
    """Entries by name; too many or too large ones, unsafe or repeated names raise ValueError."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if len(infos) > most_entries:
            raise ValueError("too many entries")
        if len(set(names)) != len(names):
            raise ValueError("repeated entry")
        if any(n.startswith("/") or ".." in n.split("/") or "\\" in n for n in names):
            raise ValueError("unsafe name")
        if any(i.file_size > most_bytes for i in infos) or sum(i.file_size for i in infos) > 3 * most_bytes:
            raise ValueError("too large")
        return {n: z.read(n) for n in names}


def inventory_differences(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """bundle, name, problem for entries that are missing, unexpected or changed. expected: bundle, name, sha256."""
    e = expected.select("bundle", "name", F.col("sha256").alias("want"))
    both = entries.select("bundle", "name", "sha256").join(e, ["bundle", "name"], "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("sha256") != F.col("want"), "changed")
    return both.select("bundle", "name", problem.alias("problem")).where("problem is not null")

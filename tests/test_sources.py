import json
import zipfile

import pytest
from pyspark.sql import functions as F

from atelier import sources, streaming

SVG = """<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 20 10"><g class="Wall Outer"><polygon points="0,0 4,0 4,1"/><rect class="Door" x="1" y="2" width="3" height="1"/></g>
<g style="display: none" class="Wall"><rect width="1" height="1"/></g><g class="Furniture"><rect width="1" height="1"/></g></svg>"""


def test_split_list(spark, tmp_path):
    (tmp_path / "train.txt").write_text("/a/1/\n\n  b/2 \n")
    assert [(r["ordinal"], r["sample"]) for r in sources.split_list(spark, str(tmp_path / "train.txt"), "train").collect()] == [(0, "a/1"), (2, "b/2")]


def test_svg(spark, tmp_path):
    (tmp_path / "a.svg").write_text(SVG)
    (tmp_path / "b.svg").write_text("<svg")
    rows = sources.svg_shapes(spark, str(tmp_path / "*.svg")).collect()
    assert [(r["cls"], len(r["points"])) for r in rows if r["error"] is None] == [("Wall", 3), ("Door", 4)]
    assert [r["path"][-5:] for r in rows if r["error"]] == ["b.svg"]
    size = spark.createDataFrame([(SVG,), ('<svg width="3" height="-1">',)], "s string").select(sources.svg_size(F.col("s")).alias("z")).collect()
    assert tuple(size[0]["z"]) == (20.0, 10.0) and size[1]["z"] is None


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b/c.txt", "x")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    rows = sources.bundle_entries(spark, str(tmp_path / "*.zip"))
    assert sorted(r["name"] for r in rows.where("error is null").collect()) == ["a.json", "b/c.txt"]
    assert [r["error"] for r in rows.where("error is not null").collect()] == ["unsafe name"]
    good = rows.where("error is null").select("bundle", "name", "sha256")
    want = good.where("name = 'a.json'").union(good.where("name = 'b/c.txt'").select("bundle", F.lit("missing.txt"), "sha256"))
    assert sorted((r["name"], r["problem"]) for r in sources.inventory_differences(good, want).collect()) == [("b/c.txt", "unexpected"), ("missing.txt", "missing")]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"version": 1, "meta": {"width": 5}}, indent=1))
    assert sources.json_documents(spark, str(tmp_path / "d.json"), "version int, meta struct<width: int>").first()["meta"]["width"] == 5
    df = spark.createDataFrame([(1, 0.5)], "id long, iou double")
    sources.write_json_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        sources.write_json_once(df, str(tmp_path / "out"))
    for _ in range(2):
        sources.append_csv(df, str(tmp_path / "csv"))
    assert [r["iou"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["0.500000"] * 2


def test_review_stream_equals_the_batch(spark, tmp_path):
    steps = [(1, 5, 1, "door"), (1, 5, 2, "undo"), (1, 6, 1, "open"), (2, 5, 3, "ignore"), (2, 5, 1, "door")]
    schema = "image long, id long, step long, choice string"
    df = spark.createDataFrame(steps, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {(r["image"], r["id"]): (r["choice"], r["steps"]) for r in streaming.review_state(df).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.review_stream(stream).writeStream.outputMode("update").format("memory").queryName("reviews").start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("reviews").collect():
        k = (r["image"], r["id"])
        if k not in last or r["steps"] > last[k][1]:
            last[k] = (r["choice"], r["steps"])
    assert last == want == {(1, 5): (None, 2), (1, 6): ("open", 1), (2, 5): ("ignore", 2)}


def test_stages_stop_at_the_gate(spark):
    def gate(name, df):
        if name == "two":
            raise ValueError("blocked")

    df = spark.range(3).toDF("id")
    out, counts = streaming.run_stages(df, [("one", lambda d: d.where("id > 0"))], gate)
    assert counts == [("one", 2)] and out.count() == 2
    with pytest.raises(ValueError, match="blocked"):
        streaming.run_stages(df, [("one", lambda d: d), ("two", lambda d: d)], gate)

import random

import pytest

import corpus_pipeline
from test_decontaminate import brute as hit_by
from test_jaccard_join import brute as classes_of
from test_pii import brute as base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    lex = {"en": [f"the{c}{d}th" for c in "abcdefg" for d in "xyz"], "de": [f"sch{c}{d}ung" for c in "abcdefg" for d in "xyz"]}
    items = [(i, " ".join(rng.choices(lex["en"], k=25))) for i in range(4)]
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        w = rng.choices(lex[lang], k=rng.randint(30, 90))
        if i % 9 == 0:
            w[5:5] = items[i % 4][1].split()
        if i % 7 == 0:
            w[3:3] = [f"joe{i}@mail.example.com", "10.0.0.1"]
        rows.append((i, " ".join(w), lang, f"s{i % 3}", 0))
    rows += [(200, rows[3][1], "de", "s", 0), (201, rows[4][1] + " extra", "en", "s", 0), (202, None, "en", "s", 0), (203, "123 !!", None, None, None), (None, rows[6][1], "en", None, 0), rows[10]]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    read = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    one = corpus_pipeline.stored(steps["language ID"](spark, docs, path), "t")
    assert one.columns == docs.columns
    assert read(one) == sorted(((r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)

    two = corpus_pipeline.stored(steps["n-gram Jaccard join"](spark, one, path), "t")
    texts = sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    _, roots = classes_of([t for _, t in texts])
    assert read(two) == sorted((texts[k] for k in set(roots)), key=str)

    three = corpus_pipeline.stored(steps["benchmark decontamination"](spark, two, path), "t")
    assert read(three) == [(i, t) for i, t in read(two) if not hit_by(t, items)[3]]

    four = steps["PII"](spark, three, path).collect()
    assert len(four) == three.count()
    was = dict(read(three))
    for r in four:
        assert not base_spans(r["text"]) and (r["text"] == was[r["doc_id"]]) == (not base_spans(was[r["doc_id"]]))
        assert "@" not in r["text"]

    pieces = corpus_pipeline.run(spark, path).collect()
    whole = {}
    for p in pieces:
        whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
        assert whole[p["doc_id"]] <= p["doc_tokens"]
    assert sorted(whole) == sorted(was)


def test_clashing_columns_pass(spark, folder):
    path, rows, _ = folder
    extra = [(*r, 1, "x", 2.0, None) for r in rows[:12]]
    docs = spark.createDataFrame(extra, SCHEMA + ", _id int, _pii string, _language double, `found.x` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path), "t")
        assert docs.columns[5:] == ["_id", "_pii", "_language", "found.x"] and docs.count() > 0, name
        assert {r["_pii"] for r in docs.collect()} == {"x"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0


def test_empty(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

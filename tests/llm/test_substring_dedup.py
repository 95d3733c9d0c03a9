import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from atelier.llm import substring_dedup as sd
from atelier.llm.common import Hashes, grams


def brute(texts):
    """Documents that share a run of 18 words, or a whole shorter text, with another one."""
    seen = {}
    for i, t in texts:
        w = sd.placed_words(t or "")[0]
        if sd.K <= len(w) < sd.SIZE:
            seen.setdefault(tuple(w), set()).add(i)
        for p in range(len(w) - sd.SIZE + 1):
            seen.setdefault(tuple(w[p : p + sd.SIZE]), set()).add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def cases():
    rng = random.Random(4)
    vocab = [f"é{i}" for i in range(900)]
    new = lambda n: rng.choices(vocab, k=n)
    passages = [new(n) for n in (50, 55, 60, 120)]
    texts, planted = [], set()
    for i in range(80):
        w = new(rng.randint(60, 200))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passages[i // 3 % 4]
            planted.add(i)
        texts.append((i, rng.choice([" ", "\n", ", "]).join(w)))
    near = new(60)
    edited = [*near[:58], "zz", near[59]]
    texts += [(90, " ".join([*new(40), *near, *new(40)])), (91, " ".join([*new(30), *edited, *new(30)]))]
    texts += [(100, None), (101, ""), (102, "short text"), (103, "same " * 3000), (104, " ".join(new(40))), (105, texts[1][1][:300]), (106, " ".join(passages[0]))]
    return texts, planted | {90, 91, 106}


def test_planted_passages(spark):
    texts, planted = cases()
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, class_id string")
    rows = sd.repeated_passages(docs).collect()
    found = {r["doc_id"] for r in rows}
    assert planted <= found <= brute(texts) | {90, 91}
    by = dict(texts)
    assert all(len(sd.placed_words(by[r["doc_id"]][r["start"] : r["end"]])[0]) >= min(sd.SIZE, len(sd.placed_words(by[r["doc_id"]])[0])) for r in rows)
    kept = {}
    for r in rows:
        kept.setdefault(r["class_id"], []).append(r)
    for own in kept.values():
        assert {r["doc_id"] for r in own if r["kept"]} == {min(r["doc_id"] for r in own)} and len({r["doc_id"] for r in own}) > 1


def test_near_lines_share_a_class(spark):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(80)]
    near = [x if i not in (20, 60) else "other" for i, x in enumerate(w)]  # J = 66 / 86 is too low, one edit is enough
    one = [x if i != 41 else "other" for i, x in enumerate(w)]
    lines = [" ".join(w), " ".join(one), " ".join(near), " ".join(rng.sample(w, 80))]
    docs = spark.createDataFrame([(i, f"title {i}\n{t}\nend") for i, t in enumerate(lines)], "doc_id long, text string")
    rows = [r for r in sd.repeated_passages(docs).collect() if r["end"] - r["start"] > 200]
    assert {(r["doc_id"], r["kept"]) for r in rows} == {(0, True), (1, False)} and len({r["class_id"] for r in rows}) == 1
    assert {r["id"] for r in sd.removals(sd.repeated_passages(docs)).collect()} >= {1}


def test_null_ids_repeated_rows_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, t), (1, t), (2, "a b")], "doc_id long, text string")
    assert sd.repeated_passages(docs).count() == 0
    docs = spark.createDataFrame([(1, t), (None, t)], "doc_id long, text string")
    assert {r["doc_id"] for r in sd.repeated_passages(docs).collect()} == {1, None}
    assert sd.repeated_passages(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 60), st.integers(0, 60))
def test_fifty_shared_words_share_a_paragraph(seed, left, right):
    rng = np.random.default_rng(seed)
    new = lambda n: [b"%d" % x for x in rng.integers(0, 50, n)]
    passage = new(sd.WINDOW + sd.SIZE - 1)
    a, b = new(left) + passage + new(right), new(right) + passage + new(left)
    keys = [set(map(tuple, sd.anchored(grams(Hashes().of(t), sd.K), len(t))[1].tolist())) for t in (a, b)]
    assert keys[0] & keys[1]


def test_whole_passages_are_cut(spark):
    rng = random.Random(8)
    fresh = iter(range(10**6))
    new = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    texts, wanted = [], {}
    for i, n in enumerate([50, 51, 60, 75, 100, 200] * 2):
        passage = new(n)
        for j in range(2):
            before = new(rng.randint(0, 70))
            texts.append((10 * i + j, rng.choice([" ", "\n", " ,\t"]).join([*before, *passage, *new(rng.randint(0, 70))])))
        wanted[10 * i + 1] = passage
    a, b = new(30), new(70)  # the first document shares b alone, so what the third loses of a + b is held against the second
    texts += [(500, " ".join([*new(9), *b])), (501, " ".join([*new(40), *a, *b])), (502, "\n".join([*a, *b, *new(9)]))]
    wanted |= {501: b, 502: [*a, *b]}
    texts += [(600, "so it goes " * 20), (601, " ".join([*new(20), *("so it goes " * 300).split(), *new(20)]))]  # 60 words of a period of 3
    wanted[601] = ("so it goes " * 300).split()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    lost = {}
    for r in sd.removals(sd.repeated_passages(docs)).collect():
        lost.setdefault(r["id"], []).append((r["start"], r["end"]))
    by = dict(texts)
    got = {i: [w.decode() for x, y in sorted(spans) for w in sd.placed_words(by[i][x:y])[0]] for i, spans in lost.items()}
    assert got == wanted


def test_blocks_of_a_common_seed(spark, monkeypatch):
    texts = [(i, " ".join([*(f"a{i}x{j}" for j in range(20)), *(f"p{j}" for j in range(60)), *(f"b{i}x{j}" for j in range(20))])) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {tuple(r) for r in sd.repeated_passages(docs).collect()}
    monkeypatch.setattr(sd, "SEED_BLOCK", 7)
    assert {tuple(r) for r in sd.repeated_passages(docs).collect()} == whole
    by = dict(texts)
    assert {tuple(w.decode() for w in sd.placed_words(by[r["id"]][r["start"] : r["end"]])[0]) for r in sd.removals(sd.repeated_passages(docs)).collect()} == {tuple(f"p{j}" for j in range(60))}


def test_bands_miss_no_more_than_the_document_join():
    assert (1 - sd.THRESHOLD**sd.ROWS) ** sd.BANDS <= 2.5e-4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=30))
def test_natural_paragraphs(sizes):
    """All words but runs of fewer than LINE words in short lines, each once; no paragraph begins or ends within a line."""
    n = sum(sizes)
    got = sd.units(sizes, n)
    words = [w for a, b in got for w in range(a, b)]
    assert len(words) == len(set(words)) and all(b - a >= min(sd.LINE, n) for a, b in got)
    ends = {0, *np.cumsum(sizes).tolist()}
    assert all(a in ends and b in ends for a, b in got)
    left, run = set(range(n)) - set(words), []
    for w in range(n + 1):
        if w in left:
            run.append(w)
        else:
            assert len(run) < sd.LINE
            run = []


def test_short_lines(spark):
    """Near copies of a list of lines of 3 to 8 words, copies of a short text, and of a heading with the line after it."""
    rng = random.Random(5)
    fresh = iter(range(10**6))
    new = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    lines = [new(rng.randint(3, 8)) for _ in range(12)]
    edited = [list(x) for x in lines]
    edited[1][1] = "other"
    text = lambda own: "\n".join(" ".join(x) for x in own)
    short = " ".join(new(12))
    head = [new(6), new(70)]
    docs = [(1, text([new(50), *lines, new(30)])), (2, text([new(40), *edited, new(25)])), (3, short), (4, short.upper()), (5, text([new(30), *head])), (6, text([new(45), *head, new(3)])), (7, text([new(4), new(3)]))]
    rows = sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6}
    assert (4, 0, len(short), False) in {(r["doc_id"], r["start"], r["end"], r["kept"]) for r in rows}


def test_bands_find_what_they_are_tuned_for():
    """Of pairs of paragraphs at a similarity of about 0.8 nearly all collide in a band; of pairs at 0.3 few do."""
    rng = np.random.default_rng(2)
    found = {0.8: 0, 0.3: 0}
    for level in found:
        for _ in range(400):
            n = 60
            shared = round(2 * n * level / (1 + level))
            common = rng.integers(0, 2**63, shared).astype(np.uint64)
            pair = [np.concatenate([common, rng.integers(0, 2**63, n - shared).astype(np.uint64)]) for _ in range(2)]
            a, b = (sd._bands(x * np.uint64(2) + np.uint64(1), np.array([0]), np.array([n]))[0] for x in pair)
            found[level] += bool((a == b).any())
    assert found[0.8] >= 396 and found[0.3] <= 160


def test_texts_are_not_shuffled(spark):
    """No join brings texts and what is asked of them together; texts that a plain scan doesn't give are stored and give the same rows."""
    passage = " ".join(f"p{j}" for j in range(60))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(9)] + [(20, None)], "doc_id long, text string")
    rows = sd.repeated_passages(docs)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sd._fixed(docs.where("doc_id > 3").select("text")).inputFiles() == [] and sd._fixed(docs.repartition(3)).inputFiles()
    want = {tuple(r) for r in rows.collect()}
    assert {r[0] for r in want} == set(range(9))
    assert {tuple(r) for r in sd.repeated_passages(docs.repartition(3)).collect()} == want

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from atelier.llm import jaccard_join
from atelier.llm.common import components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(texts))]


def cases():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    texts = [None, "", "...", "one two", "One, two", "one two three", "x " * 30000]
    for g in range(12):
        base = rng.choices(vocab, k=rng.randint(40, 300))
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w) if rng.random() < 0.7 else " ".join(base).upper())
    texts += [" ".join(rng.choices(vocab, k=60)) for _ in range(40)]
    return texts + texts[5:12]


@pytest.mark.parametrize("block", (1024, 7))
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "VERIFY_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 4 * block)
    if block == 7:
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 6000)
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    texts = cases()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    links, classes = brute(texts)
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == classes
    assert [got[i]["n_links"] for i in range(len(texts))] == links


def test_incidence_product_equals_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    assert jaccard_join._intersections(sets, i, j).tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]


def test_blocks_give_every_pair_once():
    for m, split in ((2, 0), (9, 0), (9, 4), (2, 1)):
        got = [(int(a), int(b)) for i, j in jaccard_join._pairs(m, split, 5) for a, b in zip(i, j, strict=True)]
        assert sorted(got) == [(a, b) for a in range(m) for b in range(a + 1, m) if not split or a < split <= b]


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, long), (4, long), (4, long), (4, "other words here"), (9, long + " more")], "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r["n_links"], r["doc_id"] or 0) for r in got) == [(0, 4), (3, 0), (3, 4), (3, 4), (3, 9)]
    assert {r["class_id"] for r in got if r["n_links"]} == {4} and len({r["keeper"] for r in got}) == 2
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6100)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = v
                    todo += near[x]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] != {k}}


def test_long_chain_of_links_settles(spark):
    """A path of 5,000 links, whose ends meet after more rounds than were once allowed for."""
    order = list(range(5001))
    random.Random(3).shuffle(order)
    got = components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")).collect()
    assert len(got) == 5001 and {r["root"] for r in got} == {0}

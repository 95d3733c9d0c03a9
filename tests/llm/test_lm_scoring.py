import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from atelier.llm import lm_scoring as lm
from pyspark.sql import functions as F


def texts():
    rng = random.Random(8)
    chain = {w: rng.sample("abcdefghijklmnopqrstuvwxyz", 2) for w in "abcdefghijklmnopqrstuvwxyz"}
    out = [None, "", " \t\n", "A b\x0bC\x1cd É é", "a b"]
    for i in range(400):
        w, own = rng.choice("abcdefghij"), []
        for _ in range(rng.randint(5, 80)):
            w = rng.choice(chain[w])
            own.append(w if rng.random() < 0.95 else f"rare{rng.randrange(500)}")
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts())], "doc_id long, text string, score string")
    model = lm.train(docs.where("doc_id % 5 <> 1"))
    return docs, model, {r["doc_id"]: r for r in lm.score(docs, model).collect()}


def test_base_against_brute_force(scored):
    rows = [re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for t in texts()]
    c = Counter(w for i, r in enumerate(rows) if i % 5 != 1 for w in r)
    n, v = sum(c.values()), len(c)
    for i, r in enumerate(rows):
        got = scored[2][i]
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(r), sum(c[w] > 0 for w in r), n)
        assert got["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in r), rel=1e-9)


def test_hot_and_joined_counts_agree(spark, scored, monkeypatch):
    docs, model, got = scored
    few = model | {"hot": {w: model["hot"][w] for w in model["frequent"]}}
    for r in lm.score(docs, few).collect():
        assert r["base_score"] == pytest.approx(got[r["doc_id"]]["base_score"], rel=1e-9)
        assert r["score"] == pytest.approx(got[r["doc_id"]]["score"], rel=1e-6)


def test_probabilities_sum_to_one(scored):
    _, model, _ = scored
    scorer = lm.Scorer(model)
    pairs = np.array([0, 5, lm.CLASSES * 3 + 2, lm.CLASSES * lm.CLASSES - 1])
    scorer.normalise(pairs)
    p = model["params"]
    h = p["Q"][pairs % lm.CLASSES] * p["C"][0] + p["Q"][pairs // lm.CLASSES] * p["C"][1]
    assert np.exp(h @ p["R"].T + p["b"] - scorer.table[pairs][:, None]).sum(1) == pytest.approx(np.ones(4), rel=1e-4)
    for k, (n, v) in model["rare"].items():
        own = [c for w, c in model["hot"].items() if w not in model["frequent"] and lm.rare_class(w) == k]
        assert len(own) == v
        assert sum((c + 0.5) / (n + 0.5 * (v + 1)) for c in own) + 0.5 / (n + 0.5 * (v + 1)) == pytest.approx(1)


def test_held_out_texts_beat_the_unigrams(scored):
    held = [r for i, r in scored[2].items() if i % 5 == 1 and i > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.02 * abs(sum(r["base_score"] for r in held))


def test_empty_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = lm.train(docs.where(F.lit(False)))
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["base_score"]) == (3, 0, 0.0) and got[None]["n_tokens"] == 1
    assert lm.score(docs.limit(0), model).count() == 0


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    unigram = rng.random(lm.CLASSES) + 0.1
    unigram /= unigram.sum()
    p = {k: v.astype(np.float64) for k, v in lm.start(unigram).items()}
    h2, h1, w, noise = (rng.integers(0, 7, 50) for _ in range(4))
    offset = np.log(lm.NOISE * unigram)

    def objective():
        h = p["Q"][h1] * p["C"][0] + p["Q"][h2] * p["C"][1]
        s = (h @ p["R"].T + p["b"]) - offset
        return -np.log1p(np.exp(-s[np.arange(len(w)), w])).sum() - np.log1p(np.exp(s[:, noise])).sum()

    grad = lm.nce_gradient(p, h2, h1, w, noise, offset)
    for k, at in [("R", (3, 2)), ("b", (5,)), ("Q", (1, 4)), ("C", (0, 3)), ("C", (1, 1))]:
        was, step = p[k][at], 1e-5
        p[k][at] = was + step
        up = objective()
        p[k][at] = was - step
        down = objective()
        p[k][at] = was
        assert grad[k][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-4)


def test_ties_at_the_caches_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g " * 2000), (2, "a b c d e f g")], "doc_id long, text string")
    whole = lm.train(docs)
    monkeypatch.setattr(lm, "HOT", 3)
    few = lm.train(docs)
    assert few["frequent"] == whole["frequent"] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    one, other = ({(r["doc_id"], r["n_tokens"]): r for r in lm.score(docs, m).collect()} for m in (whole, few))
    for k, r in one.items():
        assert other[k]["base_score"] == pytest.approx(r["base_score"]) and other[k]["n_known"] == r["n_known"] == r["n_tokens"]

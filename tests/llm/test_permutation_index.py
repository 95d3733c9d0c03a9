import numpy as np

from atelier.llm import permutation_index as pi


def brute(rows, k=20):
    own = {i: np.array(v) for i, v in rows}
    ids = np.array(sorted(own))
    x = np.array([own[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0].tolist():
        s = x @ own[i]
        order = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, want = got(pi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=3000)), brute(rows)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    print(f"recall {hits / (20 * len(want)):.3f}")
    assert hits / (20 * len(want)) >= 0.95
    for q, near in found.items():
        assert np.allclose([s for _, s in near], [x[q] @ x[i] for i, _ in near], rtol=1e-12)
        assert near == sorted(near, key=lambda t: (-t[1], t[0]))


def test_small_tables_ties_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(50)] + [(i, [1.0] * 8) for i in range(100, 140)]
    odd = [(200, None), (201, [0.0] * 8), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, [1.0] * 8), (220, [1.0] * 3), (240, []), (100, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, score int")
    found, want = got(pi.search(df)), brute(rows)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in got(pi.search(df))[0]] == [1, 2]
    assert pi.search(df.limit(0)).count() == 0
    assert pi.search(df.where("vec_id = 1")).count() == 0


def test_files_against_brute_force():
    """Lesser weights over shared pivots, pair by pair; a query reads the files of its own pivots only."""
    rng = np.random.default_rng(7)
    x, pivots = rng.normal(size=(300, 16)), rng.normal(size=(200, 16))
    block = pi.Block(rng.permutation(300), x, pivots)
    orders = pi.permutations(block.x, pivots)
    n = pi.NEAREST
    weight = [{p: n - k for k, p in enumerate(o)} for o in orders.tolist()]
    for i in range(0, 300, 37):
        want = [sum(min(w, weight[i][p]) for p, w in other.items() if p in weight[i]) for other in weight]
        assert block.footrule(orders[i]).tolist() == want
        near = block.x[i] @ pivots.T
        assert orders[i].tolist() == sorted(range(200), key=lambda p, near=near: -near[p])[:n]
    assert len(block.rows) == 300 * n and block.begins[-1] == 300 * n

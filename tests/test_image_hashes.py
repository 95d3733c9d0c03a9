"""Hashes beyond 64 bits' products, and pairs found by parts of their bits against all pairs."""

import numpy as np
import pytest

from atelier.operators import curation
from atelier.plans.catalogue import QUERIES


def _images(keys):
    """id, sha, group, hashes p and d of four turns, in whole numbers of any size."""
    for k in keys:
        rest = [0, 33, 1025, 524256][k % 4]
        turned = lambda salt: [(((k - k % 4) * 7919 + (r + (k % 4 == 2)) % 4 * 104729 + salt) * 2654435761 % (2**62 - 1)) ^ rest for r in range(4)]  # noqa: B023, E731
        yield k, k // 20 if k % 10 < 2 else -k, k // 14 if k % 7 < 2 else None, turned(5), turned(99)


def test_keys_whose_hashes_need_more_than_64_bits(spark, tmp_path):
    """The product leaves 64 bits from about 438,000 on, the factor before it from 10 ** 15 on."""
    keys = [*range(40), *range(438_500, 438_580), *range(899_960, 900_000), *range(10**12, 10**12 + 30), *range(2**62, 2**62 + 30)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want, images = set(), list(_images(keys))
    for a, sha, group, p, d in images:
        for b, b_sha, b_group, b_p, b_d in images:
            p_bits, d_bits, turn = min(((p[0] ^ x).bit_count(), (d[0] ^ y).bit_count(), 90 * r) for r, (x, y) in enumerate(zip(b_p, b_d, strict=True)))
            exact, same = sha == b_sha, group is not None and group == b_group
            if a < b and (exact or same or (p_bits <= 12 and d_bits <= 12)):
                want.add((a, b, exact, same, d_bits, p_bits, turn))
    found = [tuple(r) for r in QUERIES["near_duplicate_hash_pairs"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == want and sum(r[0] > 438_000 and not (r[2] or r[3]) for r in want) > 50


def _hashes(n, seed, bits=64, fixed=0):
    """Groups of hashes that differ in 0 to 15 of `bits` bits from their first; the `fixed` upper bits are all ones."""
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 1 << 64, n // 8, dtype=np.uint64, endpoint=False)[rnd.integers(0, n // 8, n)]
    flips = [sum(1 << int(b) for b in rnd.choice(bits, k % 16, replace=False)) for k in range(n)]
    return (base ^ np.array(flips, np.uint64)) | np.uint64((1 << 64) - (1 << (64 - fixed)))


@pytest.mark.parametrize("most", [0, 2, 5, 12])
@pytest.mark.parametrize("m", [None, 4, 5, 6, 7])
def test_parts_lose_no_pair(monkeypatch, m, most):
    """However many parts there are, all pairs are found, each once."""
    if m:
        monkeypatch.setattr(curation, "_parts", lambda p, q, most: curation._dealt(list(range(64)), most, m))
    p, q = _hashes(700, 1), np.concatenate([_hashes(700, 1)[::-1], _hashes(300, 2, fixed=20)])
    found = [(i, j) for x, y in curation._close(p, q, most, cells=1000) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    want = np.argwhere(np.bitwise_count(p[:, None] ^ q[None]) <= most).tolist()
    assert sorted(found) == sorted(map(tuple, want)) and len(want) >= 700


def test_parts_are_chosen_where_they_save():
    """Nothing is chosen for few pairs, nor where the hashes that lie alike in any part are most."""
    rnd = np.random.default_rng(3)
    p, q = rnd.integers(0, 1 << 62, 20_000, dtype=np.uint64), rnd.integers(0, 1 << 62, 80_000, dtype=np.uint64)
    assert len(curation._parts(p, q, 12)) >= 4 and not curation._parts(p[:1000], q[:1000], 12) and not curation._parts(p >> np.uint64(50), q >> np.uint64(50), 12)
    assert not list(curation._close(p[:0], q, 12)) and not list(curation._close(p, q[:0], 12))

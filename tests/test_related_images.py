"""Related images by brute force, and hashes that share parts."""

import random
import time

from pyspark.sql import functions as F

from atelier.operators import curation

_KIND = "id long, sha long, group_id long, signatures array<struct<d: long, p: long>>"


def test_pairs_agree_with_brute_force(spark):
    rnd = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(63), n))
    rows, bases = [], [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(8)]
    for k in range(120):
        d, p = rnd.choice(bases)
        turns = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(4)]
        turns[rnd.choice([0, 0, 1, 3])] = (flip(d, rnd.randrange(8)), flip(p, rnd.randrange(9)))
        rows.append((k * 7, k % 50 if k % 3 else None, k % 40 if k % 5 == 0 else None, turns))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                p, d, turn = min(((a[3][0][1] ^ t[1]).bit_count(), (a[3][0][0] ^ t[0]).bit_count(), 90 * k) for k, t in enumerate(b[3]))
                exact, group = (x is not None and x == y for x, y in ((a[1], b[1]), (a[2], b[2])))
                if exact or group or (p <= 12 and d <= 12):
                    want.add((a[0], b[0], exact, group, d, p, turn))
    images = spark.createDataFrame(rows, _KIND)
    for block in (8192, 17):
        got = [tuple(r) for r in curation.related_images(images, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and any(not (r[2] or r[3]) for r in want)
    assert curation.related_images(images.limit(0)).count() == 0


def test_hashes_that_share_parts(spark):
    """Two of seven parts are the same in all 20,000 images: in buckets by parts all 200 million pairs would be rows, each twice."""
    h = F.concat(F.lit("x"), F.col("id").cast("string"))
    wide = F.xxhash64(h).bitwiseAND((1 << 40) - 1)  # the upper 23 bits are zero in all
    images = spark.range(20_000).select("id", (-F.col("id")).alias("sha"), F.lit(None).cast("long").alias("group_id"), F.array(*(F.struct(F.xxhash64(h, F.lit(r)).alias("d"), (wide if r == 0 else F.lit((1 << 62) - 1)).alias("p")) for r in range(4))).alias("signatures"))
    began = time.time()
    curation.related_images(images).count()
    assert time.time() - began < 60

"""Curation of training data: duplicates, leakage across splits, exclusions, sampling, reviews."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def cross_split_duplicates(samples: DataFrame, content: Column, split: str) -> DataFrame:
    """sha, n and n_splits of contents that occur in more than one split."""
    found = samples.withColumn("sha", F.sha2(content, 256)).groupBy("sha").agg(F.count("*").alias("n"), F.count_distinct(split).alias("n_splits"))
    return found.where("n_splits > 1")


def leakage_report(samples: DataFrame, key: str, split: str) -> DataFrame:
    """Counts of the checks on a registry: ids that repeat, keys that cross splits, rows without a key."""
    ids = samples.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    cross = samples.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    none = samples.agg(F.count_if(F.col(key).isNull()).alias("n"))
    named = [df.select(F.lit(name).alias("check"), F.col("n").alias("violations")) for name, df in (("duplicate_id", ids), ("key_crosses_splits", cross), ("missing_key", none))]
    return named[0].union(named[1]).union(named[2])


def _dealt(bits: list[int], most: int, m: int) -> list[tuple[list[int], int]]:
    """Bits dealt in turn to m parts, with a bound for each part, none below 0. The bounds' sum is most - m + 1: hashes beyond it in all parts differ
    in most + 1 bits at least, so those that differ in `most` at most are within it in one."""
    return [(bits[k::m], (most - k) // m) for k in range(m) if most >= k]


def _parts(p: np.ndarray, q: np.ndarray, most: int, sample: int = 512) -> list[tuple[list[int], int]]:
    """The cheapest way to compare all p with all q: none (each with each), or parts of the bits that differ anywhere. Costs, in nanoseconds, are told
    from pairs of a sample."""
    differ = int(np.bitwise_or(np.bitwise_or.reduce(p), np.bitwise_or.reduce(q)) ^ np.bitwise_and(np.bitwise_and.reduce(p), np.bitwise_and.reduce(q)))
    bits = [b for b in range(64) if differ >> b & 1]
    few = p[:: -(-len(p) // sample), None] ^ q[None, :: -(-len(q) // sample)]
    best, least = [], len(p) * len(q)
    for m in range(4, 8):
        parts, cost = _dealt(bits, most, m), 0
        for own, bound in parts:
            share = float((np.bitwise_count(few & np.uint64(sum(1 << b for b in own))) <= bound).mean())
            cost += share * len(p) * len(q) + min(len(p), 1 << len(own)) * (10_000 + 20 * sum(comb(len(own), x) for x in range(bound + 1)) + 5 * share * len(q))
        if cost < least:
            best, least = parts, cost
    return best


def _close(p: np.ndarray, q: np.ndarray, most: int, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices i, j of all p[i] and q[j] that differ in `most` bits at most, each once; hashes are compared in cuts of `cells` pairs."""

    def compare(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, cells // max(1, len(y)))
        for at in range(0, len(x), step):
            for to in range(0, len(y), cells):
                near = np.bitwise_count(x[at : at + step, None] ^ y[None, to : to + cells]) <= most
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                if len(i):
                    yield at + i, to + j

    if not len(p) or not len(q):
        return
    parts, earlier = _parts(p, q, most), []
    if not parts:
        yield from compare(p, q)
    for own, bound in parts:
        key = lambda h, own=own: sum(((h >> np.uint64(b) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(own)), np.zeros(len(h), np.uint64)).astype(np.int64)
        left, right = key(p), key(q)
        rows, cols = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        x, y, left = p[rows], q[cols], left[rows]
        sizes = np.bincount(right, minlength=1 << len(own))
        starts = np.cumsum(sizes) - sizes
        turned = np.arange(1 << len(own))
        turned = turned[np.bitwise_count(turned) <= bound]
        cuts = [0, *(np.flatnonzero(np.diff(left)) + 1).tolist(), len(left)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            with_ = left[lo] ^ turned
            n = sizes[with_]
            at = np.repeat(starts[with_] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            for i, j in compare(x[lo:hi], y[at]):
                i, j = rows[lo + i], cols[at[j]]
                new = np.ones(len(i), bool)
                for mask, within in earlier:
                    new &= np.bitwise_count((p[i] ^ q[j]) & mask) > within
                yield i[new], j[new]
        earlier.append((np.uint64(sum(1 << b for b in own)), bound))


def _hash_pairs(most: int, full: int = 1 << 18):
    """A mapInArrow function on rows g, side (0: left, 1: right), id, p (one hash on the left, all turns on the right) that lie sorted by g and side:
    pairs a < b whose hash differs in `most` bits at most from any turn, each once for about `full` that are found."""

    def told(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def hits(left: list[tuple], right: list[tuple]) -> Iterator[pa.RecordBatch]:
        (a, p), (b, of, q) = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in (left, right))
        found, n = [], 0
        for i, j in _close(p, q, most):
            i, j = a[i], b[of[j]]
            up = i < j
            found.append((i[up], j[up]))
            n += int(up.sum())
            if n >= full:
                yield told(found)
                found, n = [], 0
        if n:
            yield told(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left, right = None, [], []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if g[lo] != group:
                    if left and right:
                        yield from hits(left, right)
                    group, left, right = g[lo], [], []
                cut = batch.slice(lo, hi - lo)
                mid = int(np.count_nonzero(cut.column(1).to_numpy() == 0))
                ids, lists = cut.column(2).to_numpy(), cut.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy().view(np.uint64)
                ends = int(sizes[:mid].sum())
                if mid:
                    left.append((ids[:mid], flat[:ends]))
                if mid < hi - lo:
                    known = sum(len(x[0]) for x in right)
                    right.append((ids[mid:], known + np.repeat(np.arange(hi - lo - mid), sizes[mid:]), flat[ends:]))
        if left and right:
            yield from hits(left, right)

    return run


def related_images(images: DataFrame, most: int = 12, block: int = 1 << 16) -> DataFrame:
    """Pairs a < b of images that may show one plan: a, b, exact, same_group, d_bits, p_bits, rotation (degrees of b).

    images: id, sha, group_id, signatures: four structs (d, p: long hashes of 64 and 63 bits) of its rotations by 0, 90, 180 and 270 degrees. A pair is
    related if its content is equal, its group is the same and not null, or if in the rotation of b with the least (p_bits, d_bits) both are at most
    `most`. A task has a block of ids (long) against its own or a later one and counts bits in numpy. Where that is cheaper, only hashes that are alike
    in one of several parts of their bits are compared, which loses no pair; a part that many hashes share is cut, never collected. Found pairs are judged
    once on their hashes.
    """
    spark = images.sparkSession
    images = stored(images.select("id", "sha", "group_id", "signatures"), "images")  # hashed once, read many times
    n = max(1, -(-images.count() // block), round(spark.sparkContext.defaultParallelism ** 0.5))
    images = images.where("id IS NOT NULL")
    cuts = images.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    own = sum(((F.col("id").cast("double") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    turns = F.filter(F.transform("signatures", lambda s: s["p"]), lambda p: p.isNotNull())
    first = F.col("signatures")[0]["p"]
    rows = images.select("id", own.alias("own"), F.when(first.isNotNull(), F.array(first)).alias("first"), turns.alias("turns"))
    left = rows.where("first IS NOT NULL").select(F.explode(F.sequence("own", F.lit(n - 1))).alias("o"), "own", "id", F.col("first").alias("p")).select((F.col("own") * n + F.col("o")).alias("g"), F.lit(0).alias("side"), "id", "p")
    right = rows.where("size(turns) > 0").select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("o"), "own", "id", F.col("turns").alias("p")).select((F.col("o") * n + F.col("own")).alias("g"), F.lit(1).alias("side"), "id", "p")
    whole = left.union(right).select("g", "side", F.col("id").cast("long").alias("id"), "p").repartition(n * n, "g").sortWithinPartitions("g", "side")
    alike = whole.mapInArrow(_hash_pairs(most), "a long, b long")
    same = lambda c: images.where(F.col(c).isNotNull()).select(c, F.col("id").alias("a")).join(images.select(c, F.col("id").alias("b")), c).where("a < b").select("a", "b")
    pairs = alike.union(same("sha")).union(same("group_id")).distinct()
    own = lambda p: images.select(F.col("id").alias(p), F.col("sha").alias(f"{p}_sha"), F.col("group_id").alias(f"{p}_group"), F.col("signatures").alias(f"{p}_s"))
    told = pairs.join(own("a"), "a").join(own("b"), "b")
    bits = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    turns = F.transform("b_s", lambda s, k: F.struct(bits(F.col("a_s")[0]["p"], s["p"]).alias("p_bits"), bits(F.col("a_s")[0]["d"], s["d"]).alias("d_bits"), (k * 90).alias("rotation")))
    told = told.withColumn("m", F.array_min(turns)).withColumn("exact", F.coalesce(F.col("a_sha") == F.col("b_sha"), F.lit(False))).withColumn("same_group", F.coalesce(F.col("a_group") == F.col("b_group"), F.lit(False)))
    near = (F.col("m.p_bits") <= most) & (F.col("m.d_bits") <= most)
    return told.where(F.col("exact") | F.col("same_group") | near).select("a", "b", "exact", "same_group", "m.d_bits", "m.p_bits", "m.rotation")


def without(samples: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return samples.join(excluded.select(key).distinct(), key, "left_anti")


def round_robin(rows: DataFrame, bucket: str, id_col: str, n: int, seed: int = 0, parts: int = 64) -> DataFrame:
    """n rows taken in turn from the buckets in name order, each bucket in hash order.

    A row's place in its bucket is its round; (round, bucket) orders the picks, so only n rows a bucket can matter. Those are
    among the first n of each of `parts` parts of the bucket, so a bucket with most of the rows is ranked in parts first.
    """
    order = [F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col)), 256), F.col(id_col)]
    part = F.pmod(F.xxhash64(id_col), F.lit(parts))
    few = rows.withColumn("round", F.row_number().over(Window.partitionBy(bucket, part).orderBy(*order))).where(F.col("round") <= n)
    placed = few.withColumn("round", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("round") <= n)
    return placed.orderBy("round", bucket, id_col).limit(n)


def _vectors(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and matrix of the vectors of each length that hold no null; last -1, the ids of the others and none. Null ids are left out."""
    ids, lists = ids.filter(ids.is_valid()), lists.filter(ids.is_valid())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat, ends, ids = lists.flatten(), np.cumsum(sizes), ids.to_numpy()
    gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (gaps[ends] == gaps[ends - sizes])
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    for size in np.unique(sizes[whole]).tolist():
        rows = np.flatnonzero(whole & (sizes == size))
        yield size, ids[rows], values[(ends - sizes)[rows][:, None] + np.arange(size)]
    yield -1, ids[~whole], np.empty((0, 0))


def _dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


class _Best:
    """The k best rows so far of queries of one length. Scores of a matrix product choose with a margin for its rounding; exact ones decide."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.norms, self.bar = np.sqrt((vectors * vectors).sum(1)), np.full(len(ids), -np.inf)
        self.at, self.score, self.found = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, v: np.ndarray, cells: int = 1 << 21) -> None:
        step = max(1, cells // max(1, len(self.ids)))
        for lo in range(0, len(ids), step):
            own, w = ids[lo : lo + step], v[lo : lo + step]
            near = self.q @ w.T
            self_ = np.isin(own, self.ids)
            same = (self.ids[:, None] == own[None, self_]).nonzero()
            same = same[0], np.flatnonzero(self_)[same[1]]
            near[same] = -np.inf
            margin = 8 * (w.shape[1] + 1) * np.finfo(float).eps * self.norms * np.sqrt((w * w).sum(1)).max()
            bar = self.bar
            if np.isneginf(bar).any() and len(own) > self.k and np.isfinite(w).all() and np.isfinite(margin).all():
                bar = np.maximum(bar, np.partition(near, -self.k, axis=1)[:, -self.k])
            hit = ~(near < (bar - margin)[:, None])
            hit[same] = False
            at, to = hit.nonzero()
            for c in range(0, len(at), 200_000):
                self._take(at[c : c + 200_000], own, w, to[c : c + 200_000])

    def _take(self, at: np.ndarray, own: np.ndarray, w: np.ndarray, to: np.ndarray) -> None:
        at, score, found = np.concatenate([self.at, at]), np.concatenate([self.score, _dots(self.q[at], w[to])]), np.concatenate([self.found, own[to]])
        order = np.lexsort((found, -score, ~np.isnan(score), at))
        at, score, found = at[order], score[order], found[order]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
        last = rank == self.k - 1
        self.bar[at[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
        keep = rank < self.k
        self.at, self.score, self.found = at[keep], score[keep], found[keep]


def _nearest(queries: Broadcast, k: int):
    """A mapInArrow function on rows id, v: the k best of its rows for each query as query, id, score. Without a common length the score is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {n: (ids, _Best(ids, v, k) if n >= 0 else None) for n, ids, v in queries.value}
        unlike = {n: np.empty(0, np.int64) for n in asked}  # the least ids that a length's queries have no score with, one more as it may be the query's own
        for batch in batches:
            for n, ids, v in _vectors(batch.column(0), batch.column(1)):
                for m in asked:
                    if m == n >= 0:
                        asked[m][1].add(ids, v)
                    else:
                        unlike[m] = np.sort(np.concatenate([unlike[m], ids]))[: k + 1]
        for n, (ids, best) in asked.items():
            if best is not None and len(best.at):
                yield _told(ids[best.at], best.found, pa.array(best.score))
            for lo in range(0, len(ids) if len(unlike[n]) else 0, 10_000):
                query, other = (x.ravel() for x in np.meshgrid(ids[lo : lo + 10_000], unlike[n], indexing="ij"))
                apart = query != other
                yield _told(query[apart], other[apart], pa.nulls(int(apart.sum()), pa.float64()))

    return run


def _told(query: np.ndarray, ids: np.ndarray, score: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), score], names=["query", "id", "score"])


def nearest(queries: DataFrame, base: DataFrame, k: int = 5, block: int = 5000) -> DataFrame:
    """The k base rows with the greatest inner product for each query (ties: smaller id). Columns: id (long), v (array of double).

    Queries go against all base rows in blocks of about `block`, each broadcast, by matrix products. Each task keeps the bests
    of its rows, and only those are ranked together.
    """
    spark = base.sparkSession
    n = max(1, -(-queries.count() // block))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = base.select(F.col("id").cast("long").alias("id"), "v").repartition(tasks, "id")  # a short file would be one task
    order, out = [F.desc("score"), F.col("id")], None
    for b in range(n):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).select(F.col("id").cast("long").alias("id"), "v").toArrow().combine_chunks()
        known = [x for c in asked.to_batches() for x in _vectors(c.column(0), c.column(1)) if len(x[1])]
        few = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(known), k), "query long, id long, score double")
        out = few if out is None else out.union(few)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def apply_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items with the type that the answer for their (id, fingerprint) chose. answers: id, fingerprint, choice."""
    a = answers.select("id", "fingerprint", "choice")
    routed = items.join(a, ["id", "fingerprint"], "left").withColumn("type", F.coalesce("choice", "type"))
    return routed.withColumn("confirmed", F.col("choice").isNotNull()).drop("choice")


def stale_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that match no item exactly, or that are given twice; a request with any is rejected as a whole."""
    stale = answers.join(items.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti").select("id", "fingerprint", F.lit("stale").alias("reason"))
    twice = answers.groupBy("id", "fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("id", "fingerprint", F.lit("duplicate").alias("reason"))
    return stale.union(twice).distinct()


def append_with_fresh_ids(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """old and new, whose rows get the ids after the image's greatest in `order`. Columns: image, id, ..."""
    top = old.groupBy("image").agg(F.max("id").alias("top"))
    n = F.row_number().over(Window.partitionBy("image").orderBy(*order))
    fresh = new.withColumn("n", n).join(top, "image", "left").withColumn("id", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long")).select(*old.columns)
    return old.unionByName(fresh)


def concat_sources(sources: dict[str, DataFrame], order: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Rows of all sources with their source and ordinal, sources in the given order; a source's limit keeps its first rows."""
    out = None
    for k, (name, df) in enumerate(sources.items()):
        part = df.orderBy(order).limit(limits[name]) if limits and name in limits else df
        part = part.withColumn("source", F.lit(name)).withColumn("source_ordinal", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def set_difference(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """value and the side that has it alone; equal sets give no rows."""
    a, b = left.select(value).distinct(), right.select(value).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))

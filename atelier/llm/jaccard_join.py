"""N-gram Jaccard self-join of documents, with Bayesian pruning of candidates.

1. Each document becomes its set of hashed k-word shingles and HASHES MinHash values. Documents with equal sets form one
   class, so copies cost one representative however many there are.
2. Bands of the MinHash values put representatives into buckets. Within a bucket pairs are compared STEP values at a time; a
   pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls
   below `tolerance`. A bucket gives only links to its groups' least members: rows out stay linear in rows in.
3. Components of these links gather what must be verified. In each, all pairs pass the same pruning and the rest are
   verified exactly on the shingles: pair by pair, or as a product of incidence matrices where many pairs are left.
   Every verified link is counted for both ends (weighted by copies); links to least members go on.
4. Components of the verified links are the final classes.

A bucket or component above its block size, in rows or in bytes of sets, is cut into blocks, and each pair of blocks is a task's group, so no group is
unbounded and no pair is lost. Counting every link of m different near copies takes all their pairs: that work, and the sets sent for it (m / 1024 times each),
grows with m squared; copies of equal sets cost nothing. Buckets miss a pair at the threshold with probability (1 - t^ROWS)^BANDS = 2e-4 at 0.8.

Nulls, empty texts and texts without words have no shingles: each is a class alone. A text of fewer than k words is one
shingle; a very long one is a set like others, a group of blocks holds 64 MB of sets or one set. Every row takes part under a number
of its own, so a null doc_id or one doc_id with several texts does no harm; sets are known by 128 bits. Repeated rows are copies of each other. Ties: the
least doc_id names the class, then the least row number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hashes, components, forget, grams, local_roots, mix, partitions, stored, trim, words

K, THRESHOLD = 5, 0.8
HASHES, STEP, BANDS, ROWS = 128, 32, 16, 4
BUCKET_BLOCK, VERIFY_BLOCK, BLOCK_BYTES = 4096, 1024, 32 << 20
#: Members of candidate components (some 250 bytes each with key and signature) up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 100_000
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, hashes: Hashes, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words if there are fewer than k."""
    own = hashes.of(words(text))
    return np.unique(grams(own, min(k, len(own)))) if len(own) else np.empty(0, np.uint64)


def minhash(u: np.ndarray) -> np.ndarray:
    """HASHES least values of random linear hashes (their upper halves)."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(u), 4096):
        out = np.minimum(out, ((u[lo : lo + 4096, None] * _ODD) >> np.uint64(32)).min(0))
    return out


def signature(least: np.ndarray) -> bytes:
    """Eight bits of each MinHash value."""
    return (mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    parts = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    code = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return code.view(np.int64)


@lru_cache
def fewest(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After STEP, 2 STEP ... values: the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail = sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append(m)
    return tuple(out)


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) of rows of sig, those that outlive every step."""
    same = np.zeros(len(i), np.int64)
    for s, m in enumerate(least):
        at = slice(s * STEP, (s + 1) * STEP)
        same = same + (sig[i, at] == sig[j, at]).sum(1)
        kept = same >= m
        i, j, same = i[kept], j[kept], same[kept]
    return i, j


def _pairs(m: int, split: int = 0, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0..m-1, or those between [0, split) and [split, m), in chunks of about `most`."""
    lo, end = 0, split or m - 1
    while lo < end:
        rows = max(1, most // (m - (split or lo)))
        left = np.arange(lo, min(end, lo + rows))
        begin = np.full(len(left), split) if split else left + 1
        n = m - begin
        i = np.repeat(left, n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        lo += rows


def _grouped(keys: int, work: Callable[[list[pa.Array]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function for rows sorted by their first `keys` columns: `work` gets all columns of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([left, table]) if left is not None else table
            if not table.num_rows:
                continue
            ids = [table.column(c).to_numpy() for c in range(keys)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from work(table.slice(0, last).combine_chunks().columns)
            left = table.slice(last)
        if left is not None and left.num_rows:
            yield from work(left.combine_chunks().columns)

    return run


def _bounds(columns: list[np.ndarray]) -> np.ndarray:
    new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
    return np.concatenate([[0], new, [len(columns[0])]])


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def dealt(rows: DataFrame, key: str, member: str, block: int, size: Column | None = None) -> DataFrame:
    """Adds long columns bi, bj, block: rows of a key with more than `block` rows, or over BLOCK_BYTES by `size`, go to each pair of its blocks that they are in.

    The keys that need it are counted first; there is one for `block` rows (or so many bytes) at most. They are
    broadcast up to BROADCAST_ROWS, else joined by a shuffle.
    """
    size = F.lit(0) if size is None else size
    g = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(size) / BLOCK_BYTES))
    hot = rows.groupBy(F.col(key).alias("hot")).agg(g.alias("g")).where("g > 1")
    hot = stored(hot, "hot-keys")
    whole = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, F.col(key) == F.col("hot"), "left")
    g = F.coalesce("g", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(member), g)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda o: F.struct(F.least(o, own).alias("bi"), F.greatest(o, own).alias("bj"), own.alias("block")))
    return whole.select(*rows.columns, F.explode(pair).alias("p")).select(*rows.columns, "p.bi", "p.bj", "p.block")


def text_hash(text_col: str) -> Column:
    """With doc_id it leads back from a row's number to its text; rows that agree in both are repeated rows."""
    return F.xxhash64(F.col(text_col))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, h (text_hash), id (the row's number), key (of the shingle set), n (its size), bands, sig."""
    names = ["doc_id", "h", "id", "key", "n", "bands", "sig"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = Hashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, sizes, banded, sigs = [], [], [], []
            for text in batch.column(2):
                u = shingles(text.as_py(), hashes, k)
                least = minhash(u)
                keys.append(xxhash.xxh3_128_digest(u.tobytes()))
                sizes.append(len(u))
                banded.append(bands(least))
                sigs.append(signature(least))
            flat = pa.array(np.concatenate(banded) if banded else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arange(row, row + len(keys))), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(sigs, pa.binary())], names=names)
            row += len(keys)
        del hashes
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "doc_id long, h long, id long, key binary, n long, bands array<long>, sig binary")


def _candidate_links(least: tuple[int, ...], threshold: float):
    def work(columns: list[pa.ChunkedArray]) -> Iterator[pa.RecordBatch]:
        ids = [columns[c].to_numpy() for c in range(3)]
        reps, sizes, sig = columns[3].to_numpy(), columns[4].to_numpy(), _signatures(columns[5])
        group = np.cumsum(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], axis=0)]))
        left, right, at, d, pending, root = [], [], np.arange(len(reps)), 1, 0, np.arange(len(reps))
        while True:  # pairs d rows apart in one group; those positions only shrink
            at = at[at + d < len(reps)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            near = at[np.minimum(sizes[at], sizes[at + d]) >= threshold * np.maximum(sizes[at], sizes[at + d]) - 1e-9]
            i, j = prune(sig, near, near + d, least)
            left.append(i)
            right.append(j)
            pending += len(i)
            if pending > 1 << 20:  # links join components as they come, so that few are held
                root = local_roots(len(reps), np.concatenate([*left, np.arange(len(reps))]), np.concatenate([*right, root]))
                left, right, pending = [], [], 0
            d += 1
        root = local_roots(len(reps), np.concatenate([*left, np.arange(len(reps))]), np.concatenate([*right, root]))
        if len(reps):
            low = reps[root]
            own = np.flatnonzero(reps != low)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(low[own])], names=["a", "b"])

    return _grouped(3, work)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j; by incidence matrices where there are many pairs to a set."""
    if len(i) < 4 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    wide, total = max(256, (16 << 20) // len(sets)), np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _verified_links(least: tuple[int, ...], threshold: float):
    def work(columns: list[pa.ChunkedArray]) -> Iterator[pa.RecordBatch]:
        ids = [columns[c].to_numpy() for c in range(3)]
        reps, counts, sig, sets = columns[3].to_numpy(), columns[4].to_numpy(), _signatures(columns[5]), columns[6]
        out: list[list[np.ndarray]] = [[], [], []]
        cuts = _bounds(ids)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, first = np.unique(reps[lo:hi], return_index=True)  # repeated rows of a representative count once
            if len(own) < 2:
                continue
            at = lo + first
            split, bi, bj = 0, ids[1][lo], ids[2][lo]
            if bi != bj:  # only pairs between the two blocks
                block = columns[7].to_numpy()[at]
                order = np.argsort(block != bi, kind="stable")
                at, own, split = at[order], own[order], int((block == bi).sum())
                if split in (0, len(own)):
                    continue
            s, c = sig[at], counts[at]
            u = [np.frombuffer(sets[int(x)].as_py(), np.uint64) for x in at]
            n = np.fromiter(map(len, u), np.int64, len(u))
            links, left, right = np.zeros(len(own), np.int64), [], []
            for i, j in _pairs(len(own), split):
                kept = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
                i, j = prune(s, i[kept], j[kept], least)
                left.append(i)
                right.append(j)
            i, j = np.concatenate(left), np.concatenate(right)
            common = _intersections(u, i, j)
            kept = common >= threshold * (n[i] + n[j] - common) - 1e-9
            i, j = i[kept], j[kept]
            np.add.at(links, i, c[j])
            np.add.at(links, j, c[i])
            low = own[local_roots(len(own), i, j)]
            for x, y in zip(out, (own, links, low), strict=True):
                x.append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rep", "links", "root"])

    return _grouped(3, work)


def verified(found: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Exact links within candidate components. found: root, rep, copies, sig, set of each member.

    Returns rows (rep, links, root): in each block pair a member's links, weighted by copies, and its least linked member.
    """
    sets = stored(found, "sets")
    cut = dealt(sets, "root", "rep", VERIFY_BLOCK, F.length("set")).select("root", "bi", "bj", "rep", "copies", "sig", "set", "block")
    grouped = cut.repartition(partitions(found.sparkSession), "root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    links = stored(grouped.mapInArrow(_verified_links(fewest(threshold, tolerance), threshold), "rep long, links long, root long"), "links")
    forget(sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: float = THRESHOLD, tolerance: float = 1e-5) -> DataFrame:
    """doc_id, h (text_hash), id (row number), class_id (least doc_id of the documents joined by links), n_links and keeper.

    n_links counts the other documents whose similarity to this one reaches the threshold, copies included. keeper is the
    id of the class's row with the least doc_id (nulls last). A class of null doc_ids alone has a text's hash as its class_id.
    """
    least, spark = fewest(threshold, tolerance), docs.sparkSession
    feats = stored(features(docs, id_col, text_col, k), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "id", "h")).alias("first")
    classes = stored(feats.where("n > 0").groupBy("key", "n", "bands", "sig").agg(F.min(F.struct("id", "doc_id", "h")).alias("r"), F.count("*").alias("copies"), first).withColumn("rep", F.col("r.id")), "classes")

    in_bands = classes.select(F.explode("bands").alias("band"), "rep", "n", "sig")
    buckets = dealt(in_bands, "band", "rep", BUCKET_BLOCK).select("band", "bi", "bj", "rep", "n", "sig")
    links = buckets.repartition(partitions(spark), "band", "bi", "bj").sortWithinPartitions("band", "bi", "bj").mapInArrow(_candidate_links(least, threshold), "a long, b long")
    near = components(links)

    members = stored(near.join(classes, near.node == classes.rep).select("root", "rep", "key", "copies", "sig", F.col("r.doc_id").alias("d"), F.col("r.h").alias("t")), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    known = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            own = [shingles(t.as_py(), hashes, k).tobytes() for t in batch.column(4)]
            kept = pa.array([xxhash.xxh3_128_digest(u) == key.as_py() for u, key in zip(own, batch.column(5), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(own, pa.binary())], names=["root", "rep", "copies", "sig", "set"]).filter(kept)

    held = texts.join(known, (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    found = held.select("root", "rep", "copies", "sig", "text", "key").mapInArrow(sets, "root long, rep long, copies long, sig binary, set binary")
    checked = verified(found, threshold, tolerance)
    final = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = classes.select("key", "rep", "copies", "first").join(final, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_class = rooted.drop("first").join(told, "rep", "left").join(firsts, "root")
    by_class = by_class.select("key", F.coalesce("first.doc_id", "first.h").alias("class"), F.col("first.id").alias("keeper"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("others"))
    whole = feats.select("doc_id", "h", "id", "key", "n").join(by_class, "key", "left")
    own = lambda c, alone: F.when(F.col("n") > 0, F.col(c)).otherwise(alone)
    return whole.select("doc_id", "h", "id", own("class", F.coalesce("doc_id", "h")).alias("class_id"), own("others", F.lit(0)).cast("long").alias("n_links"), own("keeper", F.col("id")).alias("keeper"))

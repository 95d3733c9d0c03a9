"""Nearest neighbours by a permutation index.

PIVOTS vectors, chosen far apart in a bounded sample (`SAMPLE` in expectation), order every vector: it is represented by its
NEAREST pivots in order. Inverted files post it there: a pivot's file lists the rows that have it among their NEAREST, each with its weight (NEAREST
for a row's first pivot down to 1). The footrule distance of two orders is a constant less twice the sum of the lesser
weights over shared pivots, so a query reads the files of its own pivots only (NEAREST / PIVOTS of all postings) and adds up
the lesser weights of the rows that it meets. The `share` of a block (16 k rows at least) that is nearest by
footrule, and all ties with the last of it, is reranked by the exact inner product in double precision.

Every row is indexed, in blocks of about `block_rows` by a hash of vec_id. The queries go to every block in a shuffle, not through
the driver; a task holds one block and a batch of queries. Each block gives its best k, and the best k of those are a grouped
sort of k rows a block. Recall is measured against brute force in tests/llm/test_permutation_index.py (and README.md): 0.95 and more at these parameters.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
with a null vec_id. Repeated rows count once; of several vectors with one vec_id the least array counts. Ties go to the
smaller vec_id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS, NEAREST, SAMPLE = 512, 64, 4096
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): the vectors that take part, one for each vec_id."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector_col, lambda x: x != 0))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()  # few lengths
    return rows.where(F.size("v") == sizes["n"]) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Each pivot is the sampled vector whose greatest cosine with those before it is least."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, near = [0], unit @ unit[0]
    while len(taken) < min(most, len(unit)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The NEAREST pivots of each vector, in order."""
    n = min(NEAREST, len(pivots))
    near = x @ pivots.T
    some = np.sort(np.argpartition(-near, n - 1, axis=1)[:, :n], axis=1)  # by number, so that ties are settled
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


class Block:
    """The inverted files of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.x, self.pivots = ids[order], x[order], pivots
        posted = np.concatenate([permutations(self.x[lo : lo + 4096], pivots) for lo in range(0, len(ids), 4096)])
        n = posted.shape[1]
        by_pivot = np.argsort(posted.ravel(), kind="stable")
        self.rows = (by_pivot // n).astype(np.int32)
        self.weights = (n - by_pivot % n).astype(np.uint8)
        self.begins = np.searchsorted(posted.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, own: np.ndarray) -> np.ndarray:
        """For each row the sum of the lesser weights over the pivots that it shares with the permutation `own`."""
        shared = np.zeros(len(self.ids), np.uint16)
        for place, pivot in enumerate(own.tolist()):
            a, b = self.begins[pivot], self.begins[pivot + 1]
            shared[self.rows[a:b]] += np.minimum(self.weights[a:b], len(own) - place)  # a file lists a row once
        return shared

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vec_ids, scores) of each query's k best of the block."""
        most = max(16 * k, int(share * len(self.ids)))
        for own, vector, order in zip(ids.tolist(), q, permutations(q, self.pivots), strict=True):
            if most < len(self.ids):
                shared = self.footrule(order)
                near = np.flatnonzero(shared >= np.partition(shared, -most)[-most])
            else:
                near = np.arange(len(self.ids))
            near = near[self.ids[near] != own]
            score = np.einsum("ij,j->i", self.x[near], vector)
            best = np.lexsort((self.ids[near], -score))[:k]
            yield own, self.ids[near[best]], score[best]


def search(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, share: float = 0.1, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that fits `queries`, its own row left out."""
    rows = valid(vectors, id_col, vector_col)
    spark, n = vectors.sparkSession, rows.count()
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))).toArrow()
    if not sample.num_rows:
        sample = rows.limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = spark.sparkContext.broadcast(choose_pivots(_matrix(sample.sort_by("vec_id")["v"].combine_chunks())))
    blocks = -(-n // block_rows)
    own = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)).cast("int")
    index = rows.select(own.alias("block"), F.lit(False).alias("asked"), "vec_id", "v")
    asked = rows.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), "vec_id", "v")
    dealt = index.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = -1, [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if keys[0, lo] != at:
                    at, held, block = keys[0, lo], [], None
                ids, x = batch.column(2).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(3).slice(lo, hi - lo))
                if not keys[1, lo]:
                    held.append((ids, x))
                elif held or block:
                    block = block or Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pivots.value)
                    held = []
                    found = list(block.search(ids, x, k, share))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), *(pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2))], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

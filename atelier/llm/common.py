"""What the operators share: scratch tables in the cluster's shared folder, word tokens, hashes, components."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_scratch, forget, scratch, shared_dir, stored, tidy  # noqa: F401

#: Bytes that separate words: all of ASCII but digits and letters (texts are lower-cased first).
SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: Rows of a table of words (or row numbers) up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_TERMS = 200_000
_TO_SPACE = bytes(32 if b in SEPARATORS else b for b in range(256))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder in shared storage; a file: URI is a mounted path."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def mounted(uri: str) -> str | None:
    """The local path of a file: URI, else None."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased: runs of digits, letters and all that is not ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


def trim() -> None:
    """Gives freed memory of a worker back to the system: workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


class Hashes(dict):
    """Word -> signed 64-bit hash; forgets all when it holds `bound` words, so memory stays bounded."""

    def __init__(self, bound: int = 500_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of sums of products can be used as a hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (k rolling products, wrapped to 64 bits)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def free(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): rows (node, root), root the least node of the component.

    Alternates large-star and small-star steps; each is a grouped minimum joined back, written to the shared
    folder, so that both sides of the joins are plain shuffles and a hub's links can be split by the skew join.
    Null ends and loops are ignored. An empty input gives an empty result.
    """
    edges = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:  # each round shortens every chain by a constant factor, so rounds grow with the logarithm of its length
        steps: list[DataFrame] = []
        keep = lambda df, name: steps.append(stored(df, name)) or steps[-1]  # noqa: E731, B023
        both = edges.union(edges.select("b", "a"))
        least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = keep(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down).distinct()
        last, edges = edges, stored(small.where("a <> b"), "edges")
        forget(last, *steps)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For points 0..n-1 and links left-right, the least point of each one's component."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    return root



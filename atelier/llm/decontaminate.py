"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII characters. Of every six consecutive 8-word hashes the
least ones are a text's fingerprints; two texts that share 13 words share one of them for certain. Document and benchmark
fingerprints are joined, and each hit is extended word by word, so that what counts is the text itself and not its
hash. An item of fewer than 13 words is one window and is looked up whole.

The join has two forms with equal results. A benchmark of at most about `broadcast_words` words (its size is summed first) is broadcast with its
fingerprints, and documents are only scanned. Beyond that both sides' fingerprints are shuffled: each document gives every
fingerprint once, pairs of document and item that share one are counted once, the candidates of a document are extended in groups
of about ITEMS items, and the groups' bitmaps are joined by OR. No group then grows with the benchmark or with the documents that hold a passage.

Nulls: a null text has no words; an item with a null id marks words but is not listed. Repeated rows are judged alike and
a repeated item_id is listed once. Ties among equal hashes are all fingerprints. Very long texts are searched whole. Empty tables give empty results or
no hits. All columns of docs are kept, but one named as `result_col` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, free, grams, mix, stored, trim, words

WINDOW, GRAM, ITEMS = 13, 8, 200
FOUND = "struct<n_words: bigint, n_hit: bigint, hits: binary, items: array<bigint>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.int64()))])


def fingerprints(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of values that are the least of some `window` consecutive ones; all of them if there are fewer."""
    n = len(g) - window + 1
    if n <= 0:
        return np.arange(len(g))
    least = g[:n].copy()
    for i in range(1, window):
        np.minimum(least, g[i : i + n], out=least)
    kept = np.zeros(len(g), bool)
    for i in range(window):
        kept[i : i + n] |= g[i : i + n] == least
    return np.flatnonzero(kept)


class Index:
    """Fingerprints of one block of items, and their words for the extension."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW, gram: int = GRAM):
        self.items, self.window, self.gram = items, window, gram
        hashes, keys, refs = Hashes(), [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, (_, own) in enumerate(items):
            h = hashes.of(own)
            if len(own) >= window:
                g = grams(h, gram)
                at = fingerprints(g, window - gram + 1)
                keys.append(g[at])
                refs += [(k, q) for q in at.tolist()]
            elif own:
                self.short.setdefault(len(own), {}).setdefault(int(grams(h, len(own))[0]), []).append(k)
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, begins = np.unique(flat[order], return_index=True)
        self.begins = np.append(begins, len(flat)).tolist()
        self.refs = [refs[i] for i in order.tolist()]
        self.short_keys = {n: np.sort(np.fromiter(own, np.uint64, len(own))) for n, own in self.short.items()}

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the values that are among sorted keys: their positions, and those of their keys."""
        if not len(keys) or not len(values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == values)
        return hit, at[hit]

    def mark(self, own: list[bytes], h: np.ndarray, hits: np.ndarray) -> set[int | None]:
        """Sets hits for every word within an occurring window; the items that occur."""
        found: set[int | None] = set()
        done: dict[tuple[int, int], int] = {}
        n = len(own)
        if n >= self.window and len(self.keys):
            g = grams(h, self.gram)
            at = fingerprints(g, self.window - self.gram + 1)
            for i, k in zip(*(x.tolist() for x in self._at(self.keys, g[at])), strict=True):
                p = int(at[i])
                for item, q in self.refs[self.begins[k] : self.begins[k + 1]]:
                    if done.get((item, p - q), -1) >= p:
                        continue
                    name, text = self.items[item]
                    lo, hi, left = p, p, q
                    while hi < n and q + hi - p < len(text) and own[hi] == text[q + hi - p]:
                        hi += 1
                    while lo and left and own[lo - 1] == text[left - 1]:
                        lo, left = lo - 1, left - 1
                    done[item, p - q] = max(hi - 1, p)
                    if hi - lo >= self.window:
                        hits[lo:hi] = True
                        found.add(name)
        for size, keys in self.short_keys.items():
            if n >= size:
                for p in self._at(keys, g := grams(h, size))[0].tolist():
                    for item in self.short[size][int(g[p])]:
                        if own[p : p + size] == self.items[item][1]:
                            hits[p : p + size] = True
                            found.add(self.items[item][0])
        return found


def _scanned(docs: DataFrame, items: DataFrame, text_col: str, window: int, gram: int, result_col: str) -> DataFrame:
    """docs with `result_col` (FOUND); the items are broadcast."""
    rows = items.toArrow().to_pylist()  # broadcast_words words at most
    sent = docs.sparkSession.sparkContext.broadcast([(r["id"], words(r["text"])) for r in rows])

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, hashes = Index(sent.value, window, gram), Hashes()
        for texts in batches:
            rows = []
            for text in texts:
                own = words(text.as_py())
                hits = np.zeros(len(own), bool)
                listed = index.mark(own, hashes.of(own), hits) - {None} if own else set()
                rows.append({"n_words": len(own), "n_hit": int(hits.sum()), "hits": np.packbits(hits).tobytes(), "items": sorted(listed)})
            yield pa.array(rows, _FOUND)
        del index, hashes
        trim()

    return docs.withColumn(result_col, search(F.col(text_col)))


def _keys(own: list[bytes], hashes: Hashes, window: int, gram: int, sizes: list[int]) -> np.ndarray:
    """Distinct fingerprints of a text; with them, for each of `sizes`, the hashes of all runs of so many words."""
    h, out = hashes.of(own), []
    if len(own) >= window:
        g = grams(h, gram)
        out.append(g[fingerprints(g, window - gram + 1)])
    out += [mix(grams(h, n) + np.uint64(n)) for n in sizes if len(own) >= n]
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _marks(rows: DataFrame, window: int, gram: int, sizes: list[int] | None) -> DataFrame:
    """row, n_words, keys of rows (row, text). sizes None: of items, a short one's only key is that of all its words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            n, keys = [], []
            for text in batch.column(1):
                own = words(text.as_py())
                n.append(len(own))
                keys.append(_keys(own, hashes, window, gram, ([len(own)] if 0 < len(own) < window else []) if sizes is None else sizes))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists], names=["row", "n_words", "keys"])

    return rows.select("row", "text").mapInArrow(mark, "row long, n_words long, keys array<long>")


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, gram: int, result_col: str) -> DataFrame:
    """As _scanned, by a shuffle join of fingerprints."""
    row = free(docs, "_row")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    items = stored(items.withColumn("row", F.monotonically_increasing_id()), "items")
    of_items = stored(_marks(items, window, gram, None), "item-marks")
    sizes = sorted(r[0] for r in of_items.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect())  # fewer than `window`
    texts = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    of_docs = stored(_marks(texts, window, gram, sizes), "document-marks")
    asked = of_items.select(F.col("row").alias("item"), F.explode("keys").alias("key"))
    hits = of_docs.select("row", F.explode("keys").alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    pairs = stored(hits.join(asked, "key").select("row", "item").distinct(), "candidates")
    many = pairs.groupBy("row").agg(F.ceil(F.count("*") / ITEMS).alias("groups"))
    groups = pairs.join(many, "row").join(items.select(F.col("row").alias("item"), "id", F.col("text").alias("item_text")), "item")
    groups = groups.groupBy("row", F.pmod(F.xxhash64("item"), "groups").alias("part")).agg(F.collect_list(F.struct("id", "item_text")).alias("items"))  # about ITEMS

    @F.arrow_udf("struct<hits: binary, items: array<bigint>>")
    def extend(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, candidates in batches:
            out, hashes = [], Hashes()
            for text, some in zip(texts, candidates, strict=True):
                own = words(text.as_py())
                bits = np.zeros(len(own), bool)
                index = Index([(x["id"], words(x["item_text"])) for x in some.as_py()], window, gram)
                listed = index.mark(own, hashes.of(own), bits) - {None}
                out.append({"hits": np.packbits(bits).tobytes(), "items": sorted(listed)})
            yield pa.array(out, pa.struct([("hits", pa.binary()), ("items", pa.list_(pa.int64()))]))

    @F.arrow_udf("struct<n_hit: bigint, hits: binary>")
    def either(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = []
            for bits in lists.to_pylist():
                whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits])
                out.append({"n_hit": int(np.unpackbits(whole).sum()), "hits": whole.tobytes()})
            yield pa.array(out, pa.struct([("n_hit", pa.int64()), ("hits", pa.binary())]))

    found = groups.join(texts, "row").select("row", extend("text", "items").alias("f"))
    merged = found.groupBy("row").agg(F.collect_list("f.hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"))  # a document's own
    merged = merged.select("row", either("hits").alias("f"), "items")
    told = of_docs.select("row", "n_words").join(merged, "row", "left")
    none = F.unhex(F.repeat(F.lit("00"), F.ceil(F.col("n_words") / 8).cast("int")))
    result = F.struct(F.col("n_words"), F.coalesce("f.n_hit", F.lit(0)).alias("n_hit"), F.coalesce("f.hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
    told = told.select(F.col("row").alias(row), result.alias(free(docs, "_result")))
    whole = docs.join(told, row)
    return whole.withColumn(result_col, F.col(free(docs, "_result"))).select(*[F.col(f"`{c}`") for c in docs.columns if c != row and c.lower() != result_col.lower()], result_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = 20, broadcast_words: int = 1_000_000, result_col: str = "found") -> DataFrame:
    """Adds struct `result_col`: n_words, n_hit, items (ids, ascending), contaminated (one word in `one_in` is hit, and one at least), hits (a bit for each word)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    search = _scanned if size <= 5 * broadcast_words else _joined
    out = search(docs, items, text_col, window, min(GRAM, window), result_col)
    f = F.col(result_col)
    judged = (f["n_hit"] > 0) & (one_in * f["n_hit"] >= f["n_words"])
    return out.withColumn(result_col, F.struct(*(f[x].alias(x) for x in ("n_words", "n_hit", "items")), judged.alias("contaminated"), f["hits"].alias("hits")))

"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Rows are range-partitioned by doc_id into shards of about SHARD characters (as many as there are shuffle partitions at least);
each streams its ids into `tokens-N.bin`, the offsets of its documents into `offsets-N.idx` (int64, one more than
documents, from 0) and their ids into `docs-N.idx` (int64). The manifest holds one line per shard; its bases are prefix sums
of the shards' totals, so a document's global start is its shard's base plus its offset there. A task holds some CHUNK bytes of text at a time
or one document: a very long text needs its own memory, but no group of texts is gathered.

Nulls: a null text is empty (its only id is the end id); rows with a null doc_id come first, flagged in the shard's
manifest line by their count. Ties: repeated doc_ids follow one another in order of a hash of their text, so equal rows give equal files
in any order. Empty input gives a manifest without shards and an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, mounted, partitions
from .tokens import encoder

READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Characters of text that a shard is meant to hold.
SHARD = 256_000_000
#: Bytes of text that are encoded in one call.
CHUNK = 4 << 20
_KINDS = ("tokens", "offsets", "docs")


class _Files:
    """The three files of a shard, written under names of this attempt and then renamed: a retried task replaces whole files by equal ones."""

    def __init__(self, uri: str, shard: int):
        self.fs, folder = filesystem(uri)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        ends = {"tokens": "bin", "offsets": "idx", "docs": "idx"}
        self.names = [(f"{folder}/.{k}-{shard:05d}.{attempt}", f"{folder}/{k}-{shard:05d}.{ends[k]}") for k in _KINDS]
        self.out = [self.fs.open_output_stream(a) for a, _ in self.names]

    def write(self, *chunks: bytes) -> None:
        for out, chunk in zip(self.out, chunks, strict=True):
            out.write(chunk)

    def close(self) -> None:
        for out, (attempt, name) in zip(self.out, self.names, strict=True):
            out.close()
            self.fs.move(attempt, name)


def chunks(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold `most` (CHUNK) bytes together, or one text."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + (most or CHUNK), "right")))
        yield lo, hi
        lo = hi


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> dict:
    """Writes the token files of docs to the folder `uri` (shared by all executors) and returns the manifest."""
    spark = docs.sparkSession
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, encode = TaskContext.get().partitionId(), encoder(tokenizer, end, keep_spaces=True, special_as_text=special_as_text)
        files, at, n_docs, nulls = _Files(uri, k), 0, 0, 0
        files.write(b"", np.int64(0).astype("<i8").tobytes(), b"")
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                ids, texts = (batch.column(c).slice(lo, hi - lo) for c in range(2))
                encoded = encode.many(texts.to_pylist())
                ends = at + np.cumsum([len(c) // encode.dtype.itemsize for c in encoded])
                files.write(b"".join(encoded), ends.astype("<i8").tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                at, n_docs, nulls = int(ends[-1]), n_docs + len(encoded), nulls + ids.null_count
        files.close()
        yield pa.RecordBatch.from_pydict({"shard": [k], "n_docs": [n_docs], "n_tokens": [at], "n_null": [nulls], "width": [encode.dtype.itemsize]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // SHARD))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = dealt.mapInArrow(shard, "shard long, n_docs long, n_tokens long, n_null long, width long").collect()  # a line for each shard
    shards = [r.asDict() for r in sorted(found, key=lambda r: r["shard"]) if r["n_docs"]]
    base = 0
    for s in shards:
        s["base"] = base
        base += s["n_tokens"]
    manifest = {"shards": shards, "n_tokens": base, "end": end}
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(uri: str) -> dict:
    fs, folder = filesystem(uri)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


class Ranges:
    """An array file in a store that can't be mapped: a slice reads its own bytes only."""

    def __init__(self, fs, path: str, dtype: str):
        self.file, self.dtype = fs.open_input_file(path), np.dtype(dtype)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, cut: slice) -> np.ndarray:
        lo, hi, _ = cut.indices(len(self))
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * width, lo * width), self.dtype)


def map_shard(uri: str, shard: dict) -> tuple:
    """(ids, offsets, doc ids) of a shard: memory maps where the folder is mounted, else Ranges."""
    dtypes, names = (f"<u{shard['width']}", "<i8", "<i8"), ("tokens-{:05d}.bin", "offsets-{:05d}.idx", "docs-{:05d}.idx")
    paths = [x.format(shard["shard"]) for x in names]
    if here := mounted(uri):
        return tuple(np.memmap(f"{here}/{p}", d, "r") for p, d in zip(paths, dtypes, strict=True))
    fs, folder = filesystem(uri)
    return tuple(Ranges(fs, f"{folder}/{p}", d) for p, d in zip(paths, dtypes, strict=True))


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """One row a document, from the files alone: its global start, its number of ids and their crc32 as uint32."""
    shards = read_manifest(uri)["shards"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0).to_pylist():
                s = json.loads(line)
                ids, offsets, docs = map_shard(uri, s)
                for at in range(0, len(docs), 4096):
                    cut, own = offsets[at : at + 4097], docs[at : at + 4096]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=np.arange(at, at + len(crc)) < s["n_null"]), pa.array(cut[:-1] + s["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    lines = spark.createDataFrame([(json.dumps(s),) for s in shards], "line string")
    return lines.repartition(max(1, len(shards))).mapInArrow(rows, READ)


def size_on_disk(uri: str) -> int:
    fs, folder = filesystem(uri)
    from pyarrow import fs as afs

    return sum(x.size for x in fs.get_file_info(afs.FileSelector(folder)) if x.is_file and not os.path.basename(x.path).startswith("."))

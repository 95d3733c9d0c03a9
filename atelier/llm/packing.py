"""Packing by concatenating and cutting: every token stream position is a prefix sum, windows are cut at multiples of the length.

Pass one encodes each partition's documents and writes ids with the document's offset in its partition. Partition
totals (one row each) are summed up to bases. Pass two turns a document's global range into pieces: one for each window
that it touches. A window that crosses documents or partitions is put together from its pieces by sequence_id.
Only the last sequence is not full; it is padded, unless its length is a power of two.

Nulls: a null text is empty and yields its end id alone; a null doc_id is kept as it is. Repeated rows are packed as
often as they occur, ties in their order of the scan. A very long text is encoded whole and gives a piece for each sequence that it
touches; 200 texts are held at a time. Empty input gives no pieces. Columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trim
from .tokens import KNOWN, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, known: int = KNOWN, special_as_text: bool = False) -> DataFrame:
    """One row a piece; `ids` are its ids as little-endian unsigned 16-bit integers (32-bit for larger vocabularies), null if not asked for.

    `known`: how many text pieces a worker keeps; fewer take less memory and more time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        own, at, part = encoder(tokenizer, end, keep_spaces=False, bound=known, special_as_text=special_as_text), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                cut = batch.slice(lo, 200)
                ids = own.many(cut.column(1).to_pylist())
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // own.dtype.itemsize
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), cut.column(0), pa.array(local), pa.array(n), pa.array(ids, pa.binary())], names=["part", "doc_id", "local", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = stored(rows.mapInArrow(encode, "part int, doc_id long, local long, n long, ids binary"), "packed-ids")
    totals = sorted(encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a line for each partition
    bases = dict(zip((r["part"] for r in totals), np.cumsum([0] + [r["n"] for r in totals]).tolist(), strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            part, doc, local, count, ids = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                begin, n, own = bases[part[i].as_py()] + local[i].as_py(), count[i].as_py(), ids[i].as_py()
                arr = np.frombuffer(own, f"<u{len(own) // n}")
                lo = 0
                while lo < n:
                    seq, off = divmod(begin + lo, length)
                    hi = min(n, lo + length - off)
                    out.append((doc[i].as_py(), lo, hi - lo, zlib.crc32(arr[lo:hi].astype("<u4").tobytes()), n, seq, off, arr[lo:hi].tobytes() if with_ids else None))
                    lo = hi
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return encoded.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, length: int = 4096, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, padded to `length` (at a power of two it stays)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `length` pieces
    width = F.length("ids") / F.col("length")
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.max(width).cast("int").alias("width"), parts.alias("p"))
    joined = F.expr("aggregate(p, X'', (s, x) -> concat(s, x.ids))")
    n = F.col("n_tokens")
    short = (n < length) & (n.bitwiseAND(n - 1) != 0)
    padding = F.expr(f"cast(repeat('\\0', cast(({length} - n_tokens) * width as int)) as binary)") if pad == 0 else F.expr(f"unhex(repeat(if(width = 2, '{pad.to_bytes(2, 'little').hex() if pad < 65536 else ''}', '{pad.to_bytes(4, 'little').hex()}'), cast({length} - n_tokens as int)))")
    return whole.select("sequence_id", "n_tokens", F.when(short, F.concat(joined, padding)).otherwise(joined).alias("ids"))

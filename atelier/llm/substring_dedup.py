"""Repeated passages across documents, found as near-duplicate paragraphs.

Two kinds of paragraphs cover a text. Natural ones are made of its lines: each line of LINE words at least, and each run of shorter lines,
cut at line ends into pieces of LINE words at least. A text of fewer than LINE words is one. What is left of a run, fewer than LINE words between
longer lines, is in anchored paragraphs only; a similarity of 0.8 on five-word shingles leaves room for an edited word amid a paragraph from 49 words
on, so for what is shorter bands would find little that shared runs don't. A passage
need not begin or end with a line, so other paragraphs are anchored in the words: of every WINDOW consecutive places where one could begin, the place
whose five-word shingle has the least hash begins a paragraph of SIZE words. Two texts that share WINDOW + SIZE - 1 = 50 words
share an anchored paragraph for certain, wherever the passage stands. Anchored paragraphs are seeds: each that repeats is extended
word by word on both sides, as far as an earlier document (for the kept one: any other) has the same words around it. Shared
seeds are at most REACH = 32 words from each other and from the ends of a shared run, so with REACH words on either side the
seeds of a run cover it whole. Occurrences of a seed are compared in blocks, and each pair of blocks is a group.

Equal paragraphs form a class by 96 bits of hashes, counted with partial sums. Natural ones also have MinHash values in BANDS bands of
ROWS, tuned to miss at most 2.5e-4 of the pairs at a similarity of 0.8: classes that collide in a band are linked to the band's least one, so
links stay linear; in the components of these links all pairs are verified on exact Jaccard in blocks
(jaccard_join.verified), and components of verified links cluster the removals. Each cluster that occurs in two
documents at least stays in its least document and is removed from the others.

Texts are never shuffled: a paragraph carries its task's number and its row there, what later steps ask of a text is written in a file for each
such task, and the task that reads the same texts again reads its file. Texts that no plain scan gives are stored first, so that they come in the same order.

Nulls, empty texts and texts of fewer than K = 5 words, which have no shingle, have no paragraphs. A null doc_id takes part under a negative id
made from its text. Rows with one id are one document: repeated rows alone don't repeat a passage. Ties: of documents with a
passage the least id keeps it. Very long texts are searched whole; a task works on
500 texts or 2 MB of text at once, a longer text alone. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.compute import binary_length
from pyarrow.dataset import dataset
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import _TO_SPACE, components, filesystem, forget, grams, mix, partitions, scratch, stored, tidy
from .jaccard_join import BROADCAST_ROWS, _grouped, minhash, signature, verified

K, SIZE, WINDOW, LINE, THRESHOLD, ROWS = 5, 18, 33, 20, 0.8, 3
#: Bands' least paragraphs (16 bytes each, so 64 MB) up to which they are broadcast; beyond, both sides are shuffled.
HUBS = 4_000_000
REACH, SEED_BLOCK = WINDOW - 1, 16384
_MARK = "key long, more int, id long, doc_id long, part int, row int, word int, start int, end int, bands array<long>"
_SEED = "key long, id long, doc_id long, word int, start int, end int, kept boolean, blocks long, around binary, gaps binary"


def ident(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), -F.pmod(F.xxhash64(text_col), F.lit(1 << 62)) - 1)


def tuned(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of `rows` values that find a pair at the threshold with probability `recall`."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


#: Texts, and bytes of text, that are worked on at once; a longer text is worked on alone.
TEXTS, TEXT_BYTES = 500, 2 << 20
BANDS = tuned(THRESHOLD, ROWS, 1 - 2.5e-4)  # misses as few as jaccard_join does
_MIXED = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD, _TURN = _MIXED.astype(np.uint32) | np.uint32(1), (_MIXED >> np.uint64(32)).astype(np.uint32)  # of hashes (x ^ turn) * odd in 32 bits


def _placed(raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts, one after another: the lower-cased bytes, sizes of words in bytes, their begins and ends in code points of their own text, the line that each is in, and words of each text."""
    raw = b"\n".join(raws)  # so that no word or line goes from one text into the next
    a = np.frombuffer(raw, np.uint8)
    low = raw.lower().translate(_TO_SPACE)
    edges = np.flatnonzero(np.diff(np.frombuffer(low, np.uint8) == 32, prepend=True, append=True))
    heads = np.cumsum([0, *(len(r) + 1 for r in raws)])
    counts = np.diff(np.searchsorted(edges[::2], heads))
    tails = np.flatnonzero((a & 0xC0) == 0x80)  # bytes that begin no code point
    points = edges - np.searchsorted(tails, edges)
    own = np.repeat(heads[:-1] - np.searchsorted(tails, heads[:-1]), counts)
    return low, edges[1::2] - edges[::2], points[::2] - own, points[1::2] - own, np.searchsorted(np.flatnonzero(a == 10), edges[::2]), counts


def placed_words(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, their begins and ends in code points, and the line that each is in."""
    low, _, begins, ends, lines, _ = _placed([text.encode("utf-8", "surrogatepass")])
    return low.split(), begins, ends, lines


def hashed(low: bytes, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words of `low`, as those of common.Hashes; each different word is hashed once."""
    if not len(sizes):
        return np.empty(0, np.uint64)
    offsets = np.append(0, np.cumsum(sizes))
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(low.translate(None, b" "))]).dictionary_encode()
    different = words.dictionary.to_pylist()
    return (np.fromiter(map(xxh3_64_intdigest, different), np.uint64, len(different)) ^ np.uint64(1 << 63))[words.indices.to_numpy()]


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts texts of so many bytes into runs of TEXTS texts and about TEXT_BYTES at most, one text at least."""
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXT_BYTES, "right"))
        hi = min(max(hi, lo + 1), lo + TEXTS, len(sizes))
        yield lo, hi
        lo = hi


def _raw(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()).fill_null(b"")


def _slide(x: np.ndarray, window: int, best) -> np.ndarray:
    """Least or greatest of each `window` consecutive values, by doubling."""
    done = 1
    while done < window:
        step = min(done, window - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(g: np.ndarray, first: np.ndarray, room: np.ndarray, window: int) -> np.ndarray:
    """Of the `room` values from each `first` on: places of those that are the least of some `window` consecutive ones; of the least of all, if there are no more."""
    wide, out = room > window, []
    if wide.any():
        least, at = np.zeros(len(g), np.uint64), _inside(first[wide], (first + room)[wide] - window + 1)
        least[at] = _slide(g, window, np.minimum)[at]
        places = _inside(first[wide], (first + room)[wide])
        most = _slide(np.concatenate([np.zeros(window - 1, np.uint64), least]), window, np.maximum)
        out.append(places[most[places] == g[places]])
    if not wide.all():
        n = room[~wide]
        places, begins = _inside(first[~wide], first[~wide] + n), np.cumsum(n) - n
        equal = g[places] == np.repeat(np.minimum.reduceat(g[places], begins), n)
        at = places[equal]
        out.append(at[np.searchsorted(at, first[~wide])])
    return np.sort(np.concatenate(out))


def anchored(g: np.ndarray, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First words and keys of the anchored paragraphs of texts of so many words, one after another, with shingle hashes g."""
    sizes = np.atleast_1d(sizes)
    first, room = np.cumsum(sizes) - sizes, sizes - SIZE + 1
    first, room = first[room > 0], room[room > 0]
    if not len(first):
        return np.empty(0, np.int64), np.empty((0, 2), np.int64)
    at = anchors(g, first, room, WINDOW)
    code, text = _code(g, at), np.searchsorted(first, at, "right")
    same = (code[1:, 0] == code[:-1, 0]) & (text[1:] == text[:-1])  # short periods: of a chain of equal paragraphs its ends and one in every SIZE words
    amid = (np.flatnonzero(same[:-1] & same[1:]) + 1).tolist()
    if amid:
        kept, last, before = np.ones(len(at), bool), 0, -1
        for i in amid:
            if i - 1 != before:
                last = int(at[i - 1])
            if at[i] - last < SIZE:
                kept[i] = False
            else:
                last = int(at[i])
            before = i
        at, code = at[kept], code[kept]
    return at, code


def _code(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the paragraphs of SIZE words that begin at `at`: two columns of independent hashes."""
    code, more = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for c in range(SIZE - K + 1):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + g[at + c])
        more = (more + g[at + c]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _both(code, more)


def _both(code: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A key, and 32 bits of another hash."""
    return np.stack([code.view(np.int64), (more >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)], 1)


def surroundings(h: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For seeds at `at` the REACH words before, nearest first, then those after (as halves of their hashes), and the code points each adds.

    Beyond the words [first, stop) of the seed's text words are 0 and add nothing.
    """
    j, w = np.arange(REACH), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    before, after = at[:, None] - 1 - j, at[:, None] + SIZE + j
    left, right = before >= first[:, None], after < stop[:, None]
    before, after = np.where(left, before, at[:, None]), np.where(right, after, at[:, None])
    return np.hstack([np.where(left, w[before], 0), np.where(right, w[after], 0)]), np.hstack([np.where(left, begins[before + 1] - begins[before], 0), np.where(right, ends[after] - ends[after - 1], 0)])


def _rows(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)), pa.py_buffer(np.ascontiguousarray(x))])


def _gap_rows(gaps: np.ndarray) -> pa.Array:
    """The bytes of each row, as 8 bits a value if all of the row's fit, else as 32."""
    small = gaps.max(1) < 256
    if small.all():
        return _rows(gaps.astype(np.uint8))
    return pa.array([x.astype(np.uint8 if s else np.uint32).tobytes() for x, s in zip(gaps, small, strict=True)], pa.binary())


def shared_reach(group: np.ndarray, ids: np.ndarray, kept: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How many words of its row of `side` each seed shares with a seed of its group in an earlier document, a kept one in any other."""
    out, at, code = np.zeros(len(ids), np.int64), np.arange(len(ids)), group.astype(np.uint64)
    for j in range(side.shape[1]):
        _, code = np.unique((code << np.uint64(32)) | side[at, j], return_inverse=True)
        own, least, most = ids[at], np.full(int(code.max()) + 1, np.iinfo(np.int64).max), np.full(int(code.max()) + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, code, own)
        np.maximum.at(most, code, own)
        out[at[np.where(kept[at], most[code] > own, least[code] < own)]] = j + 1
        alive = least[code] < most[code]  # who shares a prefix with no other document is of no use to others
        at, code = at[alive], code[alive].astype(np.uint64)
        if not len(at):
            break
    return out


def _extended(columns: list[pa.ChunkedArray]) -> Iterator[pa.RecordBatch]:
    """Rows key, bi, bj, then _SEED's other columns, of whole groups: the same seeds with extended places."""
    ids, kept = columns[3].to_numpy(), columns[8].to_numpy()
    group = np.cumsum(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (c.to_numpy() for c in columns[:3])], axis=0)]))
    around = np.frombuffer(b"".join(columns[10].to_pylist()), np.uint32).reshape(-1, 2 * REACH)
    gaps = columns[11].to_pylist()
    if all(len(x) == 2 * REACH for x in gaps):
        gaps = np.frombuffer(b"".join(gaps), np.uint8).reshape(-1, 2 * REACH).astype(np.int64)
    else:
        gaps = np.stack([np.frombuffer(x, np.uint8 if len(x) == 2 * REACH else np.uint32).astype(np.int64) for x in gaps])
    sides = [slice(0, REACH), slice(REACH, 2 * REACH)]
    left, right = (np.where(np.arange(REACH) < shared_reach(group, ids, kept, around[:, s])[:, None], gaps[:, s], 0).sum(1) for s in sides)
    start, end = columns[6].to_numpy() - left, columns[7].to_numpy() + right
    arrays = [columns[0], columns[3], columns[4], columns[5], pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), columns[8]]
    yield from pa.table(arrays, names=["key", "id", "doc_id", "word", "start", "end", "kept"]).to_batches()


def units(sizes: list[int], n: int) -> list[tuple[int, int]]:
    """First word and end of the natural paragraphs of a text of n words in lines of `sizes` words."""
    if n < LINE:
        return [(0, n)]
    out, at, begin, words = [], 0, 0, 0
    for size in sizes:
        if size >= LINE:
            out.append((at, at + size))
            words = 0
        else:
            begin = begin if words else at
            words += size
            if words >= LINE:
                out.append((begin, at + size))
                words = 0
        at += size
    return out


def natural(g: np.ndarray, lines: np.ndarray, counts: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, sizes in words and keys of the natural paragraphs of texts of so many words, and which shingles lie in each (as begins and ends)."""
    starts = np.flatnonzero(np.diff(lines, prepend=-1))
    sizes, counts = np.diff(np.append(starts, len(lines))).tolist(), np.atleast_1d(counts)
    heads = np.append(0, np.cumsum(counts))
    held = np.searchsorted(starts, heads).tolist()
    cuts = [(a + x, a + y) for a, n, lo, hi in zip(heads.tolist(), counts.tolist(), held, held[1:], strict=False) if n >= K for x, y in units(sizes[lo:hi], n)]
    cuts = np.array(cuts, np.int64).reshape(-1, 2)
    begins, sizes = cuts[:, 0], cuts[:, 1] - cuts[:, 0]
    ends = begins + sizes - K + 1
    if not len(begins):
        return begins, sizes, np.empty((0, 2), np.int64), ends
    inside, first = _inside(begins, ends), np.cumsum(ends - begins) - (ends - begins)
    place = np.arange(len(inside)) - np.repeat(first, ends - begins)
    code = mix(g[inside] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    other = (g[inside] ^ (code >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return begins, sizes, _both(np.add.reduceat(code, first), np.add.reduceat(other, first)), ends


def _inside(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - begins
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)


def _bands(g: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band hashes of the shingles [begins, ends): a row of BANDS for each."""
    n = ends - begins
    own, first = (g[_inside(begins, ends)] >> np.uint64(32)).astype(np.uint32), np.cumsum(n) - n
    code = np.tile(np.arange(BANDS, dtype=np.uint64), (len(n), 1))
    for r in range(ROWS):
        least = [np.minimum.reduceat((own ^ turn) * odd, first) for turn, odd in zip(_TURN[r * BANDS : (r + 1) * BANDS], _ODD[r * BANDS : (r + 1) * BANDS], strict=True)]
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.stack(least, 1))
    return code.view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _MARK.split(", ")]
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        raws = _raw(batch.column(2))
        for lo, hi in _cuts(binary_length(raws).to_numpy()):
            low, sizes, begins, ends, lines, counts = _placed(raws[lo:hi].to_pylist())
            g = grams(hashed(low, sizes), K)
            at, key = anchored(g, counts)
            first, n, line_key, stop = natural(g, lines, counts)
            word, last = np.concatenate([at, first]), np.concatenate([at + SIZE, first + n]) - 1
            if not len(word):
                continue
            heads = np.cumsum(counts) - counts
            owner = np.searchsorted(heads, word, "right") - 1  # a text without words has the head of the next one
            keys, flat = np.concatenate([key, line_key]), _bands(g, first, stop).ravel() if len(first) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.repeat([0, BANDS], [len(at), len(first)]))).astype(np.int32), pa.array(flat))
            rows = pa.array(owner + lo)
            place = [np.full(len(owner), part), owner + seen + lo, word - heads[owner], begins[word], ends[last]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x.astype(np.int32)) for x in place), lists], names=names)
        seen += batch.num_rows


def _fixed(docs: DataFrame) -> DataFrame:
    """docs, if each run of them gives every partition the same rows in the same order, as scans of files and of given rows do; else a stored copy."""
    nodes, todo = set(), [docs._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        nodes.add(node.nodeName().split(" ")[0])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return docs if nodes <= {"Scan", "LocalTableScan", "Project", "Filter"} else stored(docs, "texts")


def _sorted_out(asks: DataFrame) -> str:
    """Writes asks (part, row, ...) into the shared folder, a file for each part of the texts in order of its rows, and returns the folder."""
    spark = asks.sparkSession
    uri = scratch(spark, "asks")
    asks.repartition(partitions(spark), "part").sortWithinPartitions("part", "row").write.option("compression", "zstd").partitionBy("part").parquet(uri)
    return uri


def _asked(uri: str, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that are asked for in this task's part of the texts, ascending, and the other columns."""
    fs, folder = filesystem(uri)
    own = f"{folder}/part={TaskContext.get().partitionId()}"
    if fs.get_file_info(own).type == FileType.NotFound:
        return np.empty(0, np.int64), [np.empty(0, np.int64) for _ in columns]
    table = dataset(own, filesystem=fs, format="parquet").to_table(columns=["row", *columns])
    row, *rest = (c.to_numpy().astype(np.int64) for c in table.columns)
    order = np.argsort(row, kind="stable")
    return row[order], [c[order] for c in rest]


def _answered(uri: str, columns: list[str], work):
    """A mapInArrow function for the texts: for rows that are asked for, several at once, `work` gets the batch, their rows in it, their texts, and, for each
    thing asked, which of these texts it is asked of and its columns. Rows that don't come are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        rows, values = _asked(uri, columns)
        for batch in batches:
            a, b = np.searchsorted(rows, [seen, seen + batch.num_rows])
            own, of = np.unique(rows[a:b] - seen, return_inverse=True)
            raws = _raw(batch.column(2).take(pa.array(own)))
            for lo, hi in _cuts(binary_length(raws).to_numpy()):
                c, d = np.searchsorted(of, [lo, hi])
                yield work(batch, own[lo:hi], raws[lo:hi].to_pylist(), of[c:d] - lo, [v[a + c : a + d] for v in values])
            seen += batch.num_rows
        if len(rows) and rows[-1] >= seen:
            raise RuntimeError("the texts have not come in the partitions that they had before")

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = 1e-5) -> DataFrame:
    """Every occurrence of a repeated paragraph: doc_id, id, start, end (code points), class_id, kept (it stays in this document)."""
    spark = docs.sparkSession
    texts = docs.select(ident(id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = _fixed(texts)
    marks = stored(texts.mapInArrow(_marked, _MARK), "paragraphs")

    in_bands = marks.where(F.size("bands") > 0).select("key", F.explode("bands").alias("band"))
    hubs = in_bands.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub < top").select("band", "hub")  # partial minima first
    hubs = stored(hubs, "band-hubs")
    linked = in_bands.join(F.broadcast(hubs) if hubs.count() <= HUBS else hubs, "band").where("key <> hub")
    near = components(linked.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    forget(hubs)
    tidy(spark)

    sent = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    held = marks.where(F.size("bands") > 0).select("key", "more", "id", "part", "row").join(sent, marks.key == near.node)
    at = F.min(F.struct("id", "part", "row")).alias("at")
    members = stored(held.groupBy("root", "key", "more").agg(at, F.max("id").alias("last"), F.count("*").alias("copies")), "paragraph-members")
    wanted = _sorted_out(members.select("at.part", "at.row", "key", "more", "root", "copies"))

    def sets(batch: pa.RecordBatch, rows: np.ndarray, raws: list[bytes], of: np.ndarray, asked: list[np.ndarray]) -> pa.RecordBatch:
        low, sizes, _, _, lines, counts = _placed(raws)
        g = grams(hashed(low, sizes), K)
        first, _, keys, stop = natural(g, lines, counts)
        text = np.searchsorted(np.cumsum(counts), first, "right")
        found = dict(zip(zip(text.tolist(), *keys.T.tolist(), strict=True), zip(first.tolist(), stop.tolist(), strict=True), strict=True))
        key, more, root, copies = asked
        held = [np.unique(g[slice(*found[x])]) for x in zip(of.tolist(), key.tolist(), more.tolist(), strict=True)]
        arrays = [pa.array(root), pa.array(key), pa.array(copies), pa.array([signature(minhash(u)) for u in held], pa.binary()), pa.array([u.tobytes() for u in held], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["root", "rep", "copies", "sig", "set"])

    found = texts.mapInArrow(_answered(wanted, ["key", "more", "root", "copies"], sets), "root long, rep long, copies long, sig binary, set binary")
    checked = verified(found, threshold, tolerance)
    final = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    forget(checked)
    tidy(spark)

    by_key = marks.groupBy("key", "more").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last")
    alone = by_key.join(final, by_key.key == final.node, "left_anti").select("key", "more", F.col("key").alias("class_id"), F.col("first").alias("keeper"), "n")
    linked = members.join(final, members.key == final.node).select("key", "more", final.root.alias("class_id"), F.col("at.id").alias("first"), "last", F.col("copies").alias("n"))
    several = linked.groupBy("class_id").agg(F.min("first").alias("keeper"), F.max("last").alias("last")).where("keeper < last").select("class_id", "keeper")
    repeated = stored(alone.unionByName(linked.select("key", "more", "class_id", "n").join(several, "class_id")), "repeated-paragraphs")
    forget(members)
    tidy(spark)
    lines = marks.where(F.size("bands") > 0).select("key", "more", "doc_id", "id", "start", "end").join(repeated, ["key", "more"])
    lines = stored(lines.select("doc_id", "id", "start", "end", "class_id", (F.col("id") == F.col("keeper")).alias("kept")), "repeated-lines")
    hits = marks.where(F.size("bands") == 0).select("key", "more", "part", "row", "word").join(repeated, ["key", "more"])
    hits = _sorted_out(hits.select("part", "row", "word", "key", "keeper", F.ceil(F.col("n") / SEED_BLOCK).alias("blocks")))
    forget(marks, repeated)
    tidy(spark)

    names = [x.split()[0] for x in _SEED.split(", ")]

    def seeds(batch: pa.RecordBatch, rows: np.ndarray, raws: list[bytes], of: np.ndarray, asked: list[np.ndarray]) -> pa.RecordBatch:
        low, sizes, begins, ends, _, counts = _placed(raws)
        word, key, keeper, blocks = asked
        stop = np.cumsum(counts)[of]
        first = stop - counts[of]
        at = word + first
        around, gaps = surroundings(hashed(low, sizes), begins, ends, at, first, stop)
        id_, doc_id = (batch.column(c).take(pa.array(rows[of])) for c in range(2))
        places = [pa.array(x.astype(np.int32)) for x in (word, begins[at], ends[at + SIZE - 1])]
        return pa.RecordBatch.from_arrays([pa.array(key), id_, doc_id, *places, pa.array(keeper == id_.to_numpy()), pa.array(blocks), _rows(around), _gap_rows(gaps)], names=names)

    held = texts.mapInArrow(_answered(hits, ["word", "key", "keeper", "blocks"], seeds), _SEED)
    own = F.pmod(F.xxhash64("id"), "blocks")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("bi"), F.greatest(o, own).alias("bj")))
    cut = held.withColumn("p", F.explode(pair)).select("key", "p.bi", "p.bj", *names[1:])
    grouped = cut.repartition(partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    whole = grouped.mapInArrow(_grouped(3, _extended), "key long, id long, doc_id long, word int, start int, end int, kept boolean")
    whole = whole.groupBy("key", "id", "doc_id", "word", "kept").agg(F.min("start").alias("start"), F.max("end").alias("end"))  # over pairs of blocks
    return lines.unionByName(whole.select("doc_id", "id", "start", "end", F.col("key").alias("class_id"), "kept"))


def removals(passages: DataFrame) -> DataFrame:
    """id and the merged spans (start, end) that each document loses; what a kept paragraph covers is not spared twice."""
    order = Window.partitionBy("id").orderBy("start", "end")
    lost = passages.where("not kept").select("id", "start", "end").distinct()
    fresh = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return lost.withColumn("k", F.sum(fresh.cast("int")).over(order)).groupBy("id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")

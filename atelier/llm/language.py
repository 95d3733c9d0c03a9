"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A model holds, for each language that occurs in the labelled rows, log probabilities of hashed byte trigrams of words
and the share of each script among its letters. It is counted on a bounded sample of the labelled documents: of each language all
rows up to `sample_docs`, beyond that as many in expectation (picked by a hash of the row's place, whole texts), so a rare language is
learnt at any size. Counting runs in parallel; only bucket sums reach the driver (languages x 2**BITS at most).

A word's candidates are the languages that use the script of its first letter; if none does, all stay. The path of
languages through a text's words maximises the sum of word scores less `penalty` for each change. The text's language
is the one with most bytes of words on the path (ties: the first in alphabetical order), its score their share.

Nulls and texts without a letter are `und` with score 0. Rows whose label or text is null teach nothing. Without any
labelled rows all is `und`. Empty tables give empty results. Up to 65,536 languages fit. Very long texts are labelled whole: a group of texts holds about 400,000 words
or one text. Repeated rows are judged alike. All columns of docs are kept, but one named as `result_col` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim, words

BITS, UND = 15, "und"
RESULT = "struct<lang: string, score: double>"
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])
SPANS = "array<struct<first: int, last: int, lang: string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

#: First code points of Unicode ranges and the script that each begins (0: none).
RANGES = (
    (0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0),
    (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x750, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 0), (0xB80, 11), (0xC00, 12),
    (0xC80, 13), (0xD00, 14), (0xD80, 15), (0xE00, 16), (0xE80, 17), (0xF00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 23), (0x3100, 0), (0x3130, 21), (0x3190, 0), (0x3400, 24), (0x4DC0, 0), (0x4E00, 24), (0xA000, 0), (0xAC00, 21), (0xD7B0, 0), (0xF900, 24), (0xFB00, 1), (0xFB07, 0), (0x20000, 24), (0x30000, 0),
)
SCRIPTS = 25
_STARTS = np.array([a for a, _ in RANGES])
_KINDS = np.array([b for _, b in RANGES])


def script(word: bytes) -> int:
    """Of a word's first letter; 0 if it has none. Words are lower-cased UTF-8."""
    for b in word[:1]:
        if 0x61 <= b <= 0x7A:
            return 1
    for c in word.decode("utf-8", "replace"):
        if c.isalpha():
            return int(_KINDS[np.searchsorted(_STARTS, ord(c), "right") - 1])
    return 0


def _trigrams(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of `<word>` for all tokens, and where each token's begin."""
    raw = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in tokens), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 2)
    code = (raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]
    keep = np.ones(len(raw), bool)
    keep[ends - 1] = keep[ends - 2] = False
    buckets = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)[keep[:-2]]
    return buckets, np.cumsum(sizes) - sizes


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 6_000) -> dict:
    """{langs, logp (languages x buckets), scripts (languages x scripts): whether it uses the script}."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    many = rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > sample_docs).collect()  # a line for each common language
    picked = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))  # by row, so that copies don't come together
    if many:
        most = F.create_map(*(F.lit(x) for r in many for x in (r["lang"], int(sample_docs / r["n"] * (1 << 30)))))
        rows = rows.where(picked < F.coalesce(most[F.col("lang")], F.lit(1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own := words(text.as_py()):
                    total = sums.setdefault(lang, np.zeros((1 << BITS) + SCRIPTS, np.int64))
                    total += np.bincount(_trigrams(own)[0], minlength=len(total))
                    total[1 << BITS :] += np.bincount([script(w) for w in own], minlength=SCRIPTS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    sums = np.zeros((len(langs), (1 << BITS) + SCRIPTS))
    place = {x: i for i, x in enumerate(langs)}
    sums[[place[x] for x in found["lang"].to_pylist()], found["bucket"].to_numpy().astype(np.int64)] = found["n"].to_numpy()
    counts, scripts = sums[:, : 1 << BITS] + 0.5, sums[:, 1 << BITS :]
    logp = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    return {"langs": langs, "logp": logp.astype(np.float32), "scripts": scripts >= 0.005 * scripts.sum(1, keepdims=True)}


class Scorer:
    """Per-word scores, kept for at most `bound` words, and the best path of languages through each text."""

    EXCLUDED = np.float32(-1e4)

    def __init__(self, model: dict, penalty: float, bound: int = 400_000):
        self.langs, self.penalty, self.bound = model["langs"], np.float32(penalty), bound
        self.kind = np.uint8 if len(self.langs) < 256 else np.uint16
        self.table, self.scripts = np.ascontiguousarray(model["logp"].T), model["scripts"]
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def learn(self, new: list[bytes]) -> None:
        buckets, begins = _trigrams(new)
        own = np.add.reduceat(self.table[buckets], begins, axis=0)
        kinds = np.fromiter(map(script, new), np.int64, len(new))
        allowed = self.scripts[:, kinds].T
        own = np.where(allowed | ~allowed.any(1, keepdims=True), own, self.EXCLUDED)
        own[kinds == 0] = 0
        self.at.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, own])

    def paths(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text, the language (its place) of every word. All texts go forward together, longest first."""
        if len(self.at) > self.bound:
            self.clear()
        if new := list({w for own in texts for w in own if w not in self.at}):
            self.learn(new)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        ids = [np.fromiter(map(self.at.__getitem__, texts[i]), np.int32, len(texts[i])) for i in order.tolist()]
        sizes, steps = sizes[order], int(sizes.max(initial=0))
        alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts that have a word t
        begins = np.concatenate([[0], np.cumsum(alive)])
        flat = np.empty(begins[-1], np.int32)  # word t of all texts that have one, then word t + 1
        for k, own in enumerate(ids):
            flat[begins[: len(own)] + k] = own
        best, back = np.zeros((len(texts), len(self.langs)), np.float32), np.empty((begins[-1], len(self.langs)), self.kind)
        stay = np.arange(len(self.langs), dtype=self.kind)
        for t in range(steps):
            n = alive[t]
            v = best[:n]
            top = v.argmax(1)
            jump = v[np.arange(n), top][:, None] - self.penalty
            take = jump > v
            back[begins[t] : begins[t + 1]] = np.where(take, top[:, None].astype(self.kind), stay)
            best[:n] = np.where(take, jump, v) + self.scores[flat[begins[t] : begins[t + 1]]]
        state, path = best.argmax(1), np.empty(begins[-1], self.kind)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            path[begins[t] : begins[t + 1]] = state[:n]
            state[:n] = back[begins[t] + np.arange(n), state[:n]]
        out: list[np.ndarray] = [np.empty(0, self.kind)] * len(texts)
        for k, i in enumerate(order.tolist()):
            out[i] = path[begins[: sizes[k]] + k]
        return out


def _groups(texts: list[str | None], most: int = 400_000) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Places and words of texts in groups of about `most` words, the longest texts first, so that few groups take many steps."""
    at, group, n = [], [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i] or "")):
        text = texts[i]
        at.append(i)
        group.append(words(text) if text and any(map(str.isalpha, text)) else [])
        n += len(group[-1])
        if n >= most:
            yield at, group
            at, group, n = [], [], 0
    if group:
        yield at, group


def _sent(docs: DataFrame, model: dict):
    if len(model["langs"]) > 1 << 16:
        raise ValueError("more languages than 16 bits can name")
    return docs.sparkSession.sparkContext.broadcast(model)


def _judge(docs: DataFrame, model: dict, text: Column, penalty: float, result_col: str) -> DataFrame:
    sent = _sent(docs, model)

    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value, penalty)
        for batch in batches:
            out = [{"lang": UND, "score": 0.0}] * len(batch)
            for at, group in _groups(batch.to_pylist()):
                paths = scorer.paths(group) if scorer.langs else []
                for i, own, path in zip(at, group, paths, strict=False):
                    if len(path):
                        bytes_of = np.bincount(path, np.fromiter(map(len, own), np.int64, len(own)), len(scorer.langs))
                        k = int(bytes_of.argmax())
                        out[i] = {"lang": scorer.langs[k], "score": float(bytes_of[k] / bytes_of.sum())}
            yield pa.array(out, _RESULT)
        del scorer
        trim()

    return docs.withColumn(result_col, judge(text))


def identify(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = 12.0, result_col: str = "language") -> DataFrame:
    """Adds struct `result_col` of lang and score."""
    return _judge(docs, model, F.col(text_col), penalty, result_col)


def label_spans(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = 12.0, result_col: str = "spans") -> DataFrame:
    """Adds array `result_col` of spans: first and last word (from 0) and language; empty for `und`."""
    sent = _sent(docs, model)

    @F.arrow_udf(SPANS)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value, penalty)
        for batch in batches:
            out: list[list[dict]] = [[]] * len(batch)
            for at, group in _groups(batch.to_pylist()):
                for i, path in zip(at, scorer.paths(group) if scorer.langs else [], strict=False):
                    cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
                    ends = [0, *cuts.tolist(), len(path)] if len(path) else []
                    out[i] = [{"first": a, "last": b - 1, "lang": scorer.langs[path[a]]} for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.array(out, _SPANS)

    return docs.withColumn(result_col, label(F.col(text_col)))

"""Language-model scores: a log-bilinear neural model over word classes, trained with noise-contrastive estimation.

Every word has a class: each of the FREQUENT most common training words its own, the others one of RARE by their last
two bytes, the end of a text one. Two context classes predict the next one: the score of class w is
(C1 * Q[h1] + C2 * Q[h2]) . R[w] + b[w], and its probability the exact softmax over all classes. A word within its class
has the smoothed share of its count, (c + 0.5) / (N_class + 0.5 (V_class + 1)), so that probabilities of all words, unseen ones
included, sum to one.

Counting covers all training texts: partial counts of each partition, then a grouped sum. Training covers them too: every
partition runs noise-contrastive steps in numpy over its texts from the same start, and the parameters are averaged by
token counts as grouped sums. The driver holds parameters of a fixed size and a cache of the most common words' counts, those whose count is
above the one where HOT words are reached (HOT is the cache's bound, it changes no result); the counts of all other words stay a table, joined to the words that need them. Normalisers are batched matrix products, one for each pair of context
classes, kept by the process.

Nulls: a null text is empty, its only token is the end. Rows whose training flag is null don't teach. Repeated rows teach
and are scored as often as they occur. Ties: of words with equal counts the lesser in byte order gets a class of its own. A very long text is
scored whole; 500 texts are held at a time. Without training rows N and V are 0 and the base score is 0.
Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FREQUENT, RARE, DIM, HOT = 1000, 63, 16, 200_000
CLASSES = 1 + FREQUENT + RARE  # class 0: the end of a text, and what stands before it
NOISE, BATCH = 128, 2048


def tokens(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased; the end is not listed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rare_class(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word[-2:]) % RARE


def count_words(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """word (binary), c: counts over all rows of column `text`. A task holds at most about `most` words before it hands them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) >= most:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Classes(dict):
    """Word -> class. Rare words are kept as they come, at most `bound` of all."""

    def __init__(self, frequent: list[bytes], bound: int = 400_000):
        self.frequent, self.bound = {w: 1 + i for i, w in enumerate(frequent)}, bound
        super().__init__(self.frequent)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
            self.update(self.frequent)
        self[word] = k = rare_class(word)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def start(unigram: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters that all partitions begin with: small noise, and biases at the classes' log shares."""
    rng = np.random.default_rng(20)
    q, r = (rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32) for _ in range(2))
    return {"Q": q, "R": r, "b": np.log(unigram).astype(np.float32), "C": np.ones((2, DIM), np.float32)}


def contexts(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two back, one back, next) for every class of every text, its end included; the end stands before a text."""
    flat = np.concatenate([x for s in streams for x in (np.zeros(2, np.int32), s, np.zeros(1, np.int32))])
    sizes = np.fromiter((len(s) + 3 for s in streams), np.int64, len(streams))
    own = np.ones(len(flat), bool)
    begins = np.cumsum(sizes) - sizes
    own[begins] = own[begins + 1] = False
    at = np.flatnonzero(own)
    return flat[at - 2], flat[at - 1], flat[at]


def _scatter(index: np.ndarray, grad: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(index, grad[:, d], CLASSES) for d in range(grad.shape[1])], 1).astype(np.float32)


def nce_gradient(p: dict[str, np.ndarray], h2: np.ndarray, h1: np.ndarray, w: np.ndarray, noise: np.ndarray, offset: np.ndarray) -> dict[str, np.ndarray]:
    """Of the noise-contrastive objective, the sum over words of log P(true) and over words and noise of log P(noise)."""
    q1, q2 = p["Q"][h1], p["Q"][h2]
    h = q1 * p["C"][0] + q2 * p["C"][1]
    true = 1 / (1 + np.exp(offset[w] - p["b"][w] - np.einsum("ij,ij->i", h, p["R"][w])))
    false = 1 / (1 + np.exp(offset[noise] - p["b"][noise] - h @ p["R"][noise].T))
    up = (1 - true)[:, None]
    to_h = up * p["R"][w] - false @ p["R"][noise]
    grad = {
        "R": _scatter(w, up * h),
        "b": np.bincount(w, 1 - true, CLASSES).astype(np.float32),
        "Q": _scatter(h1, to_h * p["C"][0]) + _scatter(h2, to_h * p["C"][1]),
        "C": np.stack([(to_h * q1).sum(0), (to_h * q2).sum(0)]),
    }
    np.subtract.at(grad["R"], noise, false.T @ h)
    np.subtract.at(grad["b"], noise, false.sum(0))
    return grad


def nce_steps(p: dict[str, np.ndarray], state: dict[str, np.ndarray], two: np.ndarray, one: np.ndarray, nxt: np.ndarray, unigram: np.ndarray, rng: np.random.Generator, rate: float = 0.05) -> None:
    """Ascends the noise-contrastive objective over batches, in place; steps are scaled by AdaGrad sums in `state`."""
    offset = np.log(NOISE * unigram).astype(np.float32)
    upto = np.cumsum(unigram)
    for lo in range(0, len(nxt), BATCH):
        h2, h1, w = two[lo : lo + BATCH], one[lo : lo + BATCH], nxt[lo : lo + BATCH]
        noise = np.searchsorted(upto, rng.random(NOISE) * (1 - 1e-9)).clip(0, CLASSES - 1)
        for k, g in nce_gradient(p, h2, h1, w, noise, offset).items():
            g /= len(w)
            state[k] += g * g
            p[k] += rate * g / np.sqrt(state[k] + 1e-10)


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each class, and two for the position weights: Q, R, b."""
    rows = np.concatenate([p["Q"], p["R"], p["b"][:, None]], 1)
    return np.concatenate([rows, np.pad(p["C"], ((0, 0), (0, DIM + 1)))])


def _back(rows: np.ndarray) -> dict[str, np.ndarray]:
    own = rows[:CLASSES].astype(np.float32)
    return {"Q": own[:, :DIM].copy(), "R": own[:, DIM : 2 * DIM].copy(), "b": own[:, -1].copy(), "C": rows[CLASSES:, :DIM].astype(np.float32)}


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """A model of all rows of docs. Its `counts` is a table (word, c) in the shared folder; all else is bounded."""
    texts = docs.select(F.col(text_col).alias("text"))
    spark = docs.sparkSession
    counts = stored(count_words(texts), "word-counts")
    n_docs = texts.count()
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n_words, n_kinds = total[0] or 0, total[1]

    left, least = HOT, 1 << 62  # the least count that the cache has room for
    for c, kinds in sorted((tuple(r) for r in counts.groupBy("c").agg(F.count("*")).collect()), reverse=True):  # as many rows as there are different counts
        left -= kinds
        if left < 0:
            break
        least = c
    hot = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).toArrow().to_pylist()}
    common = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow().to_pylist()}  # ties in order of the words
    hot |= common
    frequent = sorted(common)
    own = Classes(frequent)

    crc = F.crc32(F.expr("substring(word, -2, 2)")) % RARE + 1 + FREQUENT
    rare = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in frequent], "word binary")), "word", "left_anti")
    sums = {int(r["k"]): (r["n"], r["v"]) for r in rare.groupBy(crc.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    size = np.zeros(CLASSES)
    size[0] = n_docs
    for w, k in own.frequent.items():
        size[k] = hot[w]
    for k, (n, _) in sums.items():
        size[k] = n
    unigram = (size + 0.5) / (size + 0.5).sum()
    model = {
        "id": uuid4().hex, "frequent": frequent, "hot": hot, "unigram": unigram, "N": n_words + n_docs, "V": n_kinds + (n_docs > 0), "n_docs": n_docs,
        "rare": {k: sums.get(k, (0, 0)) for k in range(1 + FREQUENT, CLASSES)}, "params": start(unigram),
    }
    sent = spark.sparkContext.broadcast({k: model[k] for k in ("frequent", "unigram", "params")})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, unigram = Classes(sent.value["frequent"]), sent.value["unigram"]
        p = {k: v.copy() for k, v in sent.value["params"].items()}
        state, rng, n = {k: np.zeros_like(v) for k, v in p.items()}, np.random.default_rng(TaskContext.get().partitionId()), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                two, one, nxt = contexts([classes.of(tokens(t.as_py())) for t in batch.column(0).slice(lo, 500)])
                order = rng.permutation(len(nxt))
                nce_steps(p, state, two[order], one[order], nxt[order], unigram, rng)
                n += len(nxt)
        if n:
            rows = _flat(p).astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), n)), *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], names=["row", "n", *names])

    names = [f"x{i}" for i in range(2 * DIM + 1)]
    learnt = texts.mapInArrow(learn, ", ".join(["row long", "n long", *(f"{x} double" for x in names)]))
    mean = learnt.groupBy("row").agg(*((F.sum(x) / F.sum("n")).alias(x) for x in names)).toArrow()
    if mean.num_rows:
        rows = np.stack([mean[x].to_numpy() for x in names], 1)[np.argsort(mean["row"].to_numpy())]
        model["params"] = _back(rows)
    return model | {"counts": counts}


_TABLES: dict[str, np.ndarray] = {}


class Scorer:
    """log10 probabilities of class sequences; normalisers of context pairs are computed when first met."""

    def __init__(self, model: dict):
        self.p = model["params"]
        if model["id"] not in _TABLES:
            _TABLES.clear()
            _TABLES[model["id"]] = np.full(CLASSES * CLASSES, np.nan, np.float32)
        self.table = _TABLES[model["id"]]

    def normalise(self, pairs: np.ndarray) -> None:
        p = self.p
        for lo in range(0, len(pairs), 4096):
            some = pairs[lo : lo + 4096]
            h = p["Q"][some % CLASSES] * p["C"][0] + p["Q"][some // CLASSES] * p["C"][1]
            s = h @ p["R"].T + p["b"]
            top = s.max(1)
            self.table[some] = top + np.log(np.exp(s - top[:, None]).sum(1))

    def log10(self, streams: list[np.ndarray]) -> np.ndarray:
        """For each text the sum over its classes and its end."""
        two, one, nxt = contexts(streams)
        pairs = two.astype(np.int64) * CLASSES + one
        new = np.unique(pairs[np.isnan(self.table[pairs])])
        if len(new):
            self.normalise(new)
        p = self.p
        h = p["Q"][one] * p["C"][0] + p["Q"][two] * p["C"][1]
        s = np.einsum("ij,ij->i", h, p["R"][nxt]) + p["b"][nxt] - self.table[pairs]
        sizes = np.fromiter((len(x) + 1 for x in streams), np.int64, len(streams))
        return np.add.reduceat(s.astype(np.float64), np.cumsum(sizes) - sizes) / np.log(10)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (unigram) and score (the model), both log10; a row for each row."""
    spark = docs.sparkSession
    bound = {k: v for k, v in model.items() if k != "counts"}
    sent = spark.sparkContext.broadcast(bound)
    base_size, rare_size = model["N"] + 0.5 * (model["V"] + 1), {k: n + 0.5 * (v + 1) for k, (n, v) in model["rare"].items()}
    end = float(np.log10((model["n_docs"] + 0.5) / base_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        classes, scorer = Classes(m["frequent"]), Scorer(m)
        table = {w: i for i, w in enumerate(m["hot"])}
        c = np.fromiter(m["hot"].values(), np.float64, len(table))
        base = np.append(np.log10((c + 0.5) / base_size), 0.0)
        kind = np.append(classes.of(list(table)), 0)
        inner = np.append([0.0 if k <= FREQUENT else np.log10((n + 0.5) / rare_size[k]) for k, n in zip(kind.tolist(), m["hot"].values(), strict=False)], 0.0)
        none, row = len(table), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cut = batch.slice(lo, 500)
                streams, n, known, b, s, rows, words, times = [], [], [], [], [], [], [], []
                for k, text in enumerate(cut.column(1)):
                    own = tokens(text.as_py())
                    at = np.fromiter([table.get(w, none) for w in own], np.int64, len(own))
                    cls = kind[at]
                    n.append(len(own) + 1)
                    known.append(int((at < none).sum()) + (m["n_docs"] > 0))
                    b.append(base[at].sum() + end)
                    s.append(inner[at].sum())
                    if (seldom := np.flatnonzero(at == none)).size:
                        others = [own[i] for i in seldom.tolist()]
                        cls[seldom] = [rare_class(w) for w in others]
                        found = Counter(others)
                        rows += [row + k] * len(found)
                        words += found
                        times += found.values()
                    streams.append(cls)
                s = np.array(s) + scorer.log10(streams)
                ids = row + np.arange(cut.num_rows)
                row += cut.num_rows
                yield _batch(ids, cut.column(0), n, known, b, s, pa.nulls(len(ids), pa.binary()))
                if rows:
                    zero = np.zeros(len(rows))
                    yield _batch(rows, pa.nulls(len(rows), pa.int64()), times, zero.astype(np.int64), zero, zero, pa.array(words, pa.binary()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(texts.mapInArrow(run, "row long, doc_id long, n long, known long, base double, score double, word binary"), "scored")
    seldom = found.where("word is not null").select("row", "n", "word")
    crc = (F.crc32(F.expr("substring(word, -2, 2)")) % RARE).cast("int")
    sizes = F.element_at(F.array(*(F.lit(float(rare_size[1 + FREQUENT + i])) for i in range(RARE))), crc + 1)
    c = F.coalesce("c", F.lit(0))
    more = seldom.join(model["counts"], "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10((c + 0.5) / base_size)).alias("b"), F.sum(F.col("n") * F.log10((c + 0.5) / sizes)).alias("s")
    )
    whole = found.where("word is null").join(more, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return whole.select("doc_id", F.col("n").alias("n_tokens"), add("known", "k").cast("long").alias("n_known"), F.lit(model["N"]).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), add("score", "s").alias("score"))


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["row", "doc_id", "n", "known", "base", "score", "word"])

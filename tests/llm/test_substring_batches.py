"""The texts of a batch are worked on together, with the rows that each would have alone."""

import random

import numpy as np
import pyarrow as pa

from atelier.llm import substring_dedup as sd
from atelier.llm.common import Hashes


class Task:
    @staticmethod
    def get():
        return Task()

    def partitionId(self):
        return 3


def marked(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string())], names=["id", "doc_id", "text"])
    return [r for b in sd._marked(iter([batch])) for r in b.to_pylist()]


def odd_texts():
    rng = random.Random(6)
    new = lambda n: rng.choices([f"é{i}" for i in range(50)] + [f"W{i}" for i in range(300)], k=n)
    texts = [None, "", " \n", "a b c d", "a b c d e"]
    for n in (5, 17, 18, 19, 30, 50, 51, 52, 83, 84, 200, 900):
        texts += [rng.choice([" ", "\n", ", ", " 日本 "]).join(new(n)), None, "".join(w + rng.choice([" "] * 9 + ["\n"]) for w in new(n)), ""]
    return [*texts, "same " * 300, "so it goes " * 20, "\nx y z w v\n" * 40, "\U0001f600 q " * 30, "", None]


def test_work_does_not_grow_with_the_number_of_texts(monkeypatch):
    calls, mix = [], sd.mix
    monkeypatch.setattr(sd, "TaskContext", Task)
    monkeypatch.setattr(sd, "mix", lambda x: calls.append(1) or mix(x))
    rng, counts = random.Random(1), []
    for n in (5, 400):
        calls.clear()
        marked([" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(n)])
        counts.append(len(calls))
    assert counts[0] == counts[1] > 0


def test_rows_of_a_batch_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(sd, "TaskContext", Task)
    texts, order = odd_texts(), lambda r: (r["id"], not r["bands"], r["word"])
    alone = [r | {"id": i, "doc_id": i, "row": i} for i, t in enumerate(texts) for r in marked([t])]
    assert {r["id"] for r in alone} == {i for i, t in enumerate(texts) if len(sd.placed_words(t or "")[0]) >= sd.K}
    assert all(texts[r["id"]][r["start"] : r["end"]].lower().startswith(sd.placed_words(texts[r["id"]])[0][r["word"]].decode()) for r in alone)
    for size, cut in ((500, 2 << 20), (500, 700), (3, 2 << 20)):
        monkeypatch.setattr(sd, "TEXTS", size)
        monkeypatch.setattr(sd, "TEXT_BYTES", cut)
        assert sorted(marked(texts), key=order) == sorted(alone, key=order)


def test_anchors_are_the_least_of_their_windows():
    rng = np.random.default_rng(3)
    for _ in range(50):
        room = rng.integers(1, 90, 12)
        gaps = rng.integers(17, 22, 12)
        first = np.cumsum(room + gaps) - room - gaps
        g = rng.integers(1, 60, int((room + gaps).sum())).astype(np.uint64)
        want = set()
        for a, n in zip(first.tolist(), room.tolist(), strict=True):
            if n <= sd.WINDOW:
                want.add(a + int(g[a : a + n].argmin()))
            for x in range(a, a + n - sd.WINDOW + 1):
                own = g[x : x + sd.WINDOW]
                want |= set((x + np.flatnonzero(own == own.min())).tolist()) if n > sd.WINDOW else set()
        assert sd.anchors(g, first, room, sd.WINDOW).tolist() == sorted(want)


def test_hashes_are_those_of_the_words():
    low, sizes, _, _, _, counts = sd._placed(["Ab ab, é日\x00x".encode(), b"", b"\xff z"])
    assert low.split() == [b"ab", b"ab", "é日".encode(), b"x", b"\xff", b"z"] and counts.tolist() == [4, 0, 2]
    assert sd.hashed(low, sizes).tolist() == Hashes().of(low.split()).tolist()


def test_wide_gaps(spark):
    """Words more than 255 code points apart, in some seeds only."""
    passage = " ".join(f"p{j}" + " " * (300 if j in (3, 70) else 0) for j in range(90))
    own = lambda c: " ".join(f"{c}{j}" for j in range(60))
    docs = [(1, f"{own('a')} {passage} c d"), (2, f"é f g {passage} {own('h')}"), (3, own("x"))]
    rows = sd.removals(sd.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert [(r["id"], docs[1][1][r["start"] : r["end"]].split()) for r in rows] == [(2, passage.split())]

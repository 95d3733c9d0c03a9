import random
import re

import numpy as np

from atelier.llm import decontaminate as module
from atelier.llm.decontaminate import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own = split(text)
    hits, found = set(), set()
    for name, item in items:
        w = split(item)
        n = min(13, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for p in range(len(own) - n + 1 if n else 0):
            if tuple(own[p : p + n]) in wins:
                hits |= set(range(p, p + n))
                found.add(name)
    return len(own), len(hits), sorted(found - {None}), bool(hits) and 20 * len(hits) >= len(own)


def cases():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)] + ["É", "x9"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate((40, 13, 14, 12, 5, 1, 0, 25, 30))]
    items += [(20, None), (None, items[0][1][5:]), (3, items[3][1]), (21, "rep " * 40), (22, items[0][1].upper())]
    texts = [None, "", "...", "rep " * 300, "rep " * 12]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            w = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            parts += w[a : a + rng.randint(1, 30)] + rng.choices(vocab, k=rng.randint(0, 20))
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts).title())
    return items, texts + texts[:9]


def test_against_brute_force(spark, monkeypatch):
    items, texts = cases()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words, group in ((10**6, 200), (0, 200), (0, 2)):  # broadcast; by shuffles; by shuffles, with candidates in several groups
        monkeypatch.setattr(module, "ITEMS", group)
        got = decontaminate(docs, bench, broadcast_words=words).collect()
        assert len(got) == len(texts) and all(r["n_words"] == "clash" for r in got)
        for r in got:
            f = r["found"]
            bits = np.unpackbits(np.frombuffer(f["hits"], np.uint8), count=f["n_words"])
            assert bits.sum() == f["n_hit"] and len(f["hits"]) == -(-f["n_words"] // 8)
            assert (f["n_words"], f["n_hit"], f["items"], f["contaminated"]) == brute(r["text"], items), r["text"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).collect()[0]["found"]["n_hit"] == 0
    assert decontaminate(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(docs.limit(0), some, broadcast_words=0).count() == 0
    assert decontaminate(docs, some, broadcast_words=0).collect()[0]["found"]["n_hit"] == 3

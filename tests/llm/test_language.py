import random
from itertools import product

import numpy as np

from atelier.llm import language

LEX = {"en": "the and house water under light words there".split(), "de": "und das haus wasser unter licht wörter über straße".split(), "ru": "дом вода под свет слова там".split()}


def labelled(spark, n=60):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(LEX[k], k=30)), k) for i, k in enumerate(list(LEX) * n)]
    return spark.createDataFrame([*rows, (1000, None, "en"), (1001, "the", None), (1002, "...", "en")], "doc_id long, text string, lang string")


def test_held_out_and_defined_results(spark):
    model = language.train(labelled(spark))
    assert model["langs"] == ["de", "en", "ru"]
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choices(LEX[k], k=12)).upper()) for k in LEX for _ in range(20)]
    texts += [("und", None), ("und", ""), ("und", "123 ... !"), ("en", "the house " * 20000)]
    docs = spark.createDataFrame([(t, k, 1.0) for k, t in texts], "text string, want string, score double")
    for r in language.identify(docs, model).collect():
        assert r["language"]["lang"] == r["want"] and 0 <= r["language"]["score"] <= 1


def test_spans_of_mixed_text(spark):
    model = language.train(labelled(spark))
    text = "the house and water there words " * 3 + "дом вода слова " * 3 + "und das wasser über licht haus " * 3
    (row,) = language.label_spans(spark.createDataFrame([(text,)], "text string"), model).collect()
    assert [(s["first"], s["last"], s["lang"]) for s in row["spans"]] == [(0, 17, "en"), (18, 26, "ru"), (27, 44, "de")]


def test_path_is_the_best_of_all(spark):
    model = language.train(labelled(spark))
    scorer = language.Scorer(model, 3.0)
    rng = random.Random(9)
    texts = [[w.encode() for w in rng.choices(sum(LEX.values(), []), k=n)] for n in (0, 1, 3, 6, 2, 6, 5)]
    for own, path in zip(texts, scorer.paths(texts), strict=True):
        e = np.array([scorer.scores[scorer.at[w]] for w in own])
        value = lambda p, e=e: sum(e[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert len(path) == len(own) and (not own or value(path.tolist()) >= max(map(value, product(range(3), repeat=len(own)))) - 1e-3)


def test_empty(spark):
    none = labelled(spark).limit(0)
    model = language.train(none)
    assert language.identify(none, model).count() == 0
    assert [r["language"]["lang"] for r in language.identify(spark.createDataFrame([("abc",)], "text string"), model).collect()] == ["und"]


def test_more_languages_than_a_byte_names(spark):
    """300 languages with a word each; a language with one row is learnt beside one with many."""
    name = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" * 3
    rows = [(f"l{i:03d}", f"{name(i)} " * 20) for i in range(300)] + [("l000", f"{name(0)} " * 20)] * 500
    model = language.train(spark.createDataFrame(rows, "lang string, text string"), sample_docs=20)
    assert len(model["langs"]) == 300
    asked = spark.createDataFrame([(f"l{i:03d}", f"{name(i)} " * 10) for i in range(300)], "want string, text string")
    got = language.identify(asked, model).collect()
    assert sum(r["language"]["lang"] == r["want"] for r in got) >= 295


def test_trigram_scores_against_brute_force(spark):
    model = language.train(labelled(spark), sample_docs=10_000)
    bucket = lambda t: ((t[0] << 16 | t[1] << 8 | t[2]) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - language.BITS)
    grams = lambda w: [bucket((b"\x02" + w + b"\x03")[i : i + 3]) for i in range(len(w))]
    seen = {k: np.full(1 << language.BITS, 0.5) for k in model["langs"]}
    for r in labelled(spark).collect():
        if r["lang"] and r["text"]:
            for w in r["text"].lower().encode().split():
                if w != b"...":
                    for b in grams(w):
                        seen[r["lang"]][b] += 1
    scorer = language.Scorer(model, 3.0)
    for word in ("wasser", "house", "licht"):
        scorer.learn([word.encode()])
        got = scorer.scores[scorer.at[word.encode()]]
        for k, lang in enumerate(model["langs"]):
            if lang != "ru":
                assert abs(got[k] - sum(np.log(seen[lang][b] / seen[lang].sum()) for b in grams(word.encode()))) < 1e-2
            else:
                assert got[k] == language.Scorer.EXCLUDED

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atelier.llm import packing, token_files
from atelier.llm.common import scratch
from atelier.llm.queries import tokenizer
from atelier.llm.tokens import _PIECES, Encoder, pieces_of

pieces = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x1f", "\x85", " ", " ", "​", "　", "it's", "Don't", "é", "é", "Ünï", "12", "3.4", "!!", "###", "ﬁ", "中文", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a<|endoftext|>b", "İ", "Σ", "\x00", "😀"])
FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


@pytest.mark.parametrize("name,keep", FILES)
def test_equals_the_library(name, keep):
    own, whole = Encoder(tokenizer(name), 0, keep), plain(name)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.lists(pieces, max_size=14).map("".join), st.text(max_size=40)))
    def same(text):
        got = np.frombuffer(own(text), own.dtype).tolist()
        assert got == [*whole.encode(text, add_special_tokens=False).ids, 0]

    same()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b\x0cab\u00a0\u2009\u3000é中x"), max_size=12), max_size=6))
def test_pieces_of_many_texts(texts):
    pieces, ends = pieces_of(texts)
    flat = pieces.to_pylist()
    assert [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)] == [_PIECES.findall(t) for t in texts]


def test_a_piece_is_looked_up_once_a_call():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    own, whole = Encoder(tokenizer("byte_bpe_50k.json"), 0, True), plain("byte_bpe_50k.json")
    own.known, texts = Counted(), ["a b " * 5000, None, "", "b a\u00a0b\n a  b", "a <|endoftext|> b", "b " * 3000]
    got = [np.frombuffer(x, own.dtype).tolist() for x in own.many(texts)]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert own.known.asked < 20


def test_chunks_of_texts():
    texts = pa.array(["aaa", None, "", "é", "b" * 50, "c"])
    assert list(token_files.chunks(texts, 5)) == [(0, 4), (4, 5), (5, 6)]
    assert list(token_files.chunks(texts.slice(1, 3), 1)) == [(0, 2), (2, 3)] and list(token_files.chunks(texts[:0])) == []


@pytest.mark.parametrize("name,keep", FILES)
def test_special_tokens_as_text(name, keep):
    whole = plain(name)
    whole.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "  <|endoftext|>", "<|startoftext|>x"):
        own = Encoder(tokenizer(name), 0, keep, special_as_text=True)
        assert np.frombuffer(own(text), own.dtype).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


def test_files_read_by_ranges(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    uri = scratch(spark, "t")
    monkeypatch.setattr(token_files, "SHARD", 2000)
    manifest = token_files.write_tokens(docs, uri, tokenizer("byte_bpe_50k.json"))
    mapped = [token_files.map_shard(uri, s) for s in manifest["shards"]]
    monkeypatch.setattr(token_files, "mounted", lambda uri: None)
    for s, arrays in zip(manifest["shards"], mapped, strict=True):
        for a, b in zip(arrays, token_files.map_shard(uri, s), strict=True):
            assert len(a) == len(b) and (a[:] == b[:]).all() and (a[1:3] == b[1:3]).all()


ROWS = [(5, "Hello there, world", "x"), (1, None, "y"), (None, "no id", None), (3, "", ""), (5, "Hello there, world", "x"), (5, "other text", "x"), (2, "a b " * 5000, None), (4, "a <|endoftext|> b", None)]


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    uri = scratch(spark, "t")
    manifest = token_files.write_tokens(docs, uri, tokenizer("byte_bpe_50k.json"))
    got = sorted(token_files.read_tokens(spark, uri).collect(), key=lambda r: r["start"])
    t, at = plain("byte_bpe_50k.json"), 0
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 5]
    texts = {1: [""], None: ["no id"], 3: [""], 2: ["a b " * 5000], 4: ["a <|endoftext|> b"], 5: ["Hello there, world"] * 2 + ["other text"]}
    left = {k: sorted(zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for x in v) for k, v in texts.items()}
    for r in got:
        assert r["start"] == at
        left[r["doc_id"]].remove(r["ids_crc32"])
        at += r["n_tokens"]
    assert not any(left.values()) and manifest["n_tokens"] == at


def test_packing_covers_every_id_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, offset string")
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"), end=2, length=64)
    got = pieces.collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for k, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or k == len(by) - 1
    assert sum(r["length"] for r in got) == sum(len(plain("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    one = b"".join(r["ids"] for r in sorted((r for r in got if r["doc_id"] == 2), key=lambda r: r["start"]))
    assert np.frombuffer(one, "<u2").tolist() == [*plain("word_bpe_49k.json").encode("a b " * 5000, add_special_tokens=False).ids, 2]
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, 64).collect()}
    n = sum(r["length"] for r in got) % 64
    assert len(whole[0]["ids"]) == 128 and len(whole[len(by) - 1]["ids"]) == (128 if n & (n - 1) else 2 * n or 128)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    uri = scratch(spark, "t")
    assert token_files.write_tokens(docs, uri, tokenizer("byte_bpe_50k.json"))["shards"] == []
    assert token_files.read_tokens(spark, uri).count() == 0
    assert packing.pack(docs, tokenizer("word_bpe_49k.json"), end=2).count() == 0

"""Ids of public tokenizers, fast: a text is cut at white space into pieces that encode alone, and ids of pieces are kept.

The tokenizers library encodes every new piece of a task once, many in one call; a text with odd separators or with the string of an added
token (such as `<|endoftext|>`) goes to the library whole. The ids equal those of the library for the whole text
(tests/llm/test_tokens.py compares them): the string of a special token becomes that token, as the library has it, unless
`special_as_text` is set.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property
from itertools import accumulate, chain, islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa

#: Control characters on whose being white space the library and Python differ.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: In a text of lesser characters, composing changes nothing and lower case is one character for one.
_WIDE = re.compile("[\u0130-\U0010ffff]")
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space of several bytes, and bytes that are white space alone.
_FAR = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


#: Pieces that a process keeps, at some 200 bytes each.
KNOWN = 1_200_000


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def pieces_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts as _PIECES cuts them, and before which of them each text begins (and the last one ends)."""
    held = pa.array(texts, pa.large_string())
    edges = np.frombuffer(held.buffers()[1], np.int64)[: len(texts) + 1]
    if not edges[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8)[: edges[-1]]
    space, mark = _SPACE[data], np.zeros(len(data) + 1, bool)
    mark[1:-1] = space[1:] & ~space[:-1]
    words = space[:-1] & ~space[1:]  # between a word and white space before it
    begins = edges[:-1][np.diff(edges) > 0]
    words[begins[1:] - 1] = False
    mark[:-2] |= words  # of white space the last character stands apart, or with the word if it is a blank
    mark[1:-1] |= words & (data[:-1] != 32)
    mark[begins] = True
    for i, t in enumerate(texts):
        if not t.isascii() and _FAR.search(t):
            mark[edges[i] : edges[i + 1]] = False
            sizes = np.fromiter((len(p.encode()) for p in _PIECES.findall(t)), np.int64)
            mark[edges[i] + np.cumsum(sizes) - sizes] = True
    mark[-1] = True
    starts = np.flatnonzero(mark)
    cuts = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), held.buffers()[2]])
    return cuts, np.searchsorted(starts, edges)


class Encoder:
    """Text -> ids of the tokenizer file at `path` as bytes of `dtype`, plus one end id.

    `keep_spaces`: a piece carries the one blank before it (byte-level files); else white space is dropped.
    `special_as_text`: strings of special tokens in a text are encoded as ordinary text. At most `bound` pieces are kept.
    """

    def __init__(self, path: str, end: int, keep_spaces: bool, bound: int = KNOWN, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.special_as_text = path, special_as_text
        if keep_spaces:
            self.plain = self.tokenizer
        else:  # for texts that its normaliser would leave as they are; the whole one is made when a text needs it
            self.plain = Tokenizer.from_str(json.dumps(_json(path) | {"normalizer": None}))
            self.plain.encode_special_tokens = special_as_text
        size = max(self.plain.get_vocab_size(), end + 1)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end], self.dtype).tobytes()
        self.sizes = np.zeros(size, np.int64)  # bytes that an id stands for
        for token, i in self.plain.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token) - (0 if keep_spaces or not token.endswith("</w>") else 4)
        self.keep_spaces, self.bound, self.known = keep_spaces, bound, {}
        added = [t.content for t in self.plain.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = self.special_as_text
        return whole

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids; the new pieces of all texts are encoded in one call."""
        whole = [bool(t) and bool(_ODD.search(t) or self.added.search(t)) for t in texts]
        given, kept = texts, ["" if w else t or "" for t, w in zip(texts, whole, strict=True)]
        if self.keep_spaces:
            cuts, ends = pieces_of(kept)
            coded = cuts.dictionary_encode()  # a piece is looked up once a call, however often it stands there
            flat = pa.array(self._found(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            at, raw = (np.frombuffer(b or b"\0" * 8, np.int64 if i == 1 else np.uint8) for i, b in enumerate(flat.buffers()) if i)
            out = [raw[a:b].tobytes() for a, b in zip(at[ends].tolist(), at[ends[1:]].tolist(), strict=False)]
        else:  # such files lower-case; doing it first makes fewer pieces differ
            pieces = [(t.lower() if t.isascii() or not _WIDE.search(t) else t).split() for t in kept]
            ids = self._found(list(chain.from_iterable(pieces)))
            stops = list(accumulate(map(len, pieces), initial=0))
            out = [b"".join(ids[a:b]) for a, b in zip(stops, stops[1:], strict=False)]
        return [(self._ids(t) if w else x) + self.end for t, w, x in zip(given, whole, out, strict=True)]

    def _found(self, flat: list[str]) -> list[bytes]:
        """The ids of each piece; those not known are encoded together."""
        ids = list(map(self.known.get, flat))
        if missing := [i for i, x in enumerate(ids) if x is None]:
            new = list({flat[i] for i in missing})
            own = dict(zip(new, self._together(new) or self._apart(new), strict=True))
            for i in missing:
                ids[i] = own[flat[i]]
            if len(self.known) + len(own) > self.bound:  # the newer half stays
                self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            self.known.update((p, x) for p, x in own.items() if len(p) <= 64)
        return ids

    def _apart(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes] | None:
        """The pieces as one text, which is cut again by the bytes that its ids stand for; None if cuts fall within an id."""
        if self.keep_spaces:
            blank = [i for i, p in enumerate(pieces) if p.isspace()]
            parts = [p if p[0] == " " else "\n" + p for p in pieces]
            for i in blank:
                parts[i] = ""
            skip = np.fromiter((q[:1] == "\n" for q in parts), np.int64, len(parts))
            sizes = np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts))
        else:
            blank, skip = [], 0
            parts = [" " + p for p in pieces]
            own = pieces if all(map(str.isascii, pieces)) else [p if p.isascii() else normalize("NFC", p).lower() for p in pieces]
            sizes = np.fromiter(map(len, map(str.encode, own)), np.int64, len(pieces))
        text = "".join(parts)
        plain = self.keep_spaces or not _WIDE.search(text) and text == text.lower()
        (whole,) = (self.plain if plain else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(whole.ids, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        stops = np.cumsum(sizes)
        lo, hi = np.searchsorted(ends, stops - sizes + skip), np.searchsorted(ends, stops)
        if ends[-1] != (stops[-1] if len(stops) else 0) or (ends[lo] != stops - sizes + skip).any() or (ends[hi] != stops).any():
            return None
        raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        out = [raw[a:b] for a, b in zip((lo * width).tolist(), (hi * width).tolist(), strict=True)]
        for i, ids_of in zip(blank, self._apart([pieces[i] for i in blank]), strict=True):
            out[i] = ids_of
        return out


_KEPT: dict[tuple, Encoder] = {}


def encoder(path: str, end: int, keep_spaces: bool, bound: int = KNOWN, special_as_text: bool = False) -> Encoder:
    """The Encoder of this process: later tasks of a worker know the pieces of earlier ones."""
    key = (path, end, keep_spaces, bound, special_as_text)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(*key)
    return _KEPT[key]

"""Encoding whole texts with the tokenizers library, word by word where that is exact."""

from __future__ import annotations

import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa

from .common import LOWER, filled, ragged, text_bytes, word_spans

#: Distinct words whose ids a worker remembers; beyond that it starts afresh (memory only, never results).
REMEMBERED = 500_000

#: By byte: marks that a run of letters or digits never holds, ASCII letters and digits.
MARKS, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
MARKS[[*b",.;:!?"]] = True
ALNUM[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
#: Words of lower-case letters up to U+00FF, and the letters by which byte-level files write the bytes that have no letter of their own.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _latin(raw: np.ndarray) -> np.ndarray:
    """Where a letter from U+00C0 to U+00FF ends; two of these code points are signs."""
    out = np.zeros(len(raw), bool)
    out[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    return out


def _near(raw: np.ndarray, byte: int) -> np.ndarray | None:
    found = raw == byte
    return found if found.any() else None


_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's own encoder of that file: loaded once a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """ids of texts, as tokenizers gives them without added special tokens.

    Where the pre-tokenizer drops white space, no pre-token spans two words, so a text's ids are its words' ids in
    order; distinct words are encoded once by the library and then looked up. Other files encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = self.tok.pre_tokenizer
        self.by_word = pre is not None and [p for p, _ in pre.pre_tokenize_str(" a\t\n b ")] == ["a", "b"]
        probe = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        self.folds = self.by_word and probe("Ab1Q,. x:Z! \xc9L\xd6;?") == probe("ab1q ,. x :z ! \xe9l\xf6 ;?") and [p for p, _ in pre.pre_tokenize_str("ab,.;:!?cd1.")] == ["ab", ",.;:!?", "cd", "1", "."]
        if self.folds:
            self.folds = all(probe(w) == [t.id for t in self.tok.model.tokenize(w.encode().decode("latin-1").translate(BYTE_LETTERS))] for w in ("word", "\xe9l\xe8ve", "stra\xdfe", "\xff\xe0\xef", "zzqxj"))
        self._forget()

    def _forget(self):
        """Forgets what was met in one chunk only, or all if that is too little; arrays are by a word's number in `at`."""
        old = getattr(self, "at", {})
        kept = [(w, i) for w, i in old.items() if self.hits[i] > 1] if old else []
        if len(kept) > REMEMBERED // 2:
            kept = []
        size = max(1024, 2 * len(kept))
        starts, lens = np.zeros(size, np.int64), np.zeros(size, np.int64)
        flat = np.zeros(1 << 16, np.uint32)
        if kept:
            at = np.fromiter((i for _, i in kept), np.int64, len(kept))
            lens[: len(kept)] = self.lens[at]
            flat = self.flat[ragged(self.starts[at], self.lens[at])]
            starts[: len(kept)] = np.cumsum(self.lens[at]) - self.lens[at]
        self.at = {w: n for n, (w, _) in enumerate(kept)}
        self.starts, self.lens, self.flat, self.used = starts, lens, flat, len(flat) if kept else 0
        self.hits = np.zeros(size, np.int32)

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """The library's ids of each word. One pre-token of lower-case letters goes to its model directly: normalizer and pre-tokenizer leave it as it is but for the letters that stand for bytes."""
        if not self.folds:
            return [e.ids for e in self.tok.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
        plain, model = PLAIN.fullmatch, self.tok.model.tokenize
        got = [[t.id for t in model(w.decode("latin-1").translate(BYTE_LETTERS))] if plain(w) else None for w in words]
        rest = [i for i, x in enumerate(got) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([words[i].decode("utf-8") for i in rest], add_special_tokens=False)):
            got[i] = e.ids
        return got

    def _learn(self, words: list[bytes]):
        got = self._ids(words)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        n, total = len(self.at), int(lens.sum())
        while n + len(got) > len(self.lens):
            self.starts, self.lens, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.hits))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.starts[n : n + len(got)] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + len(got)] = lens
        self.used += total
        for i, w in enumerate(words):
            self.at[w] = n + i

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's (null: empty)."""
        if not self.by_word:
            got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(filled(texts).to_pylist(), add_special_tokens=False)]
            return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.fromiter(map(len, got), np.int64, len(got))
        pieces, offsets = self.pieces(texts)
        if len(pieces) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pieces.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.at) > REMEMBERED:
            self._forget()
        if new := [w for w in keys if w not in self.at]:
            self._learn(new)
        place = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        self.hits[place] += 1
        place = place[coded.indices.to_numpy()]
        lens = self.lens[place]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return self.flat[ragged(self.starts[place], lens)], np.diff(ends[offsets])

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of the texts that are encoded on their own, and the number of pieces before each text (one more entry than texts)."""
        raw, ends = text_bytes(texts)
        starts, stops, _ = word_spans(raw, ends)
        if self.folds:
            # A run of marks after a letter or digit is no part of that pre-token: cut before it.
            mark = MARKS[raw]
            cut = np.zeros(len(raw), bool)
            cut[1:] = mark[1:] & (ALNUM[raw[:-1]] | _latin(raw)[:-1])
            cut[ends[:-1][ends[:-1] < len(raw)]] = False
            cuts = np.flatnonzero(cut)
            starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
            raw = raw if (special := _near(raw, ord("<"))) is None else raw.copy()
            lower = LOWER[raw]
            if special is not None:  # words that may hold a special token's string stay as they are
                odd = np.zeros(len(raw) + 1, np.int32)
                np.cumsum(special, out=odd[1:])
                for i in np.flatnonzero(odd[stops] > odd[starts]):
                    lower[starts[i] : stops[i]] = raw[starts[i] : stops[i]]
            raw = lower
        offsets = np.searchsorted(starts, ends)
        lens = stops - starts
        data = raw[ragged(starts, lens)] if len(starts) else raw[:0]
        at = np.concatenate([[0], np.cumsum(lens)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]), offsets

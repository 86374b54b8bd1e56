"""Token counts by rank-synchronous array merging (operator 10).

Pre-tokens of many words are one ragged array of symbols, with the number of its sequence beside each. A step finds every
sequence's pair of lowest rank and merges all its places at once (in a run of equal symbols: every second, from the
left); sequences without a ranked pair are done. What is left are the tokens, and only their number is kept.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer, text_bytes, text_chunks, word_spans

#: Distinct words whose counts a worker remembers; beyond that it starts afresh (memory only, never results).
REMEMBERED = 700_000

_counters: dict[str, "Counter"] = {}


class Merges:
    """Merge ranks as sorted arrays: pair -> (rank, new symbol)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix, self.vocab = suffix, vocab
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = [chr(c) for c in range(0x250)]
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)

    def symbols(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all pre-tokens in byte letters, and the sequence of each; letters that the vocabulary lacks go, as in the library."""
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        seq = np.repeat(np.arange(len(tokens)), lens)
        out = self.inner[points]
        ends = np.cumsum(lens)[lens > 0] - 1
        out[ends] = self.last[points[ends]]
        known = out >= 0
        return out[known], seq[known]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols that survive in each pre-token."""
        sym, seq = self.symbols(tokens)
        done = np.zeros(len(tokens), np.int64)
        none = np.iinfo(np.int64).max
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (seq[:-1] == seq[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            begins = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(rank, begins)
            size = np.diff(np.append(begins, len(seq)))
            over = low == none
            done[seq[begins[over]]] = size[over]
            lowest = np.repeat(low, size)
            go = (rank == lowest) & (lowest != none)
            # A pair of equal symbols overlaps itself: of a run of places every second one, from the left, is merged.
            run = np.flatnonzero(go)
            if len(run) > 1 and (near := np.diff(run) == 1).any():
                first = np.maximum.accumulate(np.where(np.append(True, ~near), np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - first) % 2 == 0]
            sym[run] = self.made[rank[run]]
            keep = np.repeat(~over, size)
            keep[run + 1] = False
            sym, seq = sym[keep], seq[keep]
        return done


class Counter:
    """Tokens of words: normalizer and pre-tokenizer of the file's own library, merges by arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("rank-synchronous merging counts plain BPE files")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        if [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(" a\t\n b ")] != ["a", "b"]:
            raise ValueError("words are counted one by one, so the pre-tokenizer must drop white space")
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.known: dict[bytes, int] = {}

    def _learn(self, words: list[bytes]):
        """Counts of new words: all their pre-tokens are merged together."""
        tokens: list[str] = []
        owner: list[int] = []
        extra = np.zeros(len(words), np.int64)
        parts, whose = [], []
        for i, w in enumerate(words):
            text = w.decode("utf-8")
            if self.added and "<" in text and (found := self.added.findall(text)):
                extra[i] = len(found)
                for p in self.added.split(text):
                    parts.append(p)
                    whose.append(i)
            else:
                parts.append(text)
                whose.append(i)
        # White space ends every pre-token, so parts may go through the library joined by it.
        normal = [self.tok.normalizer.normalize_str(p) if not p.isascii() else p.lower() if self.lowers else p for p in parts] if self.tok.normalizer else parts
        lens = np.fromiter(map(len, normal), np.int64, len(normal))
        begins = np.cumsum(lens + 1) - lens - 1
        found = self.tok.pre_tokenizer.pre_tokenize_str(" ".join(normal))
        tokens = [t for t, _ in found]
        spots = np.fromiter((o[0] for _, o in found), np.int64, len(found))
        owner = np.asarray(whose, np.int64)[np.searchsorted(begins, spots, side="right") - 1] if len(found) else np.zeros(0, np.int64)
        counts = np.bincount(owner, weights=self.merges.count(tokens), minlength=len(words)).astype(np.int64) + extra if len(found) else extra
        self.known.update(zip(words, counts.tolist()))

    @property
    def lowers(self) -> bool:
        """Whether the normalizer only lower-cases ASCII words."""
        if not hasattr(self, "_lowers"):
            probe = "".join(chr(c) for c in range(33, 127))
            self._lowers = self.tok.normalizer.normalize_str(probe) == probe.lower()
            if not self._lowers and self.tok.normalizer.normalize_str(probe) != probe:
                raise ValueError("a normalizer that rewrites ASCII words")
        return self._lowers

    def count(self, texts: pa.Array) -> np.ndarray:
        raw, ends = text_bytes(texts)
        starts, stops, offsets = word_spans(raw, ends)
        if len(starts) == 0:
            return np.zeros(len(texts), np.int64)
        # All words and the gaps between them as one binary array; the gaps are skipped by taking every second value.
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[0::2], bounds[1::2] = starts, stops
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = spans.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in keys if w not in self.known]
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        counts = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[coded.indices.to_numpy()]
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text: one pass, no exchange.

    Null and empty texts have no bytes and no tokens; very long texts are counted whole, alone in their task's memory.
    Repeated rows, rows of one id and rows without an id each give a row; an empty table gives an empty one; other columns
    are ignored, whatever their names. A tokenizer file of another kind than word-level merges raises ValueError.
    """
    path = tokenizer or default_tokenizer()

    def rows(batches):
        if path not in _counters:
            _counters[path] = Counter(path)
        for chunk in text_chunks(batches, "t"):
            n = _counters[path].count(chunk.column("t"))
            size = pc.fill_null(pc.binary_length(chunk.column("t")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([chunk.column("i").cast(pa.int64()), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")

"""What several operators share: word splitting and hashing in Arrow, components."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 3 << 20

#: Odd multiplier of rolling sums over words.
BASE = np.uint64(0x9E3779B97F4A7C15)


def width(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: what the session is tuned to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches, text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 20):
    """Slices record batches so that each holds about `limit` bytes of text and at most `rows` rows (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            to = min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to


def filled(texts: pa.Array) -> pa.Array:
    """Large strings without nulls."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts one after the other, and where each starts (one more entry than texts)."""
    texts = filled(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


#: By byte: ASCII white space.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the number of words before each text (one more entry than texts)."""
    return word_spans_of(raw, ends, SPACES)


def word_spans_of(raw: np.ndarray, ends: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words that the bytes marked in `breaks` part."""
    inside = np.zeros(len(raw) + 1, bool)
    np.logical_not(breaks[raw], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cuts = ends[:-1][ends[:-1] < len(raw)]
    first[cuts] = inside[cuts]  # a text's first byte starts a word though the text before ends in one
    last = inside[:-1] & ~inside[1:]
    cuts = ends[1:][ends[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


#: A random 64-bit value for every byte, and the base of the polynomial that joins them.
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int):
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _STEP), np.full(size, _BACK)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def hashed_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of the bytes: differences of one running polynomial, shifted to a common origin and mixed with the length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)


#: By byte: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words before each text (one more entry than texts). lower: A-Z count as a-z."""
    raw, ends = text_bytes(texts)
    if lower:
        raw = LOWER[raw]
    starts, stops, offsets = word_spans(raw, ends)
    return hashed_spans(raw, starts, stops), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, position by position (len - k + 1 of them), in log2(k) passes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, span, have, factor = hashes, 1, None, BASE
        done, bits = 0, k
        while bits:
            if bits & 1:
                part = power[done : done + n]
                shift = np.uint64(pow(int(BASE), span, 1 << 64))
                have = part.copy() if have is None else have * shift + part
                done += span
            bits >>= 1
            if bits:
                power = power[: len(power) - span] * np.uint64(pow(int(BASE), span, 1 << 64)) + power[span:]
                span *= 2
        return mix(have)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges [start, start + len), one after the other."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)


def arrow_strings(values) -> pa.Array:
    return pa.array(values, pa.string())


#: Edges that one task connects: 16 MB of numbers, whatever the corpus.
ONE_TASK = 1 << 20


def _forest(batches):
    """Of edges (a, b): for every node there but the least of its component, an edge to that. What a task holds is numpy arrays of its edges."""
    every = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not every:
        return
    edges = np.concatenate(every, axis=1)
    nodes, index = np.unique(edges, return_inverse=True)
    a, b = index.reshape(edges.shape)
    root = np.arange(len(nodes))
    while True:  # hang every root below the least root that an edge leads to, then shorten ways
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def components(edges: DataFrame, limit: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Smallest node reachable from every node of `edges` (a, b): rows (node, component).

    Each task first replaces the edges that it holds by a forest that connects the same nodes. If no more than `one_task`
    edges are left, one task finishes them. Else large-star and small-star steps alternate until nothing moves: a step is an
    aggregation (combined before its shuffle) and a join back; the aggregate is written first, so both sides of the join
    are plain exchanges and adaptive execution splits a hot node. Nothing is collected. Null ends and loops carry no link.
    A component of one node only is not returned.
    """
    kind = "a bigint, b bigint"
    some = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    cur = materialize(some.mapInArrow(_forest, kind), "edges")
    if cur.count() <= one_task:
        old, cur = cur, materialize(cur.coalesce(1).mapInArrow(_forest, kind), "star")
        discard(old)
    else:
        cur = _stars(cur, limit)
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = materialize(cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
    discard(cur)
    return found


def _stars(edges: DataFrame, limit: int) -> DataFrame:
    """Edges from every node to the least of its component, by large-star and small-star steps over a written table, which goes."""
    cur = edges
    seen = None
    for _ in range(limit):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        small_min = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_min, "a")
        nxt = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        old, cur = cur, materialize(nxt, "star")
        discard(old, least, large, small_min)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return cur
        seen = now
    raise RuntimeError("components did not settle")


def default_tokenizer() -> str:
    """Place of the word-level BPE file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

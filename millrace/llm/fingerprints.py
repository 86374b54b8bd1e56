"""Document fingerprints by one-permutation MinHash (operator 2).

Every shingle of five words is hashed once: the upper bits choose one of the bins, and a bin keeps its least hash. An
empty bin takes the value of the first non-empty bin in a random order of its own (optimal densification), and of every
bin only the low-order bits are stored. Two fingerprints agree in a bin with probability J + (1 - J) / 2**bits, which
the likeness is corrected for.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import BASE, hashed_words, mix, text_chunks, width, window_hashes

BINS, BITS, SHINGLE = 512, 4, 5

#: Documents whose bins a worker holds at a time.
ROWS = 1500


@lru_cache(maxsize=4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its random order of all bins, and every bin's place in it."""
    with np.errstate(over="ignore"):
        keys = mix(np.arange(bins * bins, dtype=np.uint64) * BASE + np.uint64(7)).reshape(bins, bins)
    order = np.argsort(keys, axis=1, kind="stable")
    return order.astype(np.int32), np.argsort(order, axis=1, kind="stable").astype(np.int32)


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of all texts, and the text of each. Fewer words: the whole sequence is one; none: none."""
    words, offsets = hashed_words(texts)
    n = np.diff(offsets)
    count = np.maximum(n - k + 1, 0)
    out, owner = window_hashes(words, k), np.repeat(np.arange(len(n)), count)
    if len(out):
        out = out[np.arange(int(count.sum())) + np.repeat(offsets[:-1] - np.cumsum(count) + count, count)]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.concatenate([window_hashes(words[offsets[i] : offsets[i + 1]], int(n[i])) + np.uint64(n[i]) for i in short])
        out, owner = np.concatenate([out, own]), np.concatenate([owner, short])
    return out, owner


def bins_of(texts: pa.Array, bins: int = BINS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The densified bins of every text (rows), and which texts have any shingle."""
    hashes, owner = shingles(texts, k)
    none = np.uint64(np.iinfo(np.uint64).max)
    table = np.full(len(texts) * bins, none)
    np.minimum.at(table, owner * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), hashes)
    table = table.reshape(len(texts), bins)
    order, place = _orders(bins)
    full = table != none
    count = full.sum(1)
    for d in np.flatnonzero((count > 0) & (count < 48)):  # few donors: each empty bin's first by its place
        own = np.flatnonzero(full[d])
        table[d] = table[d, own[np.argmin(place[:, own], axis=1)]] if len(own) else table[d]
    rows, cols = np.nonzero(~full & (count >= 48)[:, None])
    for step in range(bins):
        if len(rows) == 0:
            break
        donor = order[cols, step]
        hit = full[rows, donor]
        table[rows[hit], cols[hit]] = table[rows[hit], donor[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return table, count > 0


def packed(table: np.ndarray, some: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, list[str]]:
    """Low-order bits of every bin, and as strings: packed, base64. A text without words has the empty string."""
    low = (table & np.uint64((1 << bits) - 1)).astype(np.uint8)
    flat = np.packbits(np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=bits).reshape(len(low), -1), axis=1, bitorder="little") if len(low) else low
    return low, [base64.b64encode(r.tobytes()).decode() if s else "" for r, s in zip(flat, some)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard of two sets of shingles, 0 to 1: agreeing bins corrected for chance. Two texts without words are alike."""
    chance = 1 / (1 << bits)
    out = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, out, (some_a == some_b).astype(float))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id and its fingerprint; one pass, no exchange. Null: empty; equal texts have equal fingerprints."""

    def rows(batches):
        for chunk in text_chunks(batches, "t", rows=ROWS):
            _, prints = packed(*bins_of(chunk.column("t"), bins), bits)
            yield pa.RecordBatch.from_arrays([chunk.column("i").cast(pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(rows, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Rows (_part, _id, _t, _own) dealt so that every row of `docs` (_own) is followed by the next one in descending id order.

    Ids are cut into ranges at quantiles, one range a partition; a range ends with a copy of the next range's first row
    (the last with the first of all). Equal ids follow by text, null ids come last. Only the bounds and each range's
    largest id, one a partition, go to the driver.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    n = width(spark)
    cuts = d.agg(F.percentile_approx("_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)
    nulls = len(bounds) + 1

    @F.pandas_udf(LongType())
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), nulls, np.int64)
        out[known] = len(bounds) - np.searchsorted(bounds, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    d = d.withColumn("_part", part_of("_id"))
    top = {r["_part"]: r["top"] for r in d.select("_part", "_id").groupBy("_part").agg(F.max("_id").alias("top")).collect()}
    if not top:
        return d.withColumn("_own", F.lit(1)).select("_part", "_id", "_t", "_own"), []
    parts = sorted(top)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    firsts = d.where(F.col("_id").isin([t for t in top.values() if t is not None])).groupBy("_id").agg(F.min("_t").alias("_t")).select("_id", "_t")
    if nulls in top:
        firsts = firsts.union(d.where("_id IS NULL").agg(F.min("_t").alias("_t")).select(F.lit(None).cast("long"), "_t"))
    places = spark.createDataFrame([(t, before[p]) for p, t in top.items()], "top long, _part long")  # a row a partition
    copies = firsts.join(F.broadcast(places), F.col("_id").eqNullSafe(F.col("top"))).select("_part", "_id", "_t", F.lit(0).alias("_own"))
    both = d.select("_part", "_id", "_t", F.lit(1).alias("_own")).union(copies)
    return both.repartitionById(n, F.col("_part").cast("int")).sortWithinPartitions("_part", F.desc("_own"), F.desc_nulls_last("_id"), "_t"), parts


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One exchange of the texts; fingerprints of a text and of its edited form are made in the same pass. Null texts are empty
    ones; very long texts are hashed whole, one of them in memory at a time; a single row is its own next one; repeated
    rows follow each other; null ids come last; an empty table gives an empty one; other columns are ignored, whatever
    their names.
    """
    dealt, _ = with_next(docs, id_col, text_col)

    def rows(batches):
        held = None
        for chunk in text_chunks(batches, "_t", rows=ROWS):
            part, ids, texts, own = (chunk.column(c).to_pylist() for c in ("_part", "_id", "_t", "_own"))
            if held:
                part, ids, texts, own = ([h, *x] for h, x in zip(held, (part, ids, texts, own)))
            held = part[-1], ids[-1], texts[-1], own[-1]
            go = [i for i in range(len(ids) - 1) if own[i]]
            if not go:
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in go]
            low, prints = packed(*(x := bins_of(pa.array(texts, pa.large_string()), bins)), bits)
            low2, prints2 = packed(*(y := bins_of(pa.array(changed, pa.large_string()), bins)), bits)
            at, some = np.array(go), x[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in go], pa.int64()),
                    pa.array([len(texts[i]) for i in go], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([prints[i] for i in go], pa.string()),
                    pa.array(prints2, pa.string()),
                    pa.array(likeness(low[at], some[at], low2, y[1], bits)),
                    pa.array(likeness(low[at], some[at], low[at + 1], some[at + 1], bits)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(rows, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Language identification by string kernels (operator 7).

The blended-spectrum presence kernel of two texts is the number of hashed character n-grams (one to three long) that both
hold, over the geometric mean of the numbers that each holds. Kernel ridge regression, one language against the rest, is
solved over Nystroem landmarks. Scoring is batched: presence rows times the landmarks' combined weights, which are folded
to one matrix on the driver because the kernel is linear in the presence rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, text_chunks

#: Buckets of hashed n-grams, the longest n-gram, texts scored at a time.
BUCKETS, LONGEST, ROWS = 1 << 16, 3, 128


def presence(texts: list[str]) -> np.ndarray:
    """Texts by buckets: whether any of the text's n-grams falls there. Case and runs of white space don't count."""
    texts = [t.lower() for t in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points == 9) | (points == 10) | (points == 11) | (points == 12) | (points == 13)] = 32
    owner = np.repeat(np.arange(len(texts)), lens)
    out = np.zeros((len(texts), BUCKETS), bool)
    flat, shift = out.reshape(-1), np.uint32(32 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            if len(points) < n:
                break
            m = len(points) - n + 1
            h = (h[:m] * np.uint32(0x01000193)) ^ (points[n - 1 :] + np.uint32(n * 0x1F123BB5))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E3779B1)
            cell = owner[:m] * BUCKETS + (h >> shift)
            if n > 1:
                cell = cell[owner[:m] == owner[n - 1 :]]
            flat[cell] = True
    return out


@dataclass(frozen=True)
class Model:
    """Languages and the matrix (buckets by languages) that presence rows are multiplied by."""

    langs: tuple[str, ...]
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        size = np.maximum(rows.sum(1), 1)
        return (rows.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None].astype(np.float32)


def kernel(a: np.ndarray, b: np.ndarray, block: int = 128) -> np.ndarray:
    """Presence kernels of all rows of a with all of b."""
    right = b.astype(np.float32).T
    out = np.concatenate([a[i : i + block].astype(np.float32) @ right for i in range(0, len(a), block)])
    return out / np.sqrt(np.maximum(a.sum(1), 1))[:, None] / np.sqrt(np.maximum(b.sum(1), 1))[None, :]


def solve(rows: np.ndarray, langs: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression, one against the rest, over evenly spread landmarks."""
    names = tuple(sorted(set(langs)))
    per = max(1, landmarks // len(names))
    where = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    chosen = np.array([i for n in names for i in where[n][:per]])
    marks = rows[chosen]
    k = kernel(rows, marks).astype(np.float64)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / len(where[x]) for x in langs])[:, None]  # every language counts the same
    left = k.T @ (k * weight) + ridge * k[chosen] + 1e-6 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, k.T @ (y * weight))
    alpha /= np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    return Model(names, np.concatenate([marks[:, i : i + 8192].T.astype(np.float64) @ alpha for i in range(0, BUCKETS, 8192)]).astype(np.float32))


def fit(labelled: DataFrame, sample: int = 1200, landmarks: int = 240, ridge: float = 1e-2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from a sample of the labelled rows, the same number for each language: `sample` rows in all (at least 20 a language).

    Rows are drawn by a hash of their id; the sample's presence rows go to the driver as bits. Rows without a language or
    without a letter teach nothing; None if there are no others.
    """
    d = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("g")).where("t IS NOT NULL AND g IS NOT NULL AND t RLIKE '\\\\p{L}'")
    counts = {r.g: r.n for r in d.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(20, sample // len(counts))
    d = d.withColumn("h", F.xxhash64(F.col("i"), F.lit(11)))
    # First a share that holds twice the sample, by a bound on the hash; then the least hashes of each language. Where many
    # rows have one id, and so one hash, such a share may hold too few: that language is taken whole.
    def cut(shares: dict[str, float]) -> DataFrame:
        share = F.create_map(*[x for g, f in shares.items() for x in (F.lit(g), F.lit(f))])
        return d.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share[F.col("g")])

    shares = {g: min(1.0, 2 * each / n) for g, n in counts.items()}
    held = {r.g: r.n for r in cut(shares).groupBy("g").agg(F.count("*").alias("n")).collect()} if min(shares.values()) < 1 else counts
    d = cut({g: f if held.get(g, 0) >= min(each, counts[g]) else 1.0 for g, f in shares.items()})
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "i", "t"))).where(F.col("r") <= each)

    def bits(batches):
        for chunk in text_chunks(batches, "t", rows=ROWS):
            rows = presence(chunk.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([chunk.column("g").cast(pa.string()), chunk.column("r").cast(pa.int32()), pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary())], names=["g", "r", "b"])

    got = sorted(d.select("g", "r", "t").mapInArrow(bits, "g string, r int, b binary").collect(), key=lambda x: (x.g, x.r, bytes(x.b)))
    rows = np.unpackbits(np.frombuffer(b"".join(x.b for x in got), np.uint8).reshape(len(got), -1), axis=1).astype(bool)
    return solve(rows, [x.g for x in got], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. Whole texts alone are looked at; null or without a letter: `und`, score 0. One pass, no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets by languages: bounded by the languages learnt

    def rows(batches):
        known = shared.value
        for chunk in text_chunks(batches, "t", rows=ROWS):
            texts = filled(chunk.column("t"))
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            some = np.flatnonzero(pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False))
            if known is not None and len(some):
                f = known.scores(presence(texts.take(pa.array(some)).to_pylist()))
                best = f.argmax(1)
                lang[some] = np.array(known.langs, object)[best]
                score[some] = np.clip((f[np.arange(len(some)), best] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([chunk.column("i").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(rows, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns outside the held-out fold (crc32 of doc_id as text, modulo `folds`) and predicts every row: doc_id, held_out, lang_pred, score.

    Rows without an id are neither held out nor learnt from; null texts and those without a letter are `und`; very long
    texts are looked at whole; repeated rows each get a row and are learnt from like others; of equal scores the first
    language by name wins; an empty table gives an empty one; other columns are ignored, whatever their names. The driver
    holds `sample` rows of 8 KB, or 20 a language if that is more: languages are the classes, so they are few.
    """
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds)) == held
    model = fit(docs.where(~fold("doc_id")))
    return predict(docs, model).select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")

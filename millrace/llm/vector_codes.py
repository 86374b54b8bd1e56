"""Compression of vectors to codes of integer codebooks (operator 11).

Components are integers, a vector is cut into equal parts, and each part is replaced by the number of the nearest entry of its
position's codebook. Nearest entries are found by a vantage-point tree over the entries of a position: metric
branch-and-bound, in which radii and distances are rounded outwards, a branch is left out only if its bound is truly larger than the
best distance, and every entry looked at is compared by its exact integer squared distance, ties to the lower number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Entries in a leaf of a tree, and rows that go through the trees at a time.
LEAF, ROWS = 16, 8192

#: Largest component: squared distances of 64 components a part, and sums of 2^34 of them, still fit 64 bits.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Leaf:
    numbers: np.ndarray
    entries: np.ndarray


@dataclass(frozen=True)
class Fork:
    """A vantage entry, and two branches with the least and largest distance of their entries to it, rounded outwards."""

    number: int
    entry: np.ndarray
    middle: int
    near: "Fork | Leaf"
    near_radii: tuple[float, float]
    far: "Fork | Leaf"
    far_radii: tuple[float, float]


def _down(x):
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def _up(x):
    return np.nextafter(x, np.inf)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of all rows of a to all rows of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        gap = a[:, j : j + 1] - b[None, :, j]
        out += gap * gap
    return out


def build(entries: np.ndarray, numbers: np.ndarray | None = None) -> Fork | Leaf:
    """The tree over rows of integers. The vantage entry is the one farthest from the rest's first, the cut is the median distance."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    if len(numbers) <= LEAF:
        return Leaf(numbers, entries[numbers])
    top = int(np.argmax(_squared(entries[numbers], entries[numbers[:1]])[:, 0]))
    vantage, rest = int(numbers[top]), np.delete(numbers, top)
    d = _squared(entries[rest], entries[vantage : vantage + 1])[:, 0]
    order = np.argsort(d, kind="stable")
    half = len(order) // 2
    sides = []
    for part in (order[:half], order[half:]):
        root = np.sqrt(d[part].astype(float))
        sides += [build(entries, np.sort(rest[part])), (float(_down(root.min())), float(_up(root.max())))]
    return Fork(vantage, entries[vantage], int(d[order[half]]), *sides)


def nearest(tree: Fork | Leaf, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest entry; of equally near ones the lowest number."""
    best = np.full(len(rows), np.iinfo(np.int64).max)
    found = np.full(len(rows), np.iinfo(np.int64).max)

    def meet(at: np.ndarray, d: np.ndarray, numbers: np.ndarray) -> None:
        low = d.min(axis=1)
        number = np.where(d == low[:, None], numbers[None, :], np.iinfo(np.int64).max).min(axis=1)
        better = (low < best[at]) | ((low == best[at]) & (number < found[at]))
        best[at[better]], found[at[better]] = low[better], number[better]

    def visit(node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, Leaf):
            meet(at, _squared(rows[at], node.entries), node.numbers)
            return
        d = _squared(rows[at], node.entry[None, :])
        meet(at, d, np.array([node.number]))
        root = np.sqrt(d[:, 0].astype(float))
        inside = d[:, 0] < node.middle
        for first in (True, False):  # each row goes to the branch on its own side first, then to the other if it must
            for branch, radii, rows_here in ((node.near, node.near_radii, inside == first), (node.far, node.far_radii, inside != first)):
                some = np.flatnonzero(rows_here)
                bound = np.maximum(_down(_down(root[some]) - radii[1]), _down(radii[0] - _up(root[some])))
                visit(branch, at[some[bound <= _up(np.sqrt(best[at[some]].astype(float)))]])

    visit(tree, np.arange(len(rows)))
    return found, best


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, label, v) with integer components: floor(1024 x). Null vectors, and those with a null or non-finite component, are left out. Written."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 1024).cast("bigint"))
    return materialize(vectors.where(x.isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v")), "vectors")


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dims)


def _parts(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(rows, parts, axis=1)


def checked_dims(rows: DataFrame, parts: int) -> int | None:
    """The common number of components, None without rows; an error where lengths differ, aren't a multiple of `parts`, or a component is too large."""
    largest = F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, c: F.greatest(a, F.abs(c))))
    low, high, top = rows.agg(F.min(F.size("v")), F.max(F.size("v")), largest).first()
    if low is None:
        return None
    if low != high or low % parts:
        raise ValueError(f"vectors need one length that {parts} divides; there are {low} to {high} components")
    if top > LARGEST:
        raise ValueError(f"components must be within {LARGEST} after scaling")
    return low


def fit(rows: DataFrame, dims: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks by position. A round is one pass: tasks add up their rows by entry, and a small aggregation adds the tasks' sums.

    The first codebooks are the parts of the rows of the least ids (equal ids by components, null ids last). What goes to the
    driver is a codebook's size, whatever the rows.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = [np.ascontiguousarray(b) for b in _parts(np.array([r.v for r in first], np.int64).reshape(len(first), dims), parts)]
    for _ in range(rounds):
        books = _moved(rows, books, dims)
    return books


def _moved(rows: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """Every entry replaced by its rows' componentwise mean, rounded down; entries without rows stay."""
    k, wide = len(books[0]), dims // len(books) + 1
    trees = [build(b) for b in books]

    def sums(batches):
        total = np.zeros((len(books), k, wide), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for p, part in enumerate(_parts(_rows(batch.slice(at, ROWS), dims), len(books))):
                    code, _ = nearest(trees[p], part)
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    total[p, used, :-1] += np.add.reduceat(part[order], starts, axis=0)
                    total[p, used, -1] += np.diff(np.append(starts, len(order)))
        used = np.flatnonzero(total[:, :, -1].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(c) for c in total.reshape(-1, wide)[used].T]], names=["e", *[f"c{j}" for j in range(wide)]])

    names = [f"c{j}" for j in range(wide)]
    got = rows.select("v").mapInArrow(sums, "e bigint, " + ", ".join(f"{n} bigint" for n in names)).groupBy("e").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = [b.copy() for b in books]
    for r in got:
        out[r.e // k][r.e % k] = [r[n] // r[names[-1]] for n in names[:-1]]
    return out


def encode(rows: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """Per row: vec_id, label, code (two hex digits a part), error (squared distance over all parts). One pass, no exchange."""
    trees = [build(b) for b in books]

    def codes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                chunk = batch.slice(at, ROWS)
                got = [nearest(t, part) for t, part in zip(trees, _parts(_rows(chunk, dims), len(trees)))]
                text = np.stack([g[0] for g in got], axis=1).astype(np.uint8).tobytes().hex()
                step = 2 * len(trees)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("vec_id"), chunk.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(reduce(np.add, [g[1] for g in got]))],
                    names=["vec_id", "label", "code", "error"],
                )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (error summed over the label's rows), codebooks_sha256.

    Null vectors and those with null or non-finite components are left out; null labels are one label; null ids come last in
    the order of ids; repeated rows each count and each get a row; rows that are equally near go to the lower entry; fewer
    rows than `entries` make smaller codebooks; an empty table gives an empty result; other columns are ignored, whatever
    their names. Vectors of different lengths and components beyond 2^28 after scaling are errors. Sums by label are combined before their exchange
    and joined back, so a label with most rows is no single task's.
    """
    rows = kept(vectors, id_col, vector_col, label_col)
    dims = checked_dims(rows, parts)
    books = fit(rows, dims, parts, entries, rounds) if dims is not None else [np.zeros((1, 0), np.int64)] * parts
    coded = materialize(encode(rows, books, dims or 0), "codes")
    discard(rows)
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))

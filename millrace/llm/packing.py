"""Best-fit packing by swap-based local search (operator 4).

Pieces are dealt to groups of a fixed size by hash, so every group is one bounded task however many there are. A group
starts from best-fit decreasing; where that is above the lower bound, pieces move to, or are exchanged one for one and two
for one with, other underfull bins until no such step raises the sum of squared fills, which empties bins. Partners come
from an index by what a bin holds without the pieces that it gives up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer, materialize, text_chunks
from .tokens import encoder

#: Pieces that one group, so one task, packs.
GROUP = 20_000


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and end_id, cut into pieces of `size` where longer: doc_id, piece, start, length, ids_crc32.

    Null and empty texts are end_id alone; very long texts are encoded whole; repeated rows and rows of one or no id are
    documents each; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches):
        enc = encoder(path)
        for chunk in text_chunks(batches, "t"):
            ids, lens = enc.encode(chunk.column("t"))
            ids = np.insert(ids, np.cumsum(lens), end_id).astype("<u4")
            lens = lens + 1
            begins = np.cumsum(lens) - lens
            n = -(-lens // size)
            row = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(size, lens[row] - start)
            raw = memoryview(ids.tobytes())
            at = 4 * (begins[row] + start)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays([chunk.column("i").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Bins of one group. `order`: by free space, for best fit. `rest`: by fill that remains without nothing, one or two of a bin's pieces: the sum of these and the bin; of underfull bins, for exchanges."""

    def __init__(self, size: int):
        self.size, self.items, self.free, self.order = size, [], [], []
        self.rest: list[list[tuple[int, int]]] | None = None

    def put(self, item: tuple[int, int]):
        """Best fit."""
        at = bisect_left(self.order, (item[0], -1))
        if at < len(self.order):
            free, k = self.order.pop(at)
        else:
            free, k = self.size, len(self.items)
            self.items.append([])
            self.free.append(free)
        self.items[k].append(item)
        self.free[k] = free - item[0]
        insort(self.order, (self.free[k], k))

    def index(self):
        self.rest = [[] for _ in range(self.size + 1)]
        for k in range(len(self.items)):
            self._enter(k, insort)

    def _enter(self, k: int, how):
        if not self.free[k] or not self.items[k]:
            return
        fill = self.size - self.free[k]
        for s in self.sums(k):
            how(self.rest[fill - s], (s, k))

    def sums(self, k: int) -> dict[int, list[tuple[int, int]]]:
        """What the bin can give up, by the sum: nothing, one piece or two."""
        by_size: dict[int, list[tuple[int, int]]] = {}
        for item in self.items[k]:
            by_size.setdefault(item[0], []).append(item)
        out: dict[int, list[tuple[int, int]]] = {0: []}
        sizes = sorted(by_size)
        for n in sizes:
            out[n] = [by_size[n][0]]
        for i, n in enumerate(sizes):
            if len(by_size[n]) > 1:
                out.setdefault(2 * n, by_size[n][:2])
            for m in sizes[i + 1 :]:
                out.setdefault(n + m, [by_size[n][0], by_size[m][0]])
        return out

    def exchange(self, k: int, item: tuple[int, int]) -> bool:
        """Gives a piece of bin k to the bin that gets fullest by it, for nothing, one or two pieces of less in sum, if the sum of squared fills rises.

        The sum of both fills stays, so it rises exactly if the partner gets fuller than k was.
        """
        n = item[0]
        for left in range(self.size - n, self.size - self.free[k] - n, -1):
            for s, j in self.rest[left][:2]:  # a bin is there once, so one of two isn't k
                if s >= n:
                    break
                if j != k:
                    back = self.sums(j)[s]
                    self._enter(k, _leave)
                    self._enter(j, _leave)
                    self.items[k].remove(item)
                    for other in back:
                        self.items[j].remove(other)
                    self.items[k] += back
                    self.items[j].append(item)
                    self.free[k] += n - s
                    self.free[j] -= n - s
                    self._enter(k, insort)
                    self._enter(j, insort)
                    return True
        return False


def _leave(entries: list, entry: tuple[int, int]):
    entries.pop(bisect_left(entries, entry))


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer bins: all tokens need room, and no two pieces above half a bin share one."""
    return max(-(-int(lengths.sum()) // size), int((2 * lengths > size).sum()))


def pack(lengths: np.ndarray, size: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length: best-fit decreasing, then local search until no exchange raises the sum of squared fills, or no packing has fewer bins. rounds: passes over all bins at most; None: as many as it takes."""
    bins = Bins(size)
    whole, items = [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n >= size:
            whole.append(i)
            continue
        items.append((n, i))
        bins.put((n, i))
    least, count, moved, done = lower_bound(np.array([n for n, _ in items], np.int64), size), len(bins.items), True, 0
    while moved and count > least and done != rounds:
        if not done:
            bins.index()
        moved, done = False, done + 1
        # The emptiest bins first: what they hold must go elsewhere.
        for k in sorted(range(len(bins.items)), key=lambda k: (-bins.free[k], k)):
            for item in sorted(bins.items[k], reverse=True):
                if bins.free[k] and bins.exchange(k, item):
                    moved = True
            if not bins.items[k] and bins.free[k] == size:
                bins.free[k] = 0  # closed
                count -= 1
                if count <= least:
                    break
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = [x for x in bins.items if x]
    for k, held in enumerate(full):
        at = 0
        for n, i in held:
            bin_of[i], offset[i] = k, at
            at += n
    bin_of[whole] = len(full) + np.arange(len(whole))
    return bin_of, offset


def best_fit(cut: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of `cut` (with `length`, at most size): packed per hashed group of about `group` pieces.

    Rows are dealt by a written number of their own too, so rows of equal or no id are spread like others; full pieces take a
    sequence each. Every row comes back once, with its other columns; repeated rows and ties of length are packed like
    others, in an order of their values. Empty in, empty out.
    """
    columns = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    cut = materialize(cut.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group))

    def solve(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names if c != "length"], null_placement="at_start")
        rows = rows.take(order)
        bin_of, offset = pack(rows["length"].to_numpy(), size)
        numbers = bin_of * groups + rows["_g"].to_numpy()
        return rows.select(columns).append_column("sequence_id", pa.array(numbers, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # Hash partitioning of few numbers is uneven, so groups are a hash of the rows; each is one task's.
    return cut.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "_n"), F.lit(groups))).groupBy("_g").applyInArrow(solve, schema)

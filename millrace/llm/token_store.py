"""Token-id shards in directly addressable codes (operator 1).

An id is cut into 8-bit chunks. Level l holds the l-th chunk of the ids that have one, in order, with a bitmap that
says which of them continue on level l+1 and a directory of the bitmap's ranks at every 512 bits. The place of an id's
next chunk is the rank of its continuation bit, so any id is found with one directory look-up a level: no block is
decoded. A shard is one row of a Parquet folder: its documents' ids and ends, and the code as one binary value.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer, materialize, text_chunks, width
from .tokens import encoder

MAGIC, BLOCK = b"DAC1", 512
HEAD = struct.Struct("<4sIQ")
SHARDS = "part int, seq int, before bigint, doc_ids array<bigint>, ends array<bigint>, n_tokens bigint, code binary"


def pack(ids: np.ndarray) -> bytes:
    """The directly addressable code of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append(struct.pack("<Q", len(rest)) + ranks.tobytes() + bits.tobytes() + (rest & 255).astype(np.uint8).tobytes())
        rest = rest[more] >> 8
        if len(rest) == 0:
            break
    return HEAD.pack(MAGIC, len(levels), len(ids)) + b"".join(levels)


class Codes:
    """Random access to a packed code."""

    def __init__(self, blob: bytes):
        magic, n_levels, self.n = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a directly addressable code")
        at, self.levels = HEAD.size, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            blocks = -(-n // BLOCK)
            at += 8
            ranks = np.frombuffer(blob, np.uint64, blocks + 1, at)
            at += 8 * (blocks + 1)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at)
            at += blocks * BLOCK // 8
            self.levels.append((ranks, bits, np.frombuffer(blob, np.uint8, n, at)))
            at += n

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits before place i of a level."""
        ranks, bits, _ = self.levels[level]
        block, byte = i // BLOCK, i // 8
        out = int(ranks[block]) + int(np.bitwise_count(bits[block * BLOCK // 8 : byte]).sum())
        return out + (int(bits[byte] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id: a directory look-up a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (_, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids of [start, stop); the ranks at both ends say where their chunks lie on each level."""
        out, places = np.zeros(stop - start, np.uint32), slice(None)
        for level, (_, bits, chunks) in enumerate(self.levels):
            out[places] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if start == stop:
                break
            more = np.flatnonzero(np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start])
            if len(more) == 0:
                break
            places = more if isinstance(places, slice) else places[more]
            start, stop = self._rank(level, start), self._rank(level, start) + len(more)
        return out


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards in ascending order of the ids; returns the written table.

    Rows are range-partitioned and sorted by id (null ids first, then by text), so `part` and `seq` number the shards in
    order. A document is never cut: a shard has one document at least, and one very long text may fill it. Null and empty texts hold end_id alone; repeated
    rows and equal ids are all kept; an empty table gives an empty one; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def encode(batches):
        from pyspark import TaskContext

        part, enc, seq, before = TaskContext.get().partitionId(), encoder(path), 0, 0
        held: list[tuple] = []

        def shard():
            nonlocal held, seq, before
            ids = np.concatenate([x[2] for x in held])
            ends = np.cumsum(np.concatenate([x[1] for x in held]))
            row = {"part": [part], "seq": [seq], "before": [before], "doc_ids": [pa.concat_arrays([x[0] for x in held])], "ends": [ends], "n_tokens": [len(ids)], "code": [pack(ids)]}
            held, seq, before = [], seq + 1, before + len(ids)
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("code", pa.binary())])
        for chunk in text_chunks(batches, "t"):
            ids, lens = enc.encode(chunk.column("t"))
            with_end = np.insert(ids, np.cumsum(lens), end_id).astype(np.uint32)
            held.append((chunk.column("i").cast(pa.int64()), lens + 1, with_end))
            if sum(len(x[2]) for x in held) >= shard_tokens:
                yield shard()
        if held:
            yield shard()

    # Whole ranges, as many as the session's exchanges have; the sort spills.
    ordered = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).repartitionByRange(width(docs.sparkSession), "i").sortWithinPartitions("i", "t")
    return materialize(ordered.mapInArrow(encode, SHARDS), "tokens")


def shard_starts(shards: DataFrame) -> DataFrame:
    """The shards with `base`, the number of ids in all parts before theirs. Sums of the parts (one row a partition) go to the driver, never rows."""
    spark = shards.sparkSession
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, bases = 0, []
    for part, n in sums:
        bases.append((part, before))
        before += n
    return shards.join(F.broadcast(spark.createDataFrame(bases, "part int, base bigint")), "part")


def read_documents(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                codes, lo, starts, lens, sums = Codes(r["code"]), 0, [], [], []
                for hi in r["ends"]:
                    starts.append(r["base"] + r["before"] + lo)
                    lens.append(hi - lo)
                    sums.append(zlib.crc32(codes.range(lo, hi).astype("<u4").tobytes()))
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shard_starts(shards).select("doc_ids", "ends", "code", "base", "before").mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

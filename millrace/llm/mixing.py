"""Mixing sources to target weights (operator 8).

A source's words, in order of its documents, are cut into blocks of a fixed length. The mix is a row of slots in output
shards; how many slots of a shard go to each source is drawn by splitting all sources' quotas over a binary tree of
shards: the draw at each node is a multinomial one conditioned on the quotas, so any shard finds its counts, and the
number of each source's slots before it, in a walk from the root. A source's k-th slot reads block perm(k) of a
pseudorandom permutation of its block indices, a new one each time the source has been used up. Blocks and documents
are then joined by index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, WORD, materialize, mix, width

#: Words of a block, blocks of an output shard, weights by a source's place in the order of names.
BLOCK, SHARD, WEIGHTS = 64, 4096, (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: float
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of `total` by weight; none above `most` times its size, the excess reshared by weight among the others."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def plan(sizes: list[tuple[str | None, int]], block: int = BLOCK, share: float = SHARE, weights=WEIGHTS) -> list[Source]:
    """Sources in order of names (by code point, null last) with their targets and slots."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(ordered))]
    t = targets([n for _, n in ordered], w, share * sum(n for _, n in ordered))
    out = []
    for (name, n), weight, target in zip(ordered, w, t):
        blocks = -(-n // block)
        whole = int(target // n) if n else 0  # times that all blocks are taken
        rest = round((target - whole * n) / (n / blocks)) if n else 0
        out.append(Source(name, n, weight, target, blocks, whole * blocks + min(blocks, rest)))
    return out


def split(quotas: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `left` slots drawn from the quotas without return go to each source."""
    out, pool, want = np.zeros_like(quotas), int(quotas.sum()), left
    for i, q in enumerate(quotas.tolist()):
        pool -= q
        if want == 0:
            break
        got = int(rng.hypergeometric(q, pool, want)) if q else 0
        out[i] = got
        want -= got
    return out


def even(quotas: list[int], size: int) -> list[int]:
    """`size` slots of the quotas in proportion, the largest remainders rounded up."""
    total = sum(quotas)
    out = [q * size // total for q in quotas]
    for i in sorted(range(len(quotas)), key=lambda i: (-(quotas[i] * size % total), i))[: size - sum(out)]:
        out[i] += 1
    return out


class Shards:
    """Counts and starts of every source in any output shard.

    Quotas are spread evenly over regions of shards, of at most `region` slots (what the exact draws can hold); inside a
    region they are drawn.
    """

    def __init__(self, quotas: np.ndarray, shard: int, seed: int, region: int = 1 << 28):
        self.total, self.shard, self.seed = int(quotas.sum()), shard, seed
        self.n, self.per = -(-self.total // shard), max(1, region // shard)
        self.regions, left, before = [], [int(q) for q in quotas], [0] * len(quotas)
        for lo in range(0, self.n, self.per):
            hi = min(self.n, lo + self.per)
            own = even(left, min(self.total, hi * shard) - lo * shard)
            self.regions.append((lo, hi, np.array(own, np.int64), np.array(before, np.int64)))
            left, before = [a - b for a, b in zip(left, own)], [a + b for a, b in zip(before, own)]
        self.path = []

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots, slots before) of each source; neighbours share most of the walk."""
        while self.path and not self.path[-1][0] <= k < self.path[-1][1]:
            self.path.pop()
        if not self.path:
            self.path.append(self.regions[k // self.per])
        while self.path[-1][1] - self.path[-1][0] > 1:
            lo, hi, quotas, before = self.path[-1]
            mid = (lo + hi) // 2
            first = split(quotas, min(self.total, mid * self.shard) - lo * self.shard, np.random.Generator(np.random.PCG64([self.seed, lo, hi])))
            self.path.append((lo, mid, first, before) if k < mid else (mid, hi, quotas - first, before + first))
        return self.path[-1][2], self.path[-1][3]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`: a Feistel network over the next even power of two, walked until inside."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        with np.errstate(over="ignore"):
            for r in range(4):
                left, right = right, left ^ (mix(right * BASE + np.uint64((key * 4 + r + 1) & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def mix_sources(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, share: float = SHARE, weights=WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), taken (words of it in the mix, repeats counted), source.

    One row a source goes to the driver (it is what weights are set for). Documents are laid out by range partitions with
    running sums inside each, so a source that holds most rows is spread like any other. Null texts have no words; null
    sources are a source; rows with equal ids are laid out by size, repeated rows one after the other; very long texts reach
    into many blocks, which are made a bounded number at a time; an empty table gives an empty one; other columns are
    ignored, whatever their names. Reruns agree: draws depend on the seed and on the sources' sizes alone.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    sized = sized.repartitionByRange(width(spark), F.asc_nulls_last("s"), F.asc_nulls_first("i"), "n").withColumn("p", F.spark_partition_id())
    within = Window.partitionBy("s", "p").orderBy(F.asc_nulls_first("i"), "n").rowsBetween(Window.unboundedPreceding, -1)
    laid = materialize(sized.withColumn("b", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("u", F.monotonically_increasing_id()), "sizes")
    sums = laid.groupBy("s", "p").agg(F.sum("n").alias("n")).collect()  # a row a partition and a source at most
    sizes: dict[str | None, int] = {}
    begins = []
    for r in sorted(sums, key=lambda r: (r.s is None, r.s or "", r.p)):
        begins.append((r.s, r.p, sizes.get(r.s, 0)))
        sizes[r.s] = sizes.get(r.s, 0) + r.n
    sources = plan(list(sizes.items()), block, share, weights)
    if not sources:
        return laid.select(F.col("i").alias("doc_id"), F.col("n").alias("size"), F.col("n").alias("source_size"), F.lit(0.0).alias("target"), F.col("n").alias("taken"), F.col("s").alias("source"))
    k_of = {x.name: k for k, x in enumerate(sources)}
    table = spark.createDataFrame([(s, p, b, k_of[s], sources[k_of[s]].size, sources[k_of[s]].target) for s, p, b in begins], "s string, p int, base bigint, k int, source_size bigint, target double")
    placed = laid.join(F.broadcast(table.withColumnRenamed("s", "s2").withColumnRenamed("p", "p2")), F.col("s").eqNullSafe(F.col("s2")) & (F.col("p") == F.col("p2"))).withColumn("b", F.col("b") + F.col("base"))

    def parts(batches):
        """A row for each block that a document reaches into: (document, source, block, words there)."""
        for batch in batches:
            u, k, begin, n = (batch.column(c).to_numpy() for c in ("u", "k", "b", "n"))
            some = np.flatnonzero(n > 0)
            at = 0
            count = (begin + n - 1) // block - begin // block + 1
            while at < len(some):  # a bounded number of blocks at a time, however long the documents
                to = at + max(1, int(np.searchsorted(np.cumsum(count[some[at:]]), 1 << 18, side="right")))
                rows = some[at:to]
                at = to
                c = count[rows]
                which = np.repeat(rows, c)
                index = begin[which] // block + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                words = np.minimum((index + 1) * block, begin[which] + n[which]) - np.maximum(index * block, begin[which])
                yield pa.RecordBatch.from_arrays([pa.array(u[which]), pa.array(k[which]), pa.array(index), pa.array(words)], names=["u", "k", "block", "words"])

    quotas = np.array([x.slots for x in sources], np.int64)
    blocks_of = [x.blocks for x in sources]

    def draw(batches):
        """The block that each slot of the shards reads."""
        shards = Shards(quotas, shard, seed)
        for batch in batches:
            for x in batch.column("id").to_pylist():
                counts, before = shards[x]
                ks, blocks = [], []
                for k in np.flatnonzero(counts).tolist():
                    slot = before[k] + np.arange(counts[k])
                    for epoch in range(int(slot[0] // blocks_of[k]), int(slot[-1] // blocks_of[k]) + 1):
                        index = slot[slot // blocks_of[k] == epoch] % blocks_of[k]
                        blocks.append(permuted(index, blocks_of[k], (seed * 1_000_003 + k) * 64 + epoch))
                        ks.append(np.full(len(index), k, np.int32))
                if ks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array(np.concatenate(blocks))], names=["k", "block"])

    n_shards = -(-int(quotas.sum()) // shard)
    slots = spark.range(0, n_shards, 1, max(1, min(n_shards, width(spark)))).mapInArrow(draw, "k int, block bigint")
    # The plan takes slots for as few as the shards that they come from: without the hint it would broadcast them.
    times = slots.groupBy("k", "block").agg(F.count("*").alias("times")).hint("merge")
    reached = placed.select("u", "k", "b", "n").mapInArrow(parts, "u bigint, k int, block bigint, words bigint")
    taken = reached.join(times, ["k", "block"]).groupBy("u").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken.hint("merge"), "u", "left").select(F.col("i").alias("doc_id"), F.col("n").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.col("s").alias("source"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents, with the columns of `docs` (doc_id, text and source among them): a document comes as often as
    its words were taken over its size, the fraction rounded up or down by a hash of its id; rows of equal ids are mixed alike."""
    part = mix_sources(docs, **options).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    often = part.select(F.col("doc_id").alias("_i"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(0).cast("int").alias("_n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(often, F.col("_row.doc_id").eqNullSafe(F.col("_i"))).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")

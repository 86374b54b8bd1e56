"""Ranked lexical search (operator 13): MaxScore over the postings of a shard.

A shard is a run of documents inside a task. For every query its terms are split by upper bounds of what they can add in the
shard: terms whose bounds together stay below the score that a document needs are non-essential. Only documents in the
essential terms' postings are candidates; the postings of non-essential terms are probed, largest bound first, for those
candidates that can still qualify. The score needed is the k-th best that the task has seen, so it rises from shard to shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import LOWER, discard, filled, hashed_spans, materialize, ragged, text_bytes, text_chunks, word_spans_of

#: By byte: what ends a term. Letters and digits of ASCII and all bytes of other characters make terms.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Documents of a shard, items searched in one pass, and bytes of their terms: what a task holds follows from these.
SHARD, ITEMS, TERM_BYTES = 4096, 2000, 32 << 20


@dataclass(frozen=True)
class Vocabulary:
    """The distinct terms of a block of items, by their hashes in ascending order; equal hashes of different terms don't occur."""

    hashes: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    lens: np.ndarray

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for terms that no item has. Hashes find it, bytes decide."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.hashes):
            return out
        hashes = hashed_spans(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        like = np.flatnonzero((self.hashes[at] == hashes) & (self.lens[at] == ends - starts))
        at, lens = at[like], self.lens[at[like]]
        if len(like):
            same = raw[ragged(starts[like], lens)] == self.raw[ragged(self.starts[at], lens)]
            whole = np.logical_and.reduceat(same, np.cumsum(lens) - lens)
            out[like[whole]] = at[whole]
        return out


def _spans(texts: pa.Array):
    raw, ends = text_bytes(texts)
    raw = LOWER[raw]
    return raw, *word_spans_of(raw, ends, BREAKS)


def vocabulary(texts: list[str | None]) -> tuple[Vocabulary, list[np.ndarray]]:
    """The terms of the items' texts, and each item's term numbers, repeats included."""
    raw, starts, ends, offsets = _spans(filled(pa.array(texts, pa.string())))
    terms = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    hashes = hashed_spans(raw, starts, ends)
    by_hash: dict[int, bytes] = {}
    for h, t in zip(hashes.tolist(), terms):
        if by_hash.setdefault(h, t) != t:
            raise ValueError("two terms of the items have one hash; put them into different blocks")
    order = sorted(by_hash)
    number = {h: i for i, h in enumerate(order)}
    lens = np.array([len(by_hash[h]) for h in order], np.int64)
    known = Vocabulary(np.array(order, np.uint64), np.frombuffer(b"".join(by_hash[h] for h in order), np.uint8), np.cumsum(lens) - lens, lens)
    numbers = np.array([number[h] for h in hashes.tolist()], np.int64)
    return known, [numbers[offsets[i] : offsets[i + 1]] for i in range(len(texts))]


def postings(docs: DataFrame, known: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a term: doc_id, n (its terms), terms (numbers of those that items have, ascending), counts. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # bounded by ITEMS and TERM_BYTES

    def rows(batches):
        for chunk in text_chunks(batches, "t"):
            raw, starts, ends, offsets = _spans(filled(chunk.column("t")))
            n = np.diff(offsets)
            number = shared.value.numbers(raw, starts, ends)
            hit = np.flatnonzero(number >= 0)
            size = max(len(shared.value.hashes), 1)
            pairs, counts = np.unique(np.repeat(np.arange(len(n)), n)[hit] * size + number[hit], return_counts=True)
            cuts = np.searchsorted(pairs // size, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (pairs % size, counts)]
            batch = pa.RecordBatch.from_arrays([chunk.column("i"), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])
            yield batch.filter(pa.array(n > 0))

    d = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    return materialize(d.mapInArrow(rows, "doc_id bigint, n bigint, terms array<int>, counts array<int>"), "postings")


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the weight of every term of the block."""

    documents: int
    terms: int
    weights: np.ndarray


def corpus_of(lists: DataFrame, size: int) -> Corpus:
    """Counted over all documents; document frequencies are combined in tasks before their exchange, a row a term of the items."""
    n, total = lists.agg(F.count("*"), F.sum("n")).first()

    def frequencies(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)[:size]
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for r in lists.select("terms").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return Corpus(n, total or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))


class Shard:
    """Postings of up to SHARD documents by term: documents (positions, ascending) and what the term adds to each, and the largest of that."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, corpus: Corpus):
        m = 75 + np.array([(25 * x * corpus.documents) // corpus.terms for x in n.tolist()], np.int64)
        order = np.argsort(term, kind="stable")
        self.ids, self.doc, term, tf = ids, doc[order], term[order], tf[order].astype(np.int64)
        self.adds = corpus.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.starts = np.searchsorted(term, np.arange(len(corpus.weights) + 1))
        self.most = np.zeros(len(corpus.weights), np.int64)
        used = np.flatnonzero(np.diff(self.starts))
        if len(used):
            self.most[used] = np.maximum.reduceat(self.adds, self.starts[used])
        self.sums = np.zeros(len(ids), np.int64)

    def search(self, terms: np.ndarray, times: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of all documents that score at least `needed` (at least 1)."""
        bounds = self.most[terms] * times
        order = np.argsort(bounds, kind="stable")
        order = order[bounds[order] > 0]
        upto = np.cumsum(bounds[order])  # what the first terms of the order can add together
        essential = int(np.searchsorted(upto, needed, side="left"))
        lists = [(slice(self.starts[t], self.starts[t + 1]), c) for t, c in zip(terms[order], times[order])]
        found = [self.doc[s] for s, _ in lists[essential:]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for (s, c), docs in zip(lists[essential:], found):
            self.sums[docs] += self.adds[s] * c
        candidates = np.unique(np.concatenate(found))
        scores = self.sums[candidates]
        self.sums[candidates] = 0
        for i in range(essential - 1, -1, -1):  # non-essential terms, largest bound first
            able = scores + upto[i] >= needed
            candidates, scores = candidates[able], scores[able]
            if not len(candidates):
                break
            s, c = lists[i]
            docs = self.doc[s]
            at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
            scores = scores + np.where(docs[at] == candidates, self.adds[s][at] * c, 0)
        able = scores >= needed
        return candidates[able], scores[able]


def _merge(best, scores: np.ndarray, ids: np.ndarray, k: int):
    """The k best of both by score, then id; null ids (masked by the largest number) last."""
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


#: Stands for a null id inside tasks.
NO_ID = np.iinfo(np.int64).max


def _shards(batches, corpus: Corpus, held: int):
    """Shards of `held` documents, whatever the batches."""
    waiting, count = [], 0

    def shard(rows: list[pa.RecordBatch]) -> Shard:
        t = pa.Table.from_batches(rows).combine_chunks()
        terms, counts = t.column("terms").combine_chunks(), t.column("counts").combine_chunks()
        doc = np.repeat(np.arange(t.num_rows), np.diff(terms.offsets.to_numpy()))
        ids = t.column("doc_id").fill_null(NO_ID).to_numpy()
        return Shard(ids, t.column("n").to_numpy(), doc, terms.flatten().to_numpy(), counts.flatten().to_numpy(), corpus)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, held - count)
            waiting.append(part)
            at, count = at + part.num_rows, count + part.num_rows
            if count == held:
                yield shard(waiting)
                waiting, count = [], 0
    if count:
        yield shard(waiting)


def best_of(lists: DataFrame, queries: list[tuple[int | None, np.ndarray]], corpus: Corpus, k: int = 20, held: int = SHARD) -> DataFrame:
    """The k best documents of every item over all tasks: item_id, rank, doc_id, score.

    A task returns k rows an item at most; tasks are merged in groups first and then over the groups, so no item's rows grow
    with the number of tasks in one place.
    """
    split = [(number, *np.unique(terms, return_counts=True)) for number, (_, terms) in enumerate(queries)]
    shared = lists.sparkSession.sparkContext.broadcast((split, corpus))

    def search(batches):
        split, corpus = shared.value
        best = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q, _, _ in split}
        for shard in _shards(batches, corpus, held):
            for q, terms, times in split:
                have = best[q]
                needed = int(have[0][-1]) if len(have[0]) == k else 1
                docs, scores = shard.search(terms, times, max(needed, 1))
                if len(docs):
                    best[q] = _merge(have, scores, shard.ids[docs], k)
        for q, (scores, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["q", "doc_id", "score"])

    found = lists.mapInArrow(search, "q bigint, doc_id bigint, score bigint").withColumn("g", F.spark_partition_id() % 64)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for group in (["q", "g"], ["q"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    items = lists.sparkSession.createDataFrame([Row(q=i, item_id=item) for i, (item, _) in enumerate(queries)], "q bigint, item_id bigint")
    return found.join(items, "q").select("item_id", "rank", "doc_id", "score")  # a row an item of the block: ITEMS at most


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Items in blocks of ITEMS rows and TERM_BYTES of text, or one longer item; the driver holds one block at a time."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        more = len((r.t or "").encode("utf-8", "surrogatepass"))
        if block and (len(block) == ITEMS or size + more > TERM_BYTES):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += more
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", held: int = SHARD) -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Null and empty texts have no terms: such documents aren't counted and never found, such items have no rows. Very long
    texts are read whole. Documents with one id are ranked apart; equal scores rank by ascending doc_id, null ids last, and
    are told apart by nothing else. Repeated items each get their rows. Empty tables give no rows; other columns are ignored, whatever their names.
    Items are searched in blocks of bounded size; every block reads the documents once.
    """
    spark, found = docs.sparkSession, None
    for block in _blocks(items, item_col, item_text):
        known, numbers = vocabulary([t for _, t in block])
        lists = postings(docs, known, id_col, text_col)
        some = materialize(best_of(lists, [(i, n) for (i, _), n in zip(block, numbers)], corpus_of(lists, len(known.hashes)), k, held), "ranked")
        discard(lists)
        found = some if found is None else found.union(some)
    return found if found is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")

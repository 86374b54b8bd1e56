"""Topic models by variational inference: a pass is one aggregation of word by topic sums."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Config, ConvergenceWarning, EmptyInputError, InvalidParameterError, require
from ..plans.frame import partitions
from ..plans.scratch import discard, materialize

#: Words by topics that the driver and every task hold at most, entries that a task infers at a time, those that a product takes, and bytes of text that are split at a time.
CELLS, ENTRIES, PRODUCT, BYTES = 1 << 24, 1 << 18, 1 << 13, 1 << 23

#: The tasks over which Spark spreads the files of a scan, where they are large enough.
TASKS = "spark.sql.files.minPartitionNum"

#: A word is a run of letters; this is what lies between.
BETWEEN = r"\PL+"


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers: six steps of the recurrence, then the asymptotic series."""
    series, z = _series(np.asarray(x, float))
    return np.log(z) + series


def _series(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """digamma(x) - log(z) and z = x + 6; the six steps are one fraction of u = x (x + 5)."""
    z, u = x + 6, x * (x + 5)
    y = 1 / (z * z)
    low = (2 * x + 5) * ((3 * u + 20) * u + 24) / (u * (u + 4) * (u + 6))
    return -0.5 / z - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - low, z


def _expected(rows: np.ndarray) -> np.ndarray:
    """exp of the expected logarithm of Dirichlet shares, row by row."""
    return np.exp(digamma(rows) - digamma(rows.sum(1))[:, None])


def _settled(sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, starts: np.ndarray, beta: np.ndarray, alpha: float, rounds: int, tol: float) -> np.ndarray:
    """Topic weights of documents by their sizes, none 0, and starts.

    Documents of similar length are filled up to one, topics by places, so that a round is two products for some thousand
    entries; what a round does to weights it does to all documents at once.
    """
    k = beta.shape[1]
    order = np.argsort(sizes, kind="stable")
    bounds, high = [0], 2
    while bounds[-1] < len(order):
        bounds.append(int(np.searchsorted(sizes[order], high, side="right")))
        high = high * 3 // 2
    groups = []
    for docs in (order[a:b] for a, b in zip(bounds, bounds[1:]) if a < b):
        place = np.arange(sizes[docs].max())
        inside = place < sizes[docs, None]
        entry = np.where(inside, starts[docs, None] + place, 0)
        groups.append((np.ascontiguousarray(beta[words[entry]].transpose(0, 2, 1)), np.where(inside, counts[entry], 0.0)))
    out = np.ones((len(sizes), k))
    at, weights, rests = order, out[order], np.zeros(len(order), bool)
    # Weights add up to k at first and to this ever after.
    whole = np.exp(-digamma(k * alpha + np.add.reduceat(counts, starts)))[order] if len(order) else np.zeros(0)
    scale = np.full(len(order), np.exp(-digamma(np.array(float(k)))))
    for _ in range(rounds):
        series, z = _series(weights)
        theta = z * np.exp(series) * scale[:, None]
        new = np.empty_like(theta)
        low = 0
        for known, times in groups:
            step = max(1, PRODUCT // known.shape[2])
            for i in range(0, len(known), step):
                some, to = known[i : i + step], min(i + step, len(known))
                ratio = np.vecmat(theta[low + i : low + to], some)
                ratio += 1e-100
                np.divide(times[i:to], ratio, out=ratio)
                np.matvec(some, ratio, out=new[low + i : low + to])
            low += len(known)
        new *= theta
        new += alpha
        new[rests] = weights[rests]
        rests |= np.abs(new - weights).mean(1) < tol
        weights, scale = new, whole
        if 4 * rests.sum() >= len(rests):  # those that rest leave once they are many
            out[at] = weights
            go, low, left = ~rests, 0, []
            for known, times in groups:
                stay = go[low : low + len(known)]
                low += len(known)
                if stay.any():
                    left.append((known[stay], times[stay]))
            groups, at, weights, whole, rests = left, at[go], weights[go], whole[go], rests[go]
            scale = whole
            if not len(at):
                break
    out[at] = weights
    return out


def _weights(words: np.ndarray, counts: np.ndarray, starts: np.ndarray, beta: np.ndarray, alpha: float, rounds: int, tol: float) -> np.ndarray:
    """Topic weights of documents: documents by topics. Entries of a document follow each other; starts has one more place than there are documents.

    beta: words by topics. A document rests once its weights move by less than `tol` on average.
    """
    sizes = np.diff(starts)
    weights = np.full((len(sizes), beta.shape[1]), alpha)
    docs = np.flatnonzero(sizes)
    weights[docs] = _settled(sizes[docs], words, counts, starts[docs], beta, alpha, rounds, tol)
    return weights


def infer(words: np.ndarray, counts: np.ndarray, starts: np.ndarray, beta: np.ndarray, alpha: float, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents, and what each entry adds to its word (entries by topics), before the word's own factor."""
    weights = _weights(words, counts, starts, beta, alpha, rounds, tol)
    theta = np.repeat(_expected(weights), np.diff(starts), axis=0)
    theta *= (counts / (np.einsum("ek,ek->e", theta, beta[words]) + 1e-100))[:, None]
    return weights, theta


def _cuts(ends: np.ndarray, size: int):
    """(from, to) of neighbours that together have about this size; ends has one more place than there are."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, to
        at = to


def _blocks(batches):
    """(words, counts, starts, copies) with about ENTRIES entries each."""
    for batch in batches:
        for at, to in _cuts(batch.column("words").offsets.to_numpy(), ENTRIES):
            part = batch.slice(at, to - at)
            words, counts = (part.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("words", "counts"))
            ends = part.column("words").offsets.to_numpy()
            yield words, counts.astype(float), (ends - ends[0]).astype(np.int64), part.column("copies").to_numpy().astype(float)


def _texts(texts: pa.Array):
    """Parts of about BYTES bytes."""
    for at, to in _cuts(np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())), BYTES):
        yield texts.slice(at, to - at)


def _owners(lists: pa.Array) -> np.ndarray:
    """The list of every element."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def _holders(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of these texts, and how many texts hold each. Every piece between spaces is split into words once."""
    rough = pc.split_pattern(texts, " ")
    pieces = rough.flatten().dictionary_encode()
    split = pc.split_pattern_regex(pieces.dictionary, BETWEEN)
    names = split.flatten().dictionary_encode()
    begin = np.append(0, np.cumsum(np.bincount(_owners(split), minlength=len(split))))
    piece, number = pieces.indices.to_numpy(), names.indices.to_numpy()
    sizes = (begin[1:] - begin[:-1])[piece]
    at = np.arange(sizes.sum()) + np.repeat(begin[piece] - np.cumsum(sizes) + sizes, sizes)
    held = np.sort(np.repeat(_owners(rough), sizes) * len(names.dictionary) + number[at])  # np.unique would hash, which takes twenty times as long
    held = held[np.diff(held, prepend=-1) > 0]
    n = np.bincount(held % max(1, len(names.dictionary)), minlength=len(names.dictionary))
    some = pc.not_equal(names.dictionary, "")
    return names.dictionary.filter(some), n[some.to_numpy(zero_copy_only=False)]


def _numbers(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the numbers of its known words, ascending, how often each comes, and where each text starts.

    What lies between spaces and is no known word is split at all that is no letter.
    """
    known = known.cast(texts.type)
    rough = pc.split_pattern(texts, " ")
    pieces, owner = rough.flatten(), _owners(rough)
    found = pc.index_in(pieces, value_set=known)
    rest = pc.is_null(found)
    split = pc.split_pattern_regex(pieces.filter(rest), BETWEEN)
    again = pc.index_in(split.flatten(), value_set=known)
    rest = rest.to_numpy(zero_copy_only=False)
    owner = np.concatenate([owner[~rest], owner[rest][_owners(split)][pc.is_valid(again).to_numpy(zero_copy_only=False)]])
    number = np.concatenate([x.drop_null().to_numpy() for x in (found, again)])
    key, times = np.unique(owner * len(known) + number, return_counts=True)
    return key % len(known), times, np.append(0, np.cumsum(np.bincount(key // len(known), minlength=len(texts))))


@dataclass(frozen=True)
class LatentDirichlet(Config):
    """Words are runs of letters, without case, that at least `min_df` documents and at most a share `max_df` of them hold: the `vocabulary` most frequent.

    With `batches` above 1 a step sees one batch of documents, dealt by their words, and moves the topics by
    (offset + step) ** -decay of the way; with one, each pass replaces them.
    """

    n_topics: int = 10
    max_iter: int = 10
    vocabulary: int = 20_000
    min_df: int = 2
    max_df: float = 1.0
    batches: int = 1
    decay: float = 0.7
    offset: float = 10.0
    tol: float = 1e-3
    inner_rounds: int = 100
    seed: int = 0

    def fit(self, df: DataFrame, text: str = "text") -> "TopicModel":
        """Null and empty texts, and those without known words, teach nothing; whole texts count.

        Documents are counted once into a written table of word numbers, where those of the same counts are one row. A step sends word by topic sums to the driver, as many as the model
        holds. Ends when no topic moves by more than `tol` of its mass, or with a warning.
        """
        require(df, [text])
        if self.n_topics < 1 or self.max_iter < 1 or self.vocabulary < 1 or self.batches < 1 or not 0 < self.max_df <= 1 or self.min_df < 1 or self.offset <= 0 or not 0.5 < self.decay <= 1:
            raise InvalidParameterError("n_topics, max_iter, vocabulary, batches and min_df >= 1, 0 < max_df <= 1, offset > 0 and 0.5 < decay <= 1 are needed")
        if self.n_topics * self.vocabulary > CELLS:
            raise InvalidParameterError("topics by words are too many for the driver")
        words = self._vocabulary(df, text)
        if not words:
            raise EmptyInputError("no words that enough documents hold")
        # Dealt anew: a table of few files or row groups would leave every pass to few tasks.
        dealt = counted(df.select(F.col(f"`{text}`").alias("t")), words).repartition(partitions(df.sparkSession), "words", "counts")
        held, conf, cores = materialize(dealt.groupBy("words", "counts").agg(F.sum("copies").alias("copies")), "counts"), df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
        tasks = conf.get(TASKS, None)
        conf.set(TASKS, str(max(int(tasks or 0), 4 * cores)))  # else Spark packs files to a task a core and one more, for which all wait
        try:
            topics, steps, settled, n = np.random.default_rng(self.seed).gamma(100.0, 0.01, (len(words), self.n_topics)), 0, False, held.agg(F.sum("copies")).first()[0] or 0
            for _ in range(self.max_iter):
                before = topics
                for b in range(self.batches):
                    some = held if self.batches == 1 else held.where(F.pmod(F.xxhash64("words", "counts"), F.lit(self.batches)) == b)
                    seen, sums = self._sums(some, topics)
                    if not seen:
                        continue
                    new = 1 / self.n_topics + sums * (n / seen)
                    rate = 1.0 if self.batches == 1 else (self.offset + steps) ** -self.decay
                    topics = (1 - rate) * topics + rate * new
                    steps += 1
                settled = bool((np.abs(topics - before).sum(0) <= self.tol * before.sum(0)).all())
                if settled:
                    break
        finally:
            conf.unset(TASKS) if tasks is None else conf.set(TASKS, tasks)
            discard(held)
        if not settled:
            warnings.warn("the topic model stopped at max_iter", ConvergenceWarning, stacklevel=2)
        return TopicModel(text, tuple(words), tuple(map(tuple, topics.tolist())), self.inner_rounds, self.tol, steps)

    def _vocabulary(self, df: DataFrame, text: str) -> list[str]:
        """The most frequent words, then by name: counts are combined in tasks, the largest go to the driver as they are the model's."""
        t = df.select(F.lower(F.col(f"`{text}`")).alias("t")).where("t IS NOT NULL")

        def part(batches):
            for b in batches:
                for texts in _texts(b.column("t")):
                    names, n = _holders(texts)
                    yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64())], names=["w", "n"])

        words = t.mapInArrow(part, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_df)
        some = words if self.max_df == 1 else words.where(F.col("n") <= self.max_df * t.count())
        return sorted(r.w for r in some.orderBy(F.col("n").desc(), "w").limit(self.vocabulary).collect())

    def _sums(self, rows: DataFrame, topics: np.ndarray) -> tuple[int, np.ndarray]:
        """Documents seen, and by word and topic what they add."""
        beta, k = _expected(topics.T).T, self.n_topics
        shared = rows.sparkSession.sparkContext.broadcast(beta)
        alpha, rounds, tol = 1 / k, self.inner_rounds, self.tol

        def part(batches):
            total, seen = np.zeros(beta.shape), 0
            for words, counts, starts, copies in _blocks(batches):
                _, add = infer(words, counts, starts, shared.value, alpha, rounds, tol)
                add *= np.repeat(copies, np.diff(starts))[:, None]
                for c in range(k):
                    total[:, c] += np.bincount(words, weights=add[:, c], minlength=len(total))
                seen += copies.sum()
            used = np.flatnonzero(total.any(1))
            columns = [pa.array(np.append(used, -1)), *[pa.array(np.append(total[used, c], float(seen))) for c in range(k)]]
            yield pa.RecordBatch.from_arrays(columns, names=["w", *[f"t{c}" for c in range(k)]])

        found = rows.mapInArrow(part, "w bigint, " + ", ".join(f"t{c} double" for c in range(k))).groupBy("w").agg(*[F.sum(f"t{c}").alias(f"t{c}") for c in range(k)]).toArrow()
        shared.destroy()
        at = found.column("w").to_numpy()
        values = np.stack([found.column(f"t{c}").to_numpy() for c in range(k)], axis=1)
        sums = np.zeros(beta.shape)
        sums[at[at >= 0]] = values[at >= 0]
        return int(values[at < 0][0, 0]) if (at < 0).any() else 0, sums * beta


def counted(texts: DataFrame, words: list[str]) -> DataFrame:
    """Of texts `t` that hold known words: these words' numbers, ascending, how often each comes, and how many neighbouring texts (copies) have the same."""
    shared = texts.sparkSession.sparkContext.broadcast(words)  # a model's words

    def rows(batches):
        known = pa.array(shared.value, pa.string())
        for b in batches:
            for part in _texts(b.column("t")):
                number, times, starts = _numbers(part, known)
                number, times, copies, first = number.astype(np.int32), times.astype(np.int32), {}, []
                for i, j in zip(starts[:-1], starts[1:]):
                    if i < j:
                        key = number[i:j].tobytes() + times[i:j].tobytes()
                        if key not in copies:
                            first.append((i, j))
                        copies[key] = copies.get(key, 0) + 1
                lens = pa.array(np.cumsum([0, *[j - i for i, j in first]]), pa.int32())
                flat = [np.concatenate([x[i:j] for i, j in first]) if first else x[:0] for x in (number, times)]
                yield pa.RecordBatch.from_arrays([*[pa.ListArray.from_arrays(lens, pa.array(x)) for x in flat], pa.array(copies.values(), pa.int64())], names=["words", "counts", "copies"])

    return texts.select(F.lower("t").alias("t")).mapInArrow(rows, "words array<int>, counts array<int>, copies bigint")


@dataclass(frozen=True)
class TopicModel:
    """topics: by word, the weights of the topics."""

    text: str
    words: tuple[str, ...]
    topics: tuple[tuple[float, ...], ...]
    inner_rounds: int
    tol: float
    steps: int

    def top_words(self, n: int = 10) -> list[list[str]]:
        """Each topic's words of largest share, then by name."""
        share = np.array(self.topics) / np.array(self.topics).sum(0)
        return [[self.words[i] for i in sorted(range(len(self.words)), key=lambda i: (-share[i, t], self.words[i]))[:n]] for t in range(share.shape[1])]

    def transform(self, df: DataFrame, output: str = "topics") -> DataFrame:
        """Adds the topics' shares as an array; equal ones for texts without known words. In Arrow batches, no exchange."""
        require(df, [self.text])
        topics = np.array(self.topics)
        beta, rounds, tol = _expected(topics.T).T, self.inner_rounds, self.tol
        shared = df.sparkSession.sparkContext.broadcast((self.words, beta))

        @F.arrow_udf("array<double>")
        def shares(texts: pa.Array) -> pa.Array:
            names, beta = shared.value
            known, k, out = pa.array(names, pa.string()), beta.shape[1], [np.zeros((0, beta.shape[1]))]
            for part in _texts(texts):
                words, counts, starts = _numbers(part, known)
                for i, j in _cuts(starts, ENTRIES):
                    own = slice(starts[i], starts[j])
                    weights = _weights(words[own], counts[own].astype(float), starts[i : j + 1] - starts[i], beta, 1 / k, rounds, tol)
                    out.append(weights / weights.sum(1, keepdims=True))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * k, pa.int32()), pa.array(np.concatenate(out).ravel()))

        return df.withColumn(output, shares(F.lower(F.col(f"`{self.text}`"))))

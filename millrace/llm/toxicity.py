"""Toxicity by a support vector machine over a subsequence string kernel (operator 12).

Texts are strings of symbols: letters without case and accents, digits, and gaps (a run of anything else is one gap). The
kernel of two windows counts subsequences of three and of four symbols that both hold; a subsequence may skip up to three
symbols or gaps, and each one skipped multiplies it by DECAY, so an insult with inserted characters still shares most of
its subsequences with the plain one. The machine is trained on windows of labelled sentences through Nystroem landmarks; because the
kernel is linear in subsequences, its decision folds to one weight a subsequence, and a text's score is that of its worst window.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, discard, filled, materialize, mix, ragged, text_chunks

#: Bits of a symbol, starts of subsequences in a window, what a skipped place costs, and positions scored at a time.
BITS, WINDOW, DECAY, BLOCK = 5, 10, 0.75, 1 << 15

#: The symbol of a gap; 0 stands for no symbol.
GAP = 31

#: What a virtual example costs beside a real one.
VIRTUAL = 1.0

#: Share of harmless sentences that a toxic one has to score above.
NEARLY_ALL = 0.99

#: Longest span of a subsequence of three symbols, and of four.
SPANS = {3: 6, 4: 7}

#: Gaps after every text, so that no window or subsequence reaches into the next one.
PAD = WINDOW + max(SPANS.values())


@cache
def _symbols() -> np.ndarray:
    """By code point: 1 to 26 for Latin letters whatever case and accents, 27 to 29 for other letters, 30 for digits, GAP for the rest."""
    out = np.full(0x110000, GAP, np.uint8)
    for c in range(0x3000):
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif chr(c).isalpha():
            out[c] = 27 + c % 3
        elif chr(c).isdigit():
            out[c] = 30
    out[0x3000:] = 27 + np.arange(0x3000, 0x110000) % 3
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by PAD gaps, and where each text starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(("\0" * PAD).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lens + PAD) - lens - PAD
    pads = np.ones(len(points), bool)
    pads[ragged(starts, lens)] = False
    s = _symbols()[points]
    s[pads] = 0
    keep = s != GAP
    keep[1:] |= s[:-1] != GAP
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


@cache
def shapes() -> tuple[tuple[tuple[int, ...], float], ...]:
    """Offsets of the later symbols of a subsequence and its weight, shorter ones first."""
    return tuple((o, DECAY ** (o[-1] + 1 - n)) for n, span in SPANS.items() for o in combinations(range(1, span), n - 1))


def subsequences(s: np.ndarray, n: int):
    """For every shape: its weight, and the number of the subsequence that starts at each of the first n positions (by table: 3 or 4 symbols)."""
    s = s.astype(np.int32)
    made = {(): s[:n]}
    for o, weight in shapes():
        for i in range(1, len(o) + 1):
            if o[:i] not in made:
                made[o[:i]] = (made[o[: i - 1]] << BITS) | s[o[i - 1] : o[i - 1] + n]
        yield len(o) + 1, weight, made[o]


@dataclass(frozen=True)
class Model:
    """Weights by subsequence (three symbols, four symbols), the bias, and the slope and offset that turn a margin into a probability."""

    tables: dict[int, np.ndarray]
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def sums(self, s: np.ndarray) -> np.ndarray:
        """Weight of all subsequences that start at a position."""
        out = np.zeros(len(s), np.float32)
        tail = np.concatenate([s, np.zeros(PAD, np.uint8)])
        for at in range(0, len(s), BLOCK):
            n = min(BLOCK, len(s) - at)
            for k, weight, number in subsequences(tail[at : at + n + PAD], n):
                out[at : at + n] += self.tables[k].take(number) * np.float32(weight)
        return out


def worst(sums, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the largest kernel value of its windows, by weights that `sums` gives for all symbols, and where that window starts among the symbols of all."""
    s, starts = symbols(texts)
    run, letters = np.concatenate([[0.0], np.cumsum(sums(s), dtype=np.float64)]), np.concatenate([[0], np.cumsum(s > 0)])
    to = np.minimum(np.arange(len(s)) + WINDOW, len(s))
    value = np.where(s > 0, (run[to] - run[:-1]) / np.sqrt(_size(letters[to] - letters[:-1])), -np.inf)
    value[starts[s[starts] == 0]] = 0.0  # a text without any symbol has one empty window
    best = np.maximum.reduceat(value, starts) if len(starts) else np.zeros(0)
    at = np.flatnonzero(value == np.repeat(best, np.diff(np.append(starts, len(s)))))
    return best, at[np.searchsorted(at, starts)]


def _size(letters):
    """What a window's kernel is divided by the root of: its letters, or a quarter of a window if it has fewer."""
    return np.maximum(letters, WINDOW // 4)


def _windows(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows at these positions: numbers of their subsequences over both tables (windows by places and shapes; -1 with a gap), the weights of the columns, and the sizes."""
    wide = np.concatenate([s, np.zeros(2 * PAD, np.uint8)])
    rows = wide[at[:, None] + np.arange(WINDOW + PAD)[None, :]].astype(np.int32)
    out, weights = [], []
    for o, weight in shapes():
        number, whole = rows[:, :WINDOW].copy(), rows[:, :WINDOW] > 0
        for x in o:
            nxt = rows[:, x : x + WINDOW]
            number, whole = (number << BITS) | nxt, whole & (nxt > 0)
        out.append(np.where(whole, number + (0 if len(o) == 2 else 1 << 3 * BITS), -1))
        weights += [weight] * WINDOW
    return np.concatenate(out, axis=1), np.array(weights, np.float32), _size((rows[:, :WINDOW] > 0).sum(axis=1)).astype(np.float32)


def stretched(s: np.ndarray, at: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Virtual examples of windows: half with a gap after every symbol, half with one strange symbol put in. Symbols of all, and where each starts."""
    wide = np.concatenate([s, np.zeros(PAD, np.uint8)])[at[:, None] + np.arange(WINDOW)[None, :]]
    out = np.zeros((len(at), 2 * WINDOW + PAD), np.uint8)
    out[:, 0 : 2 * WINDOW : 2], out[:, 1 : 2 * WINDOW : 2] = wide, np.where(wide > 0, GAP, 0)
    place, odd = draw.integers(2, WINDOW // 2, len(at)), np.arange(len(at)) % 2 == 1
    column = np.arange(WINDOW + 1)[None, :]
    moved = np.take_along_axis(wide, np.minimum(column - (column > place[:, None]), WINDOW - 1), axis=1)
    moved[np.arange(len(at)), place] = draw.integers(1, GAP + 1, len(at))
    out[odd] = 0
    out[odd, : WINDOW + 1] = moved[odd]
    return out.reshape(-1), np.arange(len(at)) * out.shape[1]


class Landmarks:
    """Windows that others are compared with: a matrix of their subsequences' weights, a row a subsequence."""

    def __init__(self, s: np.ndarray, at: np.ndarray):
        number, weights, size = _windows(s, at)
        known, row = np.unique(number, return_inverse=True)  # the first is -1 where any subsequence has a gap
        self.known, self.rows = known, np.zeros((len(known), len(at)), np.float32)
        np.add.at(self.rows, (row.reshape(number.shape), np.arange(len(at))[:, None]), (weights[None, :] / np.sqrt(size)[:, None]))
        self.rows[known < 0] = 0
        self.lookup = np.full((1 << 3 * BITS) + (1 << 4 * BITS), -1, np.int32)
        self.lookup[known[known >= 0]] = np.flatnonzero(known >= 0)

    def kernel(self, s: np.ndarray, at: np.ndarray, block: int = 64) -> np.ndarray:
        """Windows by landmarks."""
        out = np.zeros((len(at), self.rows.shape[1]), np.float32)
        for i in range(0, len(at), block):
            number, weights, size = _windows(s, at[i : i + block])
            row = np.where(number >= 0, self.lookup[number], -1)
            which, column = np.nonzero(row >= 0)
            if len(which):
                used, starts = np.unique(which, return_index=True)
                out[i + used] = np.add.reduceat(self.rows[row[which, column]] * weights[column][:, None], starts, axis=0)
            out[i : i + block] /= np.sqrt(size)[:, None]
        return out

    def fold(self, beta: np.ndarray) -> dict[int, np.ndarray]:
        """The decision of these weights of landmarks as one weight a subsequence."""
        flat = np.zeros(len(self.lookup), np.float32)
        some = self.known >= 0
        flat[self.known[some]] = self.rows[some] @ beta.astype(np.float32)
        return {3: flat[: 1 << 3 * BITS], 4: flat[1 << 3 * BITS :]}


def machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss and a cost for every row, by Newton steps. y: 1 or -1."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1).astype(np.float64)
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6
    value = lambda v: 0.5 * (ridge * v * v).sum() + (weight * np.maximum(1 - y * (x @ v), 0) ** 2).sum()
    v = np.zeros(x.shape[1])
    for _ in range(steps):
        short = 1 - y * (x @ v)
        on = short > 0
        gradient = ridge * v - 2 * x[on].T @ (weight[on] * y[on] * short[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * (x[on].T * weight[on]) @ x[on], gradient)
        size = 1.0
        while size > 1e-4 and value(v - size * step) > value(v):
            size /= 2
        v = v - size * step
        if np.abs(step).max() * size < 1e-6:
            break
    return v[:-1], float(v[-1])


def _runs(s: np.ndarray):
    """Runs of four and of six symbols that start at each position: their length, number (below 2^20, sixes by a hash), and whether all are symbols."""
    tail, n = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.int64), len(s)
    number, whole = s.astype(np.int64), s > 0
    for k in range(1, 6):
        number, whole = (number << BITS) | tail[k : k + n], whole & (tail[k : k + n] > 0)
        if k in (3, 5):
            yield k + 1, number if k == 3 else (number * 0x9E3779B1 >> 11) & 0xFFFFF, whole


def _contexts(s: np.ndarray, before: int = 5, after: int = 9) -> np.ndarray:
    """A hash of the symbols around each position."""
    wide = np.concatenate([np.zeros(before, np.uint8), s, np.zeros(after, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(s), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(before + after):
            out = out * BASE + wide[i : i + len(s)] + np.uint64(1)
        return mix(out)


class _Odds:
    """Start of the training: logarithms of how much more often runs of symbols stand in toxic documents than elsewhere.

    A run counts once a context, so copies and near copies of a text count once; a context that harmless ones have is
    harmless, and rare runs weigh little.
    """

    def __init__(self, texts: list[str], y: np.ndarray, shrink: float = 20.0):
        s, starts = symbols(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(s))))
        _, first, which = np.unique(_contexts(s), return_index=True, return_inverse=True)
        toxic = np.ones(len(first))
        np.minimum.at(toxic, which, y[owner])
        share, self.tables = toxic.mean(), {}
        for n, number, whole in _runs(s):
            some = whole[first]
            col = number[first][some]
            every, bad = np.bincount(col, minlength=1 << 20), np.bincount(col, weights=toxic[some], minlength=1 << 20)
            odds = np.log((bad + shrink * share) / (every + shrink) / share)
            self.tables[n] = (odds * every / (every + shrink)).astype(np.float32)

    def sums(self, s: np.ndarray) -> np.ndarray:
        return sum(self.tables[n][number] * whole for n, number, whole in _runs(s))


def train(texts: list[str], toxic: list[int], landmarks: int = 500, rounds: int = 5, cost: float = 0.1, windows: int = 1500, seed: int = 7) -> Model | None:
    """From sentences and the labels of their documents; None unless both labels occur.

    Most sentences of a toxic document are harmless, and some labels are wrong, so only those sentences of toxic documents
    count as toxic whose worst window has scored above nearly all worst windows of the others in some round; the first scores are
    log-odds of runs. Their worst windows are learnt from, and virtual examples of them with gaps and strange symbols, against
    random windows of the others and all windows of those that were among the worst in a round.
    """
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    draw = np.random.default_rng(seed)
    model, bad, good = _Odds(texts, y), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    s, starts = symbols(texts)
    inside = np.flatnonzero((s > 0) & (y[np.searchsorted(starts, np.arange(len(s)), side="right") - 1] == 0))
    neg = draw.choice(inside, min(windows, len(inside)), replace=False)
    pos, context = np.zeros(0, np.int64), _contexts(s)
    for _ in range(rounds):
        margin, at = worst(model.sums, texts)
        limit = np.quantile(margin[good], NEARLY_ALL)
        order = bad[np.argsort(-margin[bad], kind="stable")]
        chosen = order[: max(1, len(order) // 50, int((margin[order] > limit).sum()))]
        pos = np.union1d(pos, at[chosen])
        pos = pos[np.unique(context[pos], return_index=True)[1]]
        if len(pos) > windows:
            pos = np.sort(draw.choice(pos, windows, replace=False))
        hard = at[good[np.argsort(-margin[good], kind="stable")][:windows]]
        neg = np.concatenate([hard, neg[~np.isin(neg, hard)]])  # the worst of this round first
        virtual = np.concatenate([pos, neg[: len(pos)]])
        more, starts_more = stretched(s, virtual, draw)
        marks = Landmarks(s, np.concatenate([draw.permutation(pos)[: landmarks // 2], neg[: landmarks // 2]]))
        k = np.concatenate([marks.kernel(s, pos), marks.kernel(s, neg), marks.kernel(more, starts_more)])
        kind = np.concatenate([np.ones(len(pos)), -np.ones(len(neg)), np.ones(len(pos)), -np.ones(len(virtual) - len(pos))])
        weight = np.full(len(kind), cost)
        weight[len(pos) + len(neg) :] *= VIRTUAL
        values, vectors = np.linalg.eigh((marks.rows.T @ marks.rows).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
        v, bias = machine(k @ root, kind, weight)
        model = Model(marks.fold(root @ v), bias)
    return model


def calibrated(model: Model, bins: list[tuple[float, int, int]], rounds: int = 30, steps: int = 20) -> Model:
    """The model with slope and offset fitted to margins of documents: rows (margin, label, how many).

    Some labels 1 are wrong: a harmless document is labelled toxic with some probability, which is estimated along with the
    slope by expectation-maximisation; the curve is that of documents that are toxic.
    """
    m, y, n = (np.array(c, float) for c in zip(*bins))
    x, v, wrong = np.stack([m, np.ones(len(m))], axis=1), np.array([1.0, 0.0]), 0.01
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        target = y * p / (p + wrong * (1 - p))  # the chance that a document labelled toxic is
        wrong = float(np.clip((n * (y - target)).sum() / (n * (1 - target)).sum(), 1e-4, 0.5))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (n * (p - target)) + 1e-2 * v)
            v = v - step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
    return Model(model.tables, model.bias, max(float(v[0]), 0.0), float(v[1]))


def _fold(column: str, folds: int, held: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == held


def _share(column: Column, share: float, seed: int) -> Column:
    """About this share of values, by a hash."""
    return F.xxhash64(column, F.lit(seed)) / F.lit(2.0**64) + 0.5 < share


def labelled(docs: DataFrame, labels: DataFrame, sample: int, seed: int = 5) -> DataFrame:
    """Documents (i, t, toxic) of about `sample` labelled ids of each class, drawn by a hash of the id; labels other than 0 and 1 teach nothing.

    The drawn labels are broadcast: their number follows from `sample`, whatever the tables.
    """
    known = labels.where("i IS NOT NULL AND toxic IN (0, 1)").groupBy("i").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    cuts = [(F.col("toxic") == y) & _share(F.col("i"), min(1.0, sample / n), seed) for y, n in counts.items()]
    drawn = known.where(cuts[0] if len(cuts) == 1 else cuts[0] | cuts[1]) if cuts else known
    return docs.join(F.broadcast(drawn), "i")


def sentences(docs: DataFrame, longest: int = 400) -> DataFrame:
    """Distinct sentences (t) of texts and whether all their documents are toxic. Longer ones come in pieces that overlap by a window."""
    cut = docs.select(F.explode(F.split("t", r"(?<=[.!?])\s+|\n+")).alias("t"), "toxic").where("t RLIKE '\\\\p{L}'")
    at = F.sequence(F.lit(1), F.greatest(F.length("t") - WINDOW, F.lit(1)), F.lit(longest - WINDOW))
    return cut.select(F.explode(F.transform(at, lambda i: F.substr("t", i, F.lit(longest)))).alias("t"), "toxic").groupBy("t").agg(F.min("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, lines: int = 20000) -> Model | None:
    """Learns from documents (i, t) and labels (i, toxic).

    At most about `sample` labelled documents of each class are looked at, half of them for the machine and half for the
    calibration, and about `lines` sentences of each class go to the driver. None unless both labels occur.
    """
    held = materialize(labelled(docs.where("t IS NOT NULL"), labels, sample), "labelled")
    part = _share(F.col("i"), 0.7, 6)
    cut = materialize(sentences(held.where(part)), "sentences")
    counts = {r.toxic: r.n for r in cut.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) == 2:
        got = sorted((r.t, r.toxic) for y, n in counts.items() for r in cut.where(F.col("toxic") == y).where(_share(F.col("t"), min(1.0, lines / n), 8)).select("t", "toxic").collect())
        model = train([t for t, _ in got], [y for _, y in got])
        margin = F.round("margin", 2)
        rest = held.where(~part).select("t", "toxic")
        gapped = rest.withColumn("t", F.regexp_replace("t", r"(\p{L}{2,3})(?=\p{L}{2})", "$1*"))  # in every word: insults are to be told from harmless texts when so written, too
        bins = margins(rest.union(gapped), model, "toxic").groupBy(margin.alias("m"), "toxic").agg(F.count("*").alias("n")).collect()
        if len({r.toxic for r in bins}) == 2:
            model = calibrated(model, sorted((r.m, r.toxic, r.n) for r in bins))
    else:
        model = None
    discard(held, cut)
    return model


def margins(docs: DataFrame, model: Model, more: str) -> DataFrame:
    """Per row of docs (t and one more column): the margin of the text's worst window, and that column. One pass over whole texts, no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for every subsequence of four symbols: 4 MB

    def rows(batches):
        for chunk in text_chunks(batches, "t", limit=1 << 20):
            best = worst(shared.value.sums, filled(chunk.column("t")).to_pylist())[0] + shared.value.bias
            yield pa.RecordBatch.from_arrays([chunk.column(more), pa.array(best.astype(float))], names=[more, "margin"])

    return docs.select(more, "t").mapInArrow(rows, f"{more} {dict(docs.dtypes)[more]}, margin double")


def assess(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Learns from labelled rows outside the held-out fold (crc32 of doc_id as text, modulo `folds`). Rows without an id are
    neither held out nor learnt from; null and empty texts get the score of a text without a letter; very long texts are
    scored whole; repeated rows each get a row; an id with several labels counts as toxic if one is; labels that are null or
    not 0 or 1, and labels of no document, teach nothing; without both labels every score is 0; an empty table
    gives an empty one; other columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    model = fit(d.where(~_fold("i", folds, held)), labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("toxic")).where(~_fold("i", folds, held)))
    if model is None:
        score = d.select("i", F.lit(0.0).alias("score"))
    else:
        chance = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("margin") + F.lit(model.offset))))
        score = margins(d, model, "i").select("i", chance.alias("score"))
    return score.select(F.col("i").cast("bigint").alias("doc_id"), F.coalesce(_fold("i", folds, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

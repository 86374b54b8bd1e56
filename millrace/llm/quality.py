"""Quality rules as weak supervision (operator 6), in DataFrame functions alone.

Every rule votes for a document (+1), against it (-1) or abstains (0). Rows are pre-aggregated to counts of vote
patterns (3 to the power of the rules at most, whatever the corpus), over which expectation-maximisation estimates each
rule's accuracy on good and on bad documents and the share of good ones. A document is kept when its posterior
probability of being good reaches the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

#: Words of a window whose repetition counts.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Votes against where `bad`, for where `good`, else abstains. Both are SQL over the measures of `measured`."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CAST(CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END AS TINYINT)").alias(f"vote_{self.name}")


RULES = (
    Rule("length", "n_words < 10", "n_words >= 30"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    Rule("repeated_words", "n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    Rule("letters", "n_letters < 0.7 * word_chars", "n_letters > 0.85 * word_chars"),
    Rule("bare_words", "n_bare > 0.2 * n_words", "n_bare < 0.05 * n_words"),
    Rule("bullets", "n_bullets > 0.7 * n_lines", "n_bullets < 0.2 * n_lines"),
    Rule("ellipses", "n_ellipses > 0.3 * n_lines", "n_ellipses < 0.1 * n_lines"),
)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (_row, measures): the row as a struct, and what the rules look at. Null text: empty; all its measures are 0.

    Windows are told apart by a 64-bit hash of 64-bit word hashes, within one document only.
    """
    none = F.array().cast("array<bigint>")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("_row", "_t", F.filter(F.split("_t", SPACE), lambda x: x != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    d = d.select("_row", "_l", F.size("_w").cast("long").alias("n_words"), F.size(F.filter("_w", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare"), F.array_join("_w", "").alias("_j"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    d = d.select(
        "_row",
        "n_words",
        "n_bare",
        F.char_length("_j").cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_j", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("_j", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(…|\.\.\.)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipses"),
        F.when(F.col("n_words") >= WINDOW, F.slice(F.transform("_h", lambda x, i: F.xxhash64(x, *[F.get("_h", i + k) for k in range(1, WINDOW)])), F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))).otherwise(none).alias("_v"),
    )
    keep = [c for c in d.columns if c != "_v"]
    # Only where a window occurs twice are windows sorted; neighbours then show which ones.
    pair = "array<struct<h:bigint,i:int>>"
    d = d.select(*keep, F.when(F.size(F.array_distinct("_v")) < F.size("_v"), F.sort_array(F.transform("_v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast(pair)).alias("_s"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    d = d.select(*keep, F.sort_array(F.transform(F.filter("_s", lambda x, j: same(x, F.get("_s", j - 1)) | same(x, F.get("_s", j + 1))), lambda x: x["i"])).alias("_p"))
    covered = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    return d.select(*keep, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Model:
    """Share of good documents and each rule's probability of every vote by class: {vote: (good, bad)}."""

    names: tuple[str, ...]
    prior: float
    votes: tuple[dict[int, tuple[float, float]], ...]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of votes that are cast: how often for a good one, how often against a bad one."""
        return {n: (v[1][0] / (v[1][0] + v[-1][0]), v[-1][1] / (v[1][1] + v[-1][1])) for n, v in zip(self.names, self.votes)}

    def odds(self, pattern) -> float:
        return log(self.prior / (1 - self.prior)) + sum(log(v[x][0] / v[x][1]) for v, x in zip(self.votes, pattern))

    def posterior(self) -> Column:
        """Probability of being good, as an expression over the vote columns."""
        total = F.lit(log(self.prior / (1 - self.prior)))
        for n, v in zip(self.names, self.votes):
            c = F.col(f"vote_{n}")
            total = total + F.when(c == 1, log(v[1][0] / v[1][1])).when(c == -1, log(v[-1][0] / v[-1][1])).otherwise(log(v[0][0] / v[0][1]))
        return 1.0 / (1.0 + F.exp(-total))


def fit(voted: DataFrame, rules=RULES, rounds: int = 100, weight: float = 0.01) -> Model:
    """Expectation-maximisation over the counts of vote patterns.

    It starts from documents without a vote against them as good ones. `weight` of each class's documents is the weight of
    the belief that a vote is right nine times in ten, which keeps the two classes from changing places; a rule that votes
    alike on both weighs next to nothing. An empty table leaves that belief.
    """
    names = tuple(r.name for r in rules)
    cols = [f"vote_{n}" for n in names]
    # At most 3 ** len(rules) rows, whatever the corpus.
    rows = sorted((tuple(r[c] for c in cols), r["n"]) for r in voted.groupBy(*cols).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in rows)
    belief = {1: (0.9, 0.1), -1: (0.1, 0.9)}
    good = [0.05 if min(x) < 0 else 0.95 for x, _ in rows]
    model = Model(names, 0.8, tuple({**belief, 0: (1.0, 1.0)} for _ in names))
    for _ in range(rounds if rows else 0):
        ng = sum(g * n for g, (_, n) in zip(good, rows))
        prior = min(0.99, max(0.01, (ng + 0.8) / (total + 1)))
        trust = (weight * ng + 1, weight * (total - ng) + 1)
        votes = []
        for j in range(len(names)):
            sums = {v: [0.0, 0.0] for v in (-1, 0, 1)}
            for g, (x, n) in zip(good, rows):
                sums[x[j]][0] += g * n
                sums[x[j]][1] += (1 - g) * n
            # Abstaining says nothing about the class; a cast vote has the accuracy of its class.
            cast = [sums[1][k] + sums[-1][k] + trust[k] for k in (0, 1)]
            votes.append({0: (1.0, 1.0)} | {v: tuple(max(1e-4, (sums[v][k] + trust[k] * belief[v][k]) / cast[k]) for k in (0, 1)) for v in (1, -1)})
        model = Model(names, prior, tuple(votes))
        after = [1 / (1 + exp(-model.odds(x))) for x, _ in rows]
        moved = max(abs(a - b) for a, b in zip(after, good))
        good = after
        if moved < 1e-9:
            break
    return model


def voted(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    m = measured(docs, text_col)
    return m.select("*", *[r.vote() for r in rules])


def judge(marked: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds p_good, base_failed and kept to voted rows."""
    return marked.withColumn("p_good", model.posterior()).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def assess(docs: DataFrame, rules=RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good and the votes.

    Measures are written once and read for the fit and for the verdict. Null and empty texts fail; very long texts are measured whole; repeated rows each get
    their verdict; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = voted(slim, rules)
    names = [c for c in marked.columns if c != "_row"]
    marked = materialize(marked.select(F.col("_row.doc_id").alias("doc_id"), *names), "votes")
    out = judge(marked, fit(marked, rules), threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *[f"vote_{r.name}" for r in rules])


def keep_good(docs: DataFrame, rules=RULES, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that `assess` keeps, with their own columns: measured once for the fit and once for the verdict, so nothing is written or exchanged but vote counts."""
    marked = voted(docs, rules, text_col)
    model = fit(marked, rules)
    # A row number keeps the optimizer from moving the filter, and with it copies of all measures, below their projections.
    held = judge(marked, model, threshold).select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return held.where("kept AND _n >= 0").select("_row.*")

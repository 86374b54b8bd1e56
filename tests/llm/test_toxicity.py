"""Toxicity: the kernel against a plain version, planted insults, and odd tables."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import toxicity

from .helpers import SCHEMA

INSULTS = ["dunderhead", "nincompoop", "bufflewit"]
LABELS = "doc_id long, toxic int, text string, lang string"


def sentence(r, vocab):
    return " ".join(r.choice(vocab) for _ in range(r.randint(5, 12))).capitalize() + "."


def world(seed=3, n=500):
    """Documents of harmless sentences; in a third of them two sentences hold an insult. One toxic label in fifty is wrong."""
    r = random.Random(seed)
    vocab = ["".join(r.choice(["ka", "lo", "mi", "re", "su", "ta", "ne", "vo", "ir"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    docs, labels, insulting = [], [], []
    for i in range(n):
        lines = [sentence(r, vocab) for _ in range(r.randint(4, 9))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                words = r.choice(lines).split()
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
                lines.append(" ".join(words))
        docs.append((i, " ".join(lines), "en", "s", 1, "x", 1, 1))
        labels.append((i, int(bad or r.random() < 0.01), "odd", "odd"))
        insulting.append(bad)
    return docs, labels, insulting, vocab


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels, _, vocab = world()
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id AS i", "text AS t").repartition(3)
    return toxicity.fit(frame, spark.createDataFrame(labels, LABELS).selectExpr("doc_id AS i", "toxic")), vocab


def chances(model, texts):
    m = toxicity.worst(model.sums, texts)[0] + model.bias
    return 1 / (1 + np.exp(-(model.slope * m + model.offset)))


def test_held_out_documents(spark):
    docs, labels, insulting, _ = world()
    got = toxicity.assess(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    bad = [r.predicted for r in held if insulting[r.doc_id]]
    assert sum(bad) >= 0.95 * len(bad) and len(bad) > 30
    assert sum(r.predicted for r in held if not insulting[r.doc_id]) <= 1


@pytest.mark.parametrize("change,least", [(str.upper, 0.95), (lambda w: w[:4] + "*" + w[4:], 0.9), (lambda w: w[:3] + "x" + w[3:], 0.7), (lambda w: w[:5] + " " + w[5:], 0.7), (lambda w: w[:3] + w[2] + w[3:], 0.9)])
def test_gapped_insults(learnt, change, least):
    model, vocab = learnt
    r = random.Random(8)
    texts = []
    for _ in range(60):
        lines = [sentence(r, vocab) for _ in range(5)]
        words = lines[2].split()
        words.insert(3, change(r.choice(INSULTS)))
        lines[2] = " ".join(words)
        texts.append(" ".join(lines))
    assert (chances(model, texts) >= 0.7).mean() >= least
    harmless = [" ".join(sentence(r, vocab) for _ in range(6)) for _ in range(200)]
    assert (chances(model, harmless) >= 0.7).mean() <= 0.02


def plain_features(s):
    """Subsequences of the symbols that start in the first WINDOW places, with what their skips cost."""
    out = {}
    for at in range(min(toxicity.WINDOW, len(s))):
        for n, span in toxicity.SPANS.items():
            for rest in combinations(range(at + 1, min(at + span, len(s))), n - 1):
                key = tuple(s[i] for i in (at, *rest))
                out[key] = out.get(key, 0) + toxicity.DECAY ** (rest[-1] - at + 1 - n)
    return out


def test_kernel_equals_plain_version():
    texts = ["You silly Clown, go", "the cl.o*wn went", "ÉTÉ 42 chausson", "ab", "clown clown clown"]
    s, starts = toxicity.symbols(texts)
    marks = toxicity.Landmarks(s, starts)
    got = marks.kernel(s, starts)
    parts = [s[a:][: toxicity.WINDOW + max(toxicity.SPANS.values())] for a in starts]
    parts = [[int(x) for x in p[: np.argmax(p == 0)]] if (p == 0).any() else [int(x) for x in p] for p in parts]
    features = [plain_features(p) for p in parts]
    size = [max(min(len(p), toxicity.WINDOW), toxicity.WINDOW // 4) for p in parts]
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            assert got[i, j] == pytest.approx(sum(v * b.get(k, 0) for k, v in a.items()) / (size[i] * size[j]) ** 0.5, rel=1e-4)
    beta = np.arange(1.0, 6.0)
    model = toxicity.Model(marks.fold(beta), 0.0)
    sums = model.sums(s)
    for i, a in enumerate(starts):  # the folded decision is that of the landmarks
        assert sums[a : a + toxicity.WINDOW].sum() / size[i] ** 0.5 == pytest.approx(float(got[i] @ beta), rel=1e-3)


def test_symbols_keep_texts_apart():
    s, starts = toxicity.symbols(["", "A-- b", "", "é\t\tö9", "...", "😀 z"])
    cut = [s[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(s)])]
    pad = [0] * toxicity.PAD
    assert cut[0] == cut[2] == pad and cut[1] == [1, toxicity.GAP, 2, *pad] and cut[3] == [5, toxicity.GAP, 15, 30, *pad]
    alone = [toxicity.symbols([t])[0].tolist() for t in ["", "A-- b", "", "é\t\tö9"]]
    assert alone == cut[:4]


def test_scores_do_not_depend_on_neighbours(learnt):
    model, vocab = learnt
    r = random.Random(2)
    texts = [" ".join(sentence(r, vocab) for _ in range(3)) for _ in range(20)] + [INSULTS[0], "", "x", INSULTS[1] + " " + sentence(r, vocab) * 4000, "?!", INSULTS[2]]
    together = chances(model, texts)
    assert together == pytest.approx([float(chances(model, [t])[0]) for t in texts], abs=1e-4)


def test_odd_tables(spark):
    docs, labels, _, _ = world(5, 60)
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    assert toxicity.assess(d.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.assess(d, lab.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in toxicity.assess(d, lab.where("toxic = 0")).collect()} == {0}
    odd = [(None, "nothing", *[None] * 6), (7001, None, *[None] * 6), (7002, "", *[None] * 6), (7003, "!!", *[None] * 6), docs[1], docs[1], (7004, "abc " * 50000, *[None] * 6)]
    more = [(None, 1, "", ""), (1, None, "", ""), (2, 5, "", ""), (1, 1, "", ""), (1, 0, "", ""), (99999, 1, "", "")]
    got = toxicity.assess(d.union(spark.createDataFrame(odd, SCHEMA)), lab.union(spark.createDataFrame(more, LABELS))).collect()
    assert len(got) == 67 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    empty = {r.score for r in got if r.doc_id in (7001, 7002)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({(r.score, r.held_out) for r in got if r.doc_id == 1}) == 1

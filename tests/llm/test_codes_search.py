"""Vector codes and ranked search against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from millrace.llm import lexical_search, queries, vector_codes

from .helpers import corpus, frame

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, e int"


def vectors(seed=5, n=400, dims=8):
    """Few distinct values, so that distances tie; repeated rows, null ids and labels, odd components."""
    r = random.Random(seed)
    rows = [(i, [r.randint(-3, 3) / 1024 * 7.5 for _ in range(dims)], r.choice([0, 1, 1, 1, None]), "odd", 1, 2) for i in r.sample(range(-900, 900), n)]
    rows += [rows[0], rows[0], (None, [0.5] * dims, 1, "x", 0, 0), (None, [-0.25] * dims, None, "x", 0, 0)]
    odd = [None, [None] * dims, [0.1] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [float("-inf")] * dims]
    return rows + [(5000 + i, v, 1, "x", 0, 0) for i, v in enumerate(odd)]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * size : (p + 1) * size] for r in order] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        sums = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                x = v[p * size : (p + 1) * size]
                sums[p, near(p, x)[1]].append(x)
        for (p, k), xs in sums.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    coded = []
    for i, label, v in kept:
        got = [near(p, v[p * size : (p + 1) * size]) for p in range(parts)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
    total = Counter()
    for _, label, _, e in coded:
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, label, c, e in coded), key=repr)


@pytest.mark.parametrize("entries,n", [(256, 400), (40, 400), (256, 30)])
def test_codes_equal_plain_version(spark, entries, n):
    rows = vectors(n=n)
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, 4, entries, 3)


def test_codes_of_odd_tables(spark):
    rows = vectors()
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([r for r in rows if r[1] is None], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8, 0, "", 0, 0), (2, [1.0] * 4, 0, "", 0, 0)], VECTORS))
    with pytest.raises(ValueError, match="within"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 0, "", 0, 0)], VECTORS))


@pytest.mark.parametrize("seed", range(4))
def test_trees_find_what_a_scan_finds(seed):
    r = np.random.default_rng(seed)
    for entries, dims, wide in ((256, 16, 1000), (256, 2, 3), (17, 4, 2), (1, 3, 9), (200, 16, 1 << 28)):
        e, x = r.integers(-wide, wide + 1, (entries, dims)), r.integers(-wide, wide + 1, (300, dims))
        x[: min(entries, 50)] = e[: min(entries, 50)]
        d = ((x[:, None, :].astype(object) - e[None].astype(object)) ** 2).sum(-1) if wide > 1 << 20 else ((x[:, None] - e[None]) ** 2).sum(-1)
        got, best = vector_codes.nearest(vector_codes.build(e), x)
        assert [int(v) for v in best] == [int(v) for v in d.min(axis=1)]
        assert got.tolist() == [min(range(entries), key=lambda k, row=row: (row[k], k)) for row in d]


def test_trees_leave_branches_out(monkeypatch):
    """In clustered data most entries are never compared."""
    r = np.random.default_rng(0)
    e = r.integers(-(1 << 20), 1 << 20, (256, 4))
    x = e[r.integers(0, 256, 2000)] + r.integers(-50, 50, (2000, 4))
    seen, squared = [0], vector_codes._squared
    tree = vector_codes.build(e)
    monkeypatch.setattr(vector_codes, "_squared", lambda a, b: (seen.__setitem__(0, seen[0] + len(a) * len(b)), squared(a, b))[1])
    vector_codes.nearest(tree, x)
    assert seen[0] < len(x) * 256 / 4


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k):
    have = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in have:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((s, i))
        best = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string, score int, q int, rank int"


@pytest.mark.parametrize("k,held", [(20, 4096), (5, 7), (1, 3)])
def test_search_equals_plain_version(spark, k, held):
    rows = corpus(3, 120)
    r = random.Random(9)
    texts = [x[1] for x in rows if x[1]]
    items = [(i, " ".join(r.sample(r.choice(texts).split(), 1) + r.choice(texts).split()[:12]), 1, 2, 3) for i in range(25)]
    items += [(25, None, 0, 0, 0), (26, "", 0, 0, 0), (27, "nowhere", 0, 0, 0), (28, texts[0], 0, 0, 0), (28, texts[0], 0, 0, 0), (None, "X x", 0, 0, 0), (29, texts[1].upper(), 0, 0, 0)]
    got = lexical_search.search(frame(spark, rows), spark.createDataFrame(items, ITEMS), k=k, held=held)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_search([x[:2] for x in rows], [x[:2] for x in items], k)


def test_search_in_blocks_and_odd_tables(spark, monkeypatch):
    rows, items = corpus(4, 30), [(i, t, 0, 0, 0) for i, t in enumerate(["a b c", "x", "é d", "one A", None])]
    want = plain_search([x[:2] for x in rows], [x[:2] for x in items], 20)
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    assert sorted((tuple(x) for x in lexical_search.search(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()), key=repr) == want
    assert lexical_search.search(frame(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical_search.search(frame(spark, rows), spark.createDataFrame([], ITEMS)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None, *[None] * 6), (2, " .", *[None] * 6)]), spark.createDataFrame(items, ITEMS)).count() == 0


def test_search_probes_few_documents():
    """Frequent terms of little weight are non-essential once the best are known, and give no candidates."""
    size = 3000
    doc = np.concatenate([np.arange(size), np.arange(0, size, 500)])
    term = np.concatenate([np.zeros(size, int), np.ones(6, int)])
    corpus = lexical_search.Corpus(size, size * 20, np.array([1, 9000]))
    shard = lexical_search.Shard(np.arange(size), np.full(size, 20), doc, term, np.ones(len(doc), int), corpus)
    every, scores = shard.search(np.array([0, 1]), np.array([1, 1]), 1)
    assert len(every) == size
    some, best = shard.search(np.array([0, 1]), np.array([1, 1]), int(scores.max()))
    assert sorted(some) == list(range(0, size, 500)) and set(best) == {scores.max()}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_lexical_search"])
def test_sql(spark, name):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    try:
        for t in ("documents", "benchmark", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    except duckdb.IOException:
        pytest.skip("no test tables here")
    got = queries.queries()[name](spark, data)
    want = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())

"""Operators 3 and 9, and the pipeline, against plain versions."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import jaccard_join, substrings
from millrace.llm.common import BASE, components, mix

from .helpers import corpus, frame, words


def plain_repeats(rows, k):
    seen = Counter()
    for r in rows:
        w = words(r[1])
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def ordered(x):
    return sorted(x, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("k,m", [(35, 12), (6, 3), (1, 1)])
def test_repeats(spark, docs, rows, k, m):
    assert ordered(tuple(r) for r in substrings.digest(docs, k, m).collect()) == ordered(plain_repeats(rows, k))


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_few_words(spark, seed):
    """Texts over three words: runs, periods and branches everywhere."""
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("ab" if i % 3 else "abc") for _ in range(r.randint(0, 60))), None, None, 0, None, 0, 0) for i in range(12)]
    assert ordered(tuple(x) for x in substrings.digest(frame(spark, rows), 8, 3).collect()) == ordered(plain_repeats(rows, 8))


def test_repeats_odd_tables(spark, docs):
    assert substrings.digest(docs.limit(0)).count() == 0
    out = substrings.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    for r in docs.collect():
        if r.doc_id in (0, 1, 8):  # texts that share nothing stay as they are
            assert (r.doc_id, r.text) in kept


def test_chains_hold_every_window_once():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 4, 300).astype(np.uint64)
    offsets = np.array([0, 0, 40, 70, 71, 300])
    owner, start, size, anchor, content = substrings.chains(hashes, offsets, 35, 12)
    got = sorted((o, s + i) for o, s, n in zip(owner.tolist(), start.tolist(), size.tolist()) for i in range(n))
    assert got == sorted((o, i) for o in range(5) for i in range(offsets[o + 1] - offsets[o] - 34))


def test_colliding_hashes_take_no_text_away(spark, monkeypatch):
    """All chains of one length have the same hash: only what really repeats goes."""
    real = substrings.chains

    def collide(hashes, offsets, k=substrings.K, m=substrings.M):
        owner, start, size, anchor, content = real(hashes, offsets, k, m)
        return owner, start, size, np.zeros_like(anchor), np.zeros_like(content)

    monkeypatch.setattr(substrings, "chains", collide)
    r = random.Random(3)
    make = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(50))
    twice = make()
    rows = [(i, t, None, None, 0, None, 0, 0) for i, t in enumerate([make(), make(), make(), twice, twice])]
    got = {x.doc_id: x.n_removed for x in substrings.digest(frame(spark, rows)).collect()}
    assert [got[i] for i in range(3)] == [0, 0, 0] and got[3] == got[4]


def shingle_set(t, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_groups(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_groups(spark, docs, rows, k, percent):
    got = jaccard_join.near_groups(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda x: [(a is None, a or 0, n, c is None, c or 0) for a, n, c in x]
    assert sorted(key(map(tuple, got))) == sorted(key(plain_groups(rows, k, percent)))


@pytest.mark.parametrize("seed", range(2))
def test_groups_near_the_threshold(spark, seed):
    """Chains of edits whose ends are apart, at the threshold, in sizes around the size classes."""
    r = random.Random(seed)
    rows = []
    for size in (5, 20, 60, 70, 110, 300):
        w = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(9):
            for _ in range(max(1, size // 60)):
                w[r.randrange(size)] = f"e{r.randrange(10**6)}"
            if r.random() < 0.3:
                w = w + [f"x{r.randrange(10**6)}"]
            rows.append((len(rows), " ".join(w), None, None, 0, None, 0, 0))
    got = jaccard_join.digest(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_groups(rows, 4, 85))


def test_groups_in_many_cells(spark, monkeypatch):
    """A group of near copies that is split over R-tree cells."""
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(4):
            w[r.randrange(80)] = f"e{i}{r.random()}"
        rows.append((i, " ".join(w), None, None, 0, None, 0, 0))
    got = jaccard_join.digest(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_groups(rows, 4, 85))


def test_groups_odd_tables(spark, docs):
    assert jaccard_join.digest(docs.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.schema == docs.schema
    groups = {r.doc_id: r.component_id for r in jaccard_join.digest(docs).collect() if r.doc_id is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {d for d, c in groups.items() if d == c}


def test_tree_finds_all_that_the_bound_allows():
    r = np.random.default_rng(3)
    points = r.poisson(2, (200, jaccard_join.DIMS)).astype(np.uint8)
    sizes = points.sum(1, dtype=np.int64)
    tree = jaccard_join.Tree(points, sizes)
    for at_once in (1 << 14, 7):
        q, e = tree.search(points, sizes, 60, at_once)
        found = set(zip(q.tolist(), e.tolist()))
        assert len(found) == len(q)
        for i in range(0, 200, 17):
            bound = np.minimum(points, points[i]).sum(1)
            able = (bound >= jaccard_join.needed(sizes[i], sizes, 60)) & (100 * sizes >= 60 * sizes[i]) & (60 * sizes <= 100 * sizes[i])
            assert {(i, j) for j in np.flatnonzero(able).tolist()} <= found


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, one_task):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 3), (7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def repeated_rows():
    """Groups whose least id is repeated, shared by near copies, or missing in some or all rows."""
    r = random.Random(12)
    make = lambda n=200: [f"w{r.randrange(10**6)}" for _ in range(n)]
    near = lambda w, i: [*w[:i], "edit", *w[i + 1 :]]
    twice, with_null, shared, nulls, alone = make(), make(), make(), make(), make()
    groups = {
        "twice": [(1, twice, "s1"), (1, twice, "s1"), (1, twice, "s2"), (4, twice, "s1")],
        "with_null": [(None, with_null, "s1"), (2, with_null, "s1"), (None, near(with_null, 50), "s2")],
        "shared": [(3, shared, "s1"), (3, near(shared, 90), "s1")],
        "nulls": [(None, nulls, "s1"), (None, nulls, "s1"), (None, near(nulls, 3), "s1")],
        "alone": [(9, alone, "s1")],
    }
    rows = [(d, " ".join(w), "en", s, 0, name, 0, 0) for name, members in groups.items() for d, w, s in members]
    return rows + [(None, None, None, None, 0, "empty", 0, 0), (8, "", None, None, 0, "empty", 0, 0), (8, "", None, None, 0, "empty", 0, 0)]


def test_pipeline_keeps_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, repeated_rows()).select("doc_id", "text", "lang", "source", "n_chars", "kept")
    got = {}
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = docs.collect()
        assert Counter(r.kept for r in got[name]) == {"twice": 1, "with_null": 1, "shared": 1, "nulls": 1, "alone": 1, "empty": 3}
        assert {r.kept: (r.doc_id, len(words(r.text))) for r in got[name] if r.kept != "empty"} == {"twice": (1, 200), "with_null": (2, 200), "shared": (3, 200), "nulls": (None, 200), "alone": (9, 200)}


DATA = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus(5, 40) if r[0] is not None]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = first = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "substring_dedup", "source_mix", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.schema == first.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    near = [(r.doc_id, r.text, None) for r in kept["quality_rules"]]
    assert {r.doc_id for r in kept["near_duplicates"]} == {d for d, _, c in plain_groups(near, 5, 80) if d == c}
    want = {r[0]: r[1:3] for r in plain_repeats([(r.doc_id, r.text) for r in kept["near_duplicates"]], 35)}
    assert {r.doc_id: len(words(r.text)) for r in kept["substring_dedup"]} == {d: n - gone for d, (n, gone) in want.items()}
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"])
    assert {r.doc_id for r in kept["source_mix"]} == {r.doc_id for r in kept["best_fit_packing"]}


def test_pipeline_runs_on_odd_tables(spark, docs, rows, tmp_path):
    """run() over null ids, repeated rows, null, empty and long texts and columns of clashing names, and over an empty table."""
    import corpus_pipeline

    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows}
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        ends = [0]
        for offset, length in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["op3_substring_dedup", "op9_jaccard_join"])
def test_queries_with_sql(spark, name):
    import duckdb

    from millrace.llm import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(map(tuple, queries.queries()[name](spark, DATA).select(*names).collect())) == sorted(r.fetchall())


def hashes_by_group(n_groups, wanted, salt):
    """Hashes, `wanted[i]` of them in group i."""
    out, r = [], np.random.default_rng(salt)
    left = dict(enumerate(wanted))
    while any(left.values()):
        h = r.integers(0, 1 << 63, 4096).astype(np.uint64)
        with np.errstate(over="ignore"):
            group = (mix(h + BASE) % np.uint64(n_groups)).astype(int)
        for x, g in zip(h.tolist(), group.tolist()):
            if left.get(g, 0):
                left[g] -= 1
                out.append(x)
    return np.array(out, np.uint64)


def test_no_link_is_lost_where_only_empty_groups_are_equal():
    """Sets of 84 hashes, 78 shared, that fill a few groups only, each of which a difference touches."""
    lows, groups = jaccard_join._classes(85)
    kind = int(np.searchsorted(lows, 84, side="right")) - 1
    n_groups, used = int(groups[kind]), 6
    shared = hashes_by_group(n_groups, [78 // used] * used, 1)
    mine, yours = hashes_by_group(n_groups, [1] * used, 2), hashes_by_group(n_groups, [1] * used, 3)
    assert len(shared) == 78 and 100 * 78 >= 85 * 90
    both = [np.sort(np.concatenate([shared, x])) for x in (mine, yours)]
    keys, owners = jaccard_join.keys_of(np.concatenate(both), np.array([0, 84, 168]))
    assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    """Random pairs at the threshold, of all sizes from one shingle on."""
    r = np.random.default_rng(percent)
    for _ in range(400):
        n = int(r.integers(1, 40)) if r.random() < 0.7 else int(r.integers(40, 900))
        m = int(r.integers(n, 100 * n // percent + 1))
        overlap = int(jaccard_join.needed(n, m, percent))
        if overlap > n:
            continue
        every = r.integers(0, 1 << 63, n + m).astype(np.uint64)
        a, b = np.sort(every[:n]), np.sort(np.concatenate([every[:overlap], every[n : n + m - overlap]]))
        keys, owners = jaccard_join.keys_of(np.concatenate([a, b]), np.array([0, n, n + m]), percent)
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist()), (n, m)


def test_pairs_come_from_one_key(monkeypatch):
    """Pairs that meet under several keys come out once, whatever the batches."""
    import pyarrow as pa

    r = np.random.default_rng(4)
    points = r.poisson(1, (6, jaccard_join.DIMS)).astype(np.uint8)
    points[1:] = points[0]
    size, rows = int(points[0].sum()), []
    for key in (5, 7, 9):
        rows += [(key, 0, 0, 0, v, v % 3, size, points[v].tobytes(), [5, 7, 9] if v else [7, 9]) for v in range(6) if v or key > 5]
    names = ["key", "i", "j", "leaf", "node", "component", "n", "point", "keys"]
    table = pa.table({c: pa.array([x[k] for x in rows], pa.list_(pa.int64()) if c == "keys" else pa.binary() if c == "point" else pa.int64()) for k, c in enumerate(names)})
    want = sorted((x, y) for x in range(6) for y in range(x) if x % 3 != y % 3)
    for at in (1, 4, 100):
        out = pa.Table.from_batches(jaccard_join._tree_pairs(85)(iter(table.to_batches(at))))
        assert sorted((max(p), min(p)) for p in zip(out["x"].to_pylist(), out["y"].to_pylist())) == want

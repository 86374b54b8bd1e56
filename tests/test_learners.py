"""Boosted histograms, mixtures, truncated SVD and factorisation against plain versions."""

import warnings
from math import ceil, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.core import ConvergenceWarning, EmptyInputError, InvalidParameterError, SingularMatrixError
from millrace.operators import hist_boosting, truncated_svd
from millrace.operators.ensemble import RandomForestRegressor
from millrace.operators.factorization import NMF
from millrace.operators.hist_boosting import HistGradientBoosting
from millrace.operators.mixture import GaussianMixture
from millrace.operators.sparse import Sparse
from millrace.operators.truncated_svd import TruncatedSVD
from millrace.plans.flat import Flat
from millrace.plans.frame import medians, order_statistics


def listed(spark):
    """What lies in the scratch folder."""
    from millrace.plans.scratch import _file_system, root

    at, files = _file_system(spark, f"{root(spark)}/millrace")
    return {str(f.getPath().getName()) for f in files.listStatus(at)} if files.exists(at) else set()


def frame(spark, x, **more):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(*map(float, r), *(float(v[i]) for v in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in (*names, *more))).repartition(3), names


def test_order_statistics(spark):
    r = np.random.default_rng(1)
    x = np.stack([r.integers(0, 9, 500), r.normal(size=500)], axis=1)
    df, names = frame(spark, x)
    got = order_statistics(df, [F.col(n) for n in names], lambda n: (1, 7, 250, n))
    for j in range(2):
        assert got[j] == {k: sorted(x[:, j])[k - 1] for k in (1, 7, 250, 500)}
    assert medians(df.limit(0), [F.col("x0")]) == [None]
    assert medians(df, [F.when(F.lit(False), 1.0), F.col("x1")]) == [None, pytest.approx(np.median(x[:, 1]))]


def plain_hist(x, y, loss, rate, trees, depth, least, bins, l2):
    """Level by level on lists of rows; returns raw scores."""
    n = len(x)
    codes = np.full(x.shape, 255)
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        ends = np.unique([v[ceil(len(v) * q / bins) - 1] for q in range(1, bins)])
        ok = ~np.isnan(x[:, j])
        codes[ok, j] = [(ends < a).sum() for a in x[ok, j]]
    raw = np.full(n, y.mean() if loss == "squared_error" else np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = (raw - y, np.ones(n)) if loss == "squared_error" else (p - y, p * (1 - p))
        leaves = [np.arange(n)]
        for _ in range(depth):
            grown = []
            for rows in leaves:
                best = (0.0, None)
                score = lambda k: g[k].sum() ** 2 / (h[k].sum() + l2)
                for j in range(x.shape[1]):
                    for b in sorted(set(codes[rows, j]))[:-1]:
                        left, right = rows[codes[rows, j] <= b], rows[codes[rows, j] > b]
                        if min(len(left), len(right)) >= least:
                            gain = round(score(left) + score(right) - score(rows), 9)
                            if gain > best[0]:
                                best = (gain, (left, right))
                grown += [rows] if best[1] is None else best[1]
            leaves = grown
        for rows in leaves:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return raw


@pytest.mark.parametrize("loss,bins,l2", [("squared_error", 255, 0.0), ("squared_error", 7, 1.0), ("log_loss", 20, 0.5)])
def test_hist_boosting_equals_plain_version(spark, loss, bins, l2):
    r = np.random.default_rng(4)
    x = np.stack([r.normal(size=300), r.integers(0, 6, 300), r.normal(size=300).round(1)], axis=1)
    x[r.random(300) < 0.1, 0] = nan
    y = np.where(np.isnan(x[:, 0]), 3.0, x[:, 0]) + x[:, 1] * (x[:, 2] > 0)
    y = y if loss == "squared_error" else (y > np.median(y)).astype(float)
    df, names = frame(spark, x, label=y, i=np.arange(300))
    before = listed(spark)
    m = HistGradientBoosting(loss, 0.3, 10, 3, 8, l2, bins).fit(df, names)
    got = np.array([v.r for v in m.predict(df).withColumn("r", m.raw()).orderBy("i").collect()])
    assert got == pytest.approx(plain_hist(x, y, loss, 0.3, 10, 3, 8, bins, l2), abs=1e-6)
    assert listed(spark) == before
    assert sum(m.feature_importances) == pytest.approx(1) and m.score(df) > 0.8
    if loss == "log_loss":
        p = np.array([v.probability for v in m.predict_probabilities(df).orderBy("i").collect()])
        assert p.sum(1) == pytest.approx(1) and ((p[:, 1] >= 0.5) == np.array([v.prediction for v in m.predict(df).orderBy("i").collect()])).all()


def test_hist_boosting_odd_input(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (None, nan, 5.0), (inf, -inf, 5.0)], "x0 double, x1 double, label double")
    m = HistGradientBoosting(min_samples_leaf=1).fit(df, ["x0", "x1"])
    assert len(m.trees) == 1 and {r.prediction for r in m.predict(df).collect()} == {5.0}
    y = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (inf, 0.0), (-inf, 0.0), (nan, 1.0)], "x0 double, label double")
    m = HistGradientBoosting(min_samples_leaf=1, learning_rate=1.0, max_iter=2).fit(y, ["x0"])
    assert sorted(r.prediction for r in m.predict(y).collect()) == pytest.approx([0, 0, 0, 1, 1])  # missing values go right of all others
    with pytest.raises(EmptyInputError):
        HistGradientBoosting().fit(df.limit(0), ["x0"])
    for bad in (HistGradientBoosting(max_bins=256), HistGradientBoosting(loss="x"), HistGradientBoosting(max_depth=30), HistGradientBoosting(loss="log_loss")):
        with pytest.raises(InvalidParameterError):
            bad.fit(df, ["x0", "x1"])
    with pytest.raises(InvalidParameterError, match="labels"):
        HistGradientBoosting().fit(df.withColumn("label", F.lit(None).cast("double")), ["x0"])


def test_flat_trees_equal_expressions(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3)).round(1)
    df, names = frame(spark, x, label=x[:, 0] * x[:, 1])
    trees = list(RandomForestRegressor(n_trees=4, max_depth=5).fit(df, names).trees)
    odd = df.union(spark.createDataFrame([(None, nan, 1.0, 0.0), (inf, -inf, 0.0, 0.0)], df.schema))
    flat = Flat.of(trees, lambda n: [n.value, n.n]).column(names)
    whole = sum(t.column(names, lambda n: F.lit(float(n.value))) for t in trees)
    for row in odd.select(flat.alias("a"), whole.alias("b")).collect():
        assert row.a[0] == pytest.approx(row.b)


def plain_mixture(x, w, m, c, steps, reg):
    for _ in range(steps):
        logs = np.stack([np.log(w[k]) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(c[k])[1] + np.einsum("ij,jk,ik->i", x - m[k], np.linalg.inv(c[k]), x - m[k])) for k in range(len(w))], axis=1)
        r = np.exp(logs - logs.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        bound = (logs.max(1) + np.log(np.exp(logs - logs.max(1, keepdims=True)).sum(1))).mean()
        w = r.mean(0)
        m = np.stack([r[:, k] @ x / r[:, k].sum() for k in range(len(w))])
        c = np.stack([((x - m[k]) * r[:, k : k + 1]).T @ (x - m[k]) / r[:, k].sum() + reg * np.eye(x.shape[1]) for k in range(len(w))])
    return w, m, c, bound


def blobs(seed=3, n=600):
    r = np.random.default_rng(seed)
    parts = [r.multivariate_normal([0, 0, 0], np.diag([1, 4, 1]), n // 2), r.multivariate_normal([8, 1, -4], [[2, 1, 0], [1, 2, 0], [0, 0, 1]], n - n // 2)]
    return np.concatenate(parts), np.repeat([0, 1], [n // 2, n - n // 2])


def test_mixture_equals_plain_version(spark):
    x, _ = blobs()
    x = x + 1e4  # far from zero: sums are about the means
    df, names = frame(spark, x)
    start = (np.array([0.3, 0.7]), np.array([[1e4, 1e4, 1e4], [1e4 + 5.0, 1e4, 1e4 - 1]]), np.stack([np.eye(3) * 3, np.eye(3)]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        m = GaussianMixture(n_components=2, max_iter=7, tol=0.0).fit(df, names, start)
    w, mu, c, bound = plain_mixture(x, *start, 7, 1e-6)
    assert m.weights == pytest.approx(w, abs=1e-7) and np.array(m.means) == pytest.approx(mu, abs=1e-5) and np.array(m.covariances) == pytest.approx(c, abs=1e-4)
    assert m.lower_bound == pytest.approx(bound, abs=1e-6) and m.n_iter == 7 and not m.converged


@pytest.mark.parametrize("terms", [600, 0])
def test_mixture_finds_groups(spark, monkeypatch, terms):
    monkeypatch.setattr("millrace.operators.mixture.TERMS", terms)
    x, kind = blobs()
    df, names = frame(spark, x, kind=kind)
    before = listed(spark)
    m = GaussianMixture(n_components=2, seed=1).fit(df, names)
    assert listed(spark) - before <= {n for n in listed(spark) if n.startswith("kmeans")}
    assert m.converged and sorted(m.weights) == pytest.approx([0.5, 0.5], abs=0.03)
    got = m.predict(m.predict_probabilities(df)).select("kind", "prediction", "probability").collect()
    agree = np.mean([r.kind == r.prediction for r in got])
    assert max(agree, 1 - agree) > 0.99 and all(sum(r.probability) == pytest.approx(1) for r in got)
    assert m.score(df) >= m.lower_bound - 1e-9 and m.bic(df) > m.aic(df)
    more = GaussianMixture(n_components=1).fit(df, names)
    assert more.bic(df) > m.bic(df)


def test_mixture_odd_input(spark):
    x, _ = blobs(n=20)
    df, names = frame(spark, x)
    with pytest.raises(InvalidParameterError):
        GaussianMixture(n_components=0).fit(df, names)
    with pytest.raises(InvalidParameterError):
        GaussianMixture(n_components=21).fit(df, names)
    with pytest.raises(InvalidParameterError):
        GaussianMixture(n_components=2).fit(df, names, ([1.0], [[0.0]], [[[1.0]]]))
    with pytest.raises(EmptyInputError):
        GaussianMixture().fit(df.limit(0), names)
    with pytest.raises(SingularMatrixError):
        GaussianMixture(reg_covar=0.0).fit(df.withColumn("x1", F.col("x0")), names)


def same_directions(a, b, close=1e-6):
    assert np.abs(np.sum(np.array(a) * np.array(b), axis=1)) == pytest.approx(np.ones(len(a)), abs=close)


@pytest.mark.parametrize("fan,block,every", [(16, 4096, 128), (2, 5, 0)])
def test_svd_equals_numpy(spark, monkeypatch, fan, block, every):
    monkeypatch.setattr(truncated_svd, "ALL", every)
    monkeypatch.setattr(truncated_svd, "FAN", fan)
    monkeypatch.setattr(truncated_svd, "BLOCK", block)
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 30)) @ np.diag(0.8 ** np.arange(30)) + 3
    df, names = frame(spark, x)
    before = listed(spark)
    m = TruncatedSVD(n_components=4, oversamples=6).fit(df.repartition(7), names)
    assert listed(spark) == before
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert m.singular_values == pytest.approx(s[:4], rel=1e-8)
    same_directions(m.components, v[:4])
    got = np.array([z.components for z in m.transform(df).collect()])
    assert np.sqrt((got**2).sum(0)) == pytest.approx(s[:4], rel=1e-7)


def test_svd_of_arrays_and_sparse_rows(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 12)) * (r.random((60, 12)) < 0.3)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    arrays = spark.createDataFrame([([float(a) for a in row],) for row in x], "e array<double>")
    m = TruncatedSVD(n_components=3, oversamples=9).fit_arrays(arrays, "e")
    assert m.singular_values == pytest.approx(s[:3], rel=1e-9)
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col int, value double")
    sparse = Sparse(60, 12, entries)
    n = TruncatedSVD(n_components=3, oversamples=9).fit_sparse(sparse)
    assert n.singular_values == pytest.approx(s[:3], rel=1e-9)
    same_directions(n.components, v[:3])
    got = {z.row: z.components for z in n.transform(sparse.row_views()).collect()}
    for i, z in got.items():
        assert np.array(z) == pytest.approx(x[i] @ np.array(n.components).T, abs=1e-9)


def test_svd_odd_input(spark):
    ones = spark.createDataFrame([([1.0, 2.0, 0.0],)] * 5, "e array<double>")
    m = TruncatedSVD(n_components=3).fit_arrays(ones, "e")  # rank one
    assert m.singular_values == pytest.approx([5.0, 0.0, 0.0], abs=1e-9)
    zeros = TruncatedSVD(n_components=2).fit_arrays(spark.createDataFrame([([0.0, 0.0],)] * 3, "e array<double>"), "e")
    assert zeros.singular_values == (0.0, 0.0)
    with pytest.raises(EmptyInputError):
        TruncatedSVD().fit(spark.createDataFrame([], "a double, b double"), ["a", "b"])
    for rows in ([([1.0, 2.0],), ([1.0],)], [([1.0, None],)], [(None,), ([1.0, 2.0],)]):
        with pytest.raises(InvalidParameterError):
            TruncatedSVD().fit_arrays(spark.createDataFrame(rows, "e array<double>"), "e")
    with pytest.raises(InvalidParameterError):
        TruncatedSVD(n_components=4).fit_arrays(ones, "e")


def test_nmf_equals_plain_updates(spark):
    r = np.random.default_rng(7)
    x = r.random((14, 9)) * (r.random((14, 9)) < 0.6)
    x[3] = 0
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(3, 3, 0.0)], "row long, col int, value double").repartition(3)
    before = listed(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        start = NMF(n_components=3, max_iter=1, tol=0.0, seed=5)
        m = NMF(n_components=3, max_iter=12, tol=0.0, seed=5).fit(Sparse(14, 9, entries))
    assert len(listed(spark) - before) == 2  # the model's factors
    held = entries.where("value <> 0")
    w0, h0 = (start._begin(held, side).collect() for side in ("row", "col"))
    w, h = np.zeros((14, 3)), np.zeros((9, 3))
    for a, rows in ((w, w0), (h, h0)):
        for z in rows:
            a[z.id] = [z.f0, z.f1, z.f2]
    losses = []
    for _ in range(12):
        h = h * (x.T @ w) / (h @ (w.T @ w) + 1e-12)
        losses.append(((x - w @ h.T) ** 2).sum())
        w = w * (x @ h) / (w @ (h.T @ h) + 1e-12)
    assert m.losses == pytest.approx(losses, rel=1e-8) and all(b < a for a, b in zip(m.losses, m.losses[1:]))
    places = spark.createDataFrame([(i, j) for i in range(14) for j in range(9)], "row long, col int")
    got = {(z.row, z.col): z.value for z in m.values(places).collect()}
    assert [got[i, j] for i in range(14) for j in range(9)] == pytest.approx((w @ h.T).reshape(-1), rel=1e-7, abs=1e-9)
    m.close()
    assert listed(spark) == before


def test_nmf_odd_input(spark):
    kind = "row long, col int, value double"
    for rows in ([], [(1, 1, 0.0)]):
        with pytest.raises(EmptyInputError):
            NMF().fit(Sparse(3, 3, spark.createDataFrame(rows, kind)))
    for value in (-1.0, nan):
        with pytest.raises(InvalidParameterError):
            NMF().fit(Sparse(3, 3, spark.createDataFrame([(0, 0, 1.0), (1, 1, value)], kind)))
    with pytest.raises(InvalidParameterError):
        NMF(n_components=65).fit(Sparse(3, 3, spark.createDataFrame([(0, 0, 1.0)], kind)))
    assert hist_boosting.REFRESH < 10  # the plain version above crosses a rewrite of the scores


def test_trees_in_tasks_and_by_levels_agree(spark, monkeypatch):
    """Nodes of few rows are finished in one task; the same trees come out where all are split by levels."""
    from millrace.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor
    from millrace.plans import cart

    r = np.random.default_rng(11)
    x = np.stack([r.integers(0, 12, 150), r.normal(size=150).round(2), r.normal(size=150)], axis=1)
    x[r.random(150) < 0.1, 1] = nan
    df, names = frame(spark, x, label=np.nan_to_num(x[:, 1]) * 2 + x[:, 0], c=r.integers(0, 3, 150))
    for config, label in ((DecisionTreeRegressor(max_depth=4), "label"), (DecisionTreeClassifier(max_depth=3, min_samples_leaf=4), "c"), (DecisionTreeClassifier(max_depth=3, criterion="entropy"), "c")):
        found = []
        for small in (1 << 16, 40, 0):
            monkeypatch.setattr(cart, "SMALL", small)
            before = listed(spark)
            tree = config.fit(df, names, label).root
            assert listed(spark) == before
            found.append([(n.feature, n.n, pytest.approx(n.threshold), pytest.approx(n.value), pytest.approx(n.gain, abs=1e-9)) for n in tree.walk()])
        assert found[0] == found[1] == found[2]


def test_deep_trees_and_missing_values(spark):
    from millrace.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor

    df = spark.createDataFrame([(float(i), float(i)) for i in range(70)], "a double, label double")
    m = DecisionTreeClassifier().fit(df, ["a"])
    assert {r.prediction == r.label for r in m.predict(m.predict_probabilities(df)).collect()} == {True}
    chain = spark.createDataFrame([(float(i), 3.0**i) for i in range(70)], "a double, label double")
    t = DecisionTreeRegressor().fit(chain, ["a"])
    assert t.root.depth() == 69 and all(r.prediction == pytest.approx(r.label) for r in t.predict(chain).collect())
    odd = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (nan, 1.0), (None, 1.0), (inf, 0.0)], "a double, label double")
    m = DecisionTreeClassifier().fit(odd, ["a"])
    assert [r.prediction == r.label for r in m.predict(odd).collect()] == [True] * 5
    with pytest.raises(InvalidParameterError, match="classes"):
        DecisionTreeClassifier().fit(spark.range(5000).selectExpr("CAST(id AS double) AS a", "CAST(id AS double) AS label"), ["a"])


def test_forests_and_boosting_leave_nothing(spark, monkeypatch):
    from millrace.operators.ensemble import GradientBoostingRegressor, RandomForestClassifier
    from millrace.plans import flat

    r = np.random.default_rng(12)
    x = r.normal(size=(120, 3)).round(1)
    df, names = frame(spark, x, label=(x[:, 0] > 0) + (x[:, 1] > 0))
    before = listed(spark)
    forest = RandomForestClassifier(n_trees=5, max_depth=4).fit(df, names)
    boosted = GradientBoostingRegressor(n_trees=3, subsample=0.7).fit(df, names)
    assert listed(spark) == before
    want = [(a.prediction, a.probability, a.b) for a in boosted.predict(forest.predict(forest.predict_probabilities(df)), "b").orderBy(*names, "label").collect()]
    monkeypatch.setattr(flat, "EXPRESSION_NODES", 0)
    got = [(a.prediction, a.probability, a.b) for a in boosted.predict(forest.predict(forest.predict_probabilities(df)), "b").orderBy(*names, "label").collect()]
    assert [w[0] for w in want] == [g[0] for g in got]
    assert np.array([[*w[1], w[2]] for w in want]) == pytest.approx(np.array([[*g[1], g[2]] for g in got]))


@pytest.mark.parametrize("dims,values,block", [(1, 5, 8), (2, 30, 16), (3, 4, 8), (6, 1000, 16)])
def test_neighbours_by_space_equal_brute_force(spark, monkeypatch, dims, values, block):
    """Ties, equal rows, queries outside all cells, a cell that most queries fall into."""
    from millrace.operators import neighbors

    r = np.random.default_rng(dims)
    t = r.integers(0, values, (300, dims)).astype(float)
    t[:90] = t[0]
    q = np.concatenate([r.integers(-values, 2 * values, (60, dims)), t[:1].repeat(60, 0)]).astype(float)
    train, names = frame(spark, t, row_id=np.arange(300))
    asked, _ = frame(spark, q, row_id=np.arange(len(q)))
    monkeypatch.setattr(neighbors, "BLOCK", block)
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    for k, small in ((4, 0), (4, 1 << 20), (13, 0)):
        monkeypatch.setattr(neighbors, "SMALL", small)
        got = neighbors.neighbours(train, asked, k, F.array(*names), "row_id", "row_id")
        assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
        rows = sorted((x.query, x["rank"], x.neighbour, round(x.distance, 9)) for x in got.collect())
        want = [(i, j + 1, int(n), round(float(d[i, n]), 9)) for i in range(len(q)) for j, n in enumerate(sorted(range(300), key=lambda n: (d[i, n], n))[:k])]
        assert rows == want


@pytest.mark.parametrize("lines,copies", [(25, 1), (25, 60), (1, 20_000)])
def test_neighbours_look_at_few_rows(monkeypatch, lines, copies):
    """Work a query does not grow with the rows, nor with copies of them; results are those of all rows."""
    from millrace.operators import neighbors

    r = np.random.default_rng(lines)
    t = np.stack([r.random(20_000 // copies) * 10, r.integers(0, lines, 20_000 // copies)], 1).repeat(copies, 0)
    ids, q = r.permutation(len(t)), np.stack([r.random(300) * 12 - 1, r.integers(0, 25, 300)], 1)
    seen, leaves = [], neighbors._Tree._leaves

    def counted(tree, leaf, x):
        got = leaves(tree, leaf, x)
        seen.append(got[0].size)
        return got

    monkeypatch.setattr(neighbors._Tree, "_leaves", counted)
    at, found, d = neighbors._Tree(ids, t, 5).nearest(q)
    assert sum(seen) < 1000 * len(q)
    every = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(ids, every.shape), every), axis=1)[:, :5]
    assert (at == np.arange(300).repeat(5)).all() and (found == ids[order].reshape(-1)).all() and (d == np.take_along_axis(every, order, 1).reshape(-1)).all()


def test_neighbours_search_all_rows_once_a_pattern(monkeypatch):
    """Queries with null or infinite values are at infinite distance, or none, of all rows: equal patterns of such values share one search."""
    from millrace.operators import neighbors

    r = np.random.default_rng(4)
    t, x, ids = r.integers(0, 50, (3000, 2)).astype(float), r.random((900, 2)), r.permutation(3000)
    t[r.choice(3000, 3, replace=False), 0] = np.inf
    x[::3, 0], x[1::9, 1], x[2::9, 0] = np.nan, np.inf, np.inf
    reach = np.where(np.arange(900) % 2, np.inf, 5.0)
    searched, every = [], neighbors._Tree._all

    def counted(tree, q, bound):
        searched.append(len(q))
        return every(tree, q, bound)

    monkeypatch.setattr(neighbors._Tree, "_all", counted)
    at, found, d = neighbors._Tree(ids, t, 5).nearest(x, reach)
    assert sum(searched) <= 6
    want = {}
    with np.errstate(invalid="ignore"):
        for i in np.flatnonzero(~np.isfinite(x).all(1)):
            far = np.sqrt(((x[i] - t) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if not far[j] > reach[i]][:5]
            want[i] = [*ids[order]], [*far[order]]
    assert {len(w[0]) for w in want.values()} == {0, 3, 5}
    for i, (rows, far) in want.items():
        assert [*found[at == i]] == rows and np.array_equal(d[at == i], far, equal_nan=True)


def test_neighbours_of_one_partition_are_dealt(spark):
    from millrace.operators import neighbors

    df, names = frame(spark, np.arange(40.0).reshape(-1, 2), row_id=np.arange(20))
    got = neighbors.neighbours(df, df.coalesce(1), 2, F.array(*names), "row_id", "row_id")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()


def test_grid_search_marks_all_of_equal_means(spark, tmp_path):
    """One user: no feature to shrink, so every alpha has the same mean."""
    import duckdb

    import millrace.queries as core

    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (1 AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = core.queries()["grid_search"](spark, str(tmp_path)).select("alpha", "best").collect()
    assert sorted(tuple(r) for r in got) == sorted(c.execute(f"SELECT alpha, best FROM ({core.oracle_sql()['grid_search']})").fetchall()) == [(100.0, True), (1e7, True), (1e9, True)]


def test_topics_settle_in_few_products(monkeypatch):
    """Documents of similar length go through a round together; passes are dealt to all tasks."""
    from millrace.operators import topics

    r = np.random.default_rng(2)
    beta = topics._expected(r.gamma(100, 0.01, (4, 300))).T
    sizes = np.concatenate([[0], r.integers(1, 120, 300), [0]])
    starts, words = np.append(0, np.cumsum(sizes)), np.concatenate([np.sort(r.choice(300, n, replace=False)) for n in sizes])
    counts, calls, settled = r.integers(1, 5, len(words)).astype(float), [], topics._settled
    monkeypatch.setattr(topics, "_settled", lambda *x: calls.append(len(x[0])) or settled(*x))
    weights, add = topics.infer(words, counts, starts, beta, 0.25, 50, 1e-3)
    assert sum(calls) == 300 and len(calls) < 10 and (weights[[0, -1]] == 0.25).all()
    for d in range(1, 301):
        w, own, times = np.ones(4), beta[words[starts[d] : starts[d + 1]]], counts[starts[d] : starts[d + 1]]
        for _ in range(50):
            e = topics._expected(w[None])[0]
            new = 0.25 + e * (own.T @ (times / (own @ e)))
            moved, w = np.abs(new - w).mean(), new
            if moved < 1e-3:
                break
        assert weights[d] == pytest.approx(w, rel=1e-9)
        assert add[starts[d] : starts[d + 1]].sum() == pytest.approx((topics._expected(w[None])[0] * (times / (own @ topics._expected(w[None])[0]))[:, None]).sum(), rel=1e-9)


def test_density_prediction_meets_no_pairs_of_rows(spark):
    """Nearest core row, the earlier of equals; no join deals every core row around to every row asked."""
    from millrace.operators.cluster import DBSCAN

    r = np.random.default_rng(3)
    t = np.concatenate([r.integers(0, 12, (200, 2)) * 0.5, r.integers(30, 42, (200, 2)) * 0.5]).repeat(2, 0)
    q = r.integers(-2, 46, (150, 2)) * 0.5 + r.choice([0, 0.25], (150, 2))
    df, names = frame(spark, t, row_id=np.arange(len(t)))
    asked, _ = frame(spark, q, row_id=np.arange(len(q)))
    m = DBSCAN(0.8, 4).fit(df, names)
    got = m.predict(asked)
    assert "explode" not in got._jdf.queryExecution().toString().lower()
    cores = [(x.i, x.cluster, x.x0, x.x1) for x in m.cores.collect()]
    want = []
    for a, b in q:
        d, _, c = min(((a - x) ** 2 + (b - y) ** 2, i, c) for i, c, x, y in cores)
        want.append(c if d**0.5 <= 0.8 else -1)
    assert len(set(want)) > 2 and [x.prediction for x in got.orderBy("row_id").collect()] == want


@pytest.mark.parametrize("name", ["knn_classifier_distance", "knn_classifier_uniform", "knn_regressor_distance", "knn_regressor_uniform"])
def test_neighbours_of_repeated_tables(spark, tmp_path, name):
    """Copies of the rows under other keys: ties by key, as in SQL."""
    import duckdb

    import millrace.queries as core

    c = duckdb.connect()
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        c.execute(f"COPY (SELECT t.* REPLACE (t.{key} + r.range * 100000 AS {key}) FROM '/root/testdata/sf0.001/{table}.parquet' AS t, range(7) AS r) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = [tuple(r) for r in core.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(core.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["knn_classifier_distance", "knn_classifier_uniform", "knn_regressor_distance", "knn_regressor_uniform"])
def test_neighbours_of_missing_values(spark, tmp_path, name):
    """Customers without balance, nation or both: as in SQL."""
    import duckdb

    import millrace.queries as core

    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS c_nationkey) FROM '/root/testdata/sf0.001/customer.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    c.execute(f"COPY (FROM '/root/testdata/sf0.001/supplier.parquet') TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    for table in ("customer", "supplier"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = [tuple(r) for r in core.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(core.oracle_sql()[name]).fetchall())


def plain_topics(docs, words, topics, passes, rounds, tol):
    """Document by document."""
    from math import lgamma

    slope = lambda x: (lgamma(x + 1e-5) - lgamma(x - 1e-5)) / 2e-5
    k = topics.shape[1]
    share = lambda row: np.exp([slope(v) - slope(row.sum()) for v in row])
    for _ in range(passes):
        beta = np.stack([share(topics[:, t]) for t in range(k)], axis=1)
        sums = np.zeros(topics.shape)
        for d in docs:
            ids = sorted({words.index(w) for w in d if w in words})
            if not ids:
                continue
            counts = np.array([sum(w == words[i] for w in d) for i in ids], float)
            weights = np.ones(k)
            for _ in range(rounds):
                theta = share(weights)
                new = 1 / k + theta * ((counts / (beta[ids] @ theta)) @ beta[ids])
                moved, weights = np.abs(new - weights).mean(), new
                if moved < tol:
                    break
            theta = share(weights)
            sums[ids] += np.outer(counts / (beta[ids] @ theta), theta)
        topics = 1 / k + sums * beta
    return topics


def topic_docs(seed=1, n=80):
    r = np.random.default_rng(seed)
    sets = [[f"{c}{a}{b}" for a in "abcdef" for b in "xyz"] for c in "klm"]
    kind = r.integers(0, 3, n)
    return [" ".join(r.choice(sets[k] if r.random() < 0.9 else sets[(k + 1) % 3]) for _ in range(r.integers(20, 60))) for k in kind], kind, sets


@pytest.mark.parametrize("entries", [1 << 16, 40])
def test_topics_equal_plain_version(spark, monkeypatch, entries):
    from millrace.operators import topics

    monkeypatch.setattr(topics, "ENTRIES", entries)
    assert topics.digamma(np.array([1.0, 0.1, 30.0])) == pytest.approx([-0.5772156649015329, -10.423754940411076, 3.38443813265855], rel=1e-10)
    docs, _, _ = topic_docs(n=20)
    df = spark.createDataFrame([(d,) for d in [*docs, None, "", "Kax kax, 12 unknownword!"]], "text string").repartition(3)
    before = listed(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        m = topics.LatentDirichlet(n_topics=3, max_iter=2, seed=4, tol=1e-6).fit(df)
    assert listed(spark) == before and "unknownword" not in m.words
    start = np.random.default_rng(4).gamma(100.0, 0.01, (len(m.words), 3))
    want = plain_topics([d.split() for d in [*docs, "kax kax"]], list(m.words), start, 2, 100, 1e-6)
    assert np.array(m.topics) == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("batches", [1, 3])
def test_planted_topics_are_found(spark, batches):
    from millrace.operators.topics import LatentDirichlet

    docs, kind, sets = topic_docs(n=150)
    df = spark.createDataFrame([(d, int(k), 0) for d, k in zip(docs, kind)] + [(None, -1, 0), ("", -1, 0)], "text string, kind int, words int").repartition(3)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        m = LatentDirichlet(n_topics=3, max_iter=15, batches=batches, offset=1.0, seed=2).fit(df)
    tops = [set(t) for t in m.top_words(12)]
    assert sorted(max(range(3), key=lambda s: len(t & set(sets[s]))) for t in tops) == [0, 1, 2] and all(max(len(t & set(s)) for s in sets) >= 11 for t in tops)
    got = m.transform(df).select("kind", "topics").collect()
    assert all(sum(r.topics) == pytest.approx(1) for r in got) and all(r.topics == pytest.approx([1 / 3] * 3) for r in got if r.kind < 0)
    pairs = {(r.kind, int(np.argmax(r.topics))) for r in got if r.kind >= 0}
    assert len(pairs) == 3


def test_topics_odd_input(spark):
    from millrace.operators.topics import LatentDirichlet

    df = spark.createDataFrame([("a b",), (None,)], "text string")
    for bad in (LatentDirichlet(n_topics=0), LatentDirichlet(decay=0.2), LatentDirichlet(vocabulary=1 << 24)):
        with pytest.raises(InvalidParameterError):
            bad.fit(df)
    for rows in (df, df.limit(0)):
        with pytest.raises(EmptyInputError):
            LatentDirichlet().fit(rows)


def test_topic_words_and_copies(spark):
    """Texts are split in Arrow, not by a regular expression for each row; texts of the same counts are one row of the table that passes read."""
    import re

    import pyarrow as pa

    from millrace.operators import topics

    texts = ["a b  a", None, "", "b,a a", "ab\ta-b, c", "Äpfel äpfel über1über", "ñ" * 3 + " 中文 中文,x", " ", "12 ,.", "c c c " * 50, "no known word"]
    known = sorted({"a", "b", "ab", "äpfel", "über", "ñññ", "中文"})
    lower = [t if t is None else t.lower() for t in texts]
    found = [re.findall(r"[^\W\d_]+", t or "") for t in lower]
    words, counts, starts = topics._numbers(pa.array(lower), pa.array(known))
    for i, f in enumerate(found):
        want = [(n, f.count(w)) for n, w in enumerate(known) if w in f]
        assert list(zip(words[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]])) == want
    names, n = topics._holders(pa.array(lower))
    assert dict(zip(names.to_pylist(), n.tolist())) == {w: sum(w in f for f in found) for f in found for w in f}
    assert not len(topics._holders(pa.array([None, ""], pa.string()))[0]) and not len(topics._numbers(pa.array([], pa.string()), pa.array(known))[0])
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = {(tuple(r.words), tuple(r.counts)): r.copies for r in topics.counted(df, known).collect()}
    assert rows[(known.index("a"), known.index("b")), (2, 1)] == 2 and sum(rows.values()) == 5
    docs, _, _ = topic_docs(n=12)
    held, real = [], topics.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topics, "materialize", lambda d, name: held.append(real(d, name)) or held[-1])
        patch.setattr(topics, "discard", lambda *x: held.append(sorted(r.copies for r in x[0].collect())))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", ConvergenceWarning)
            m = topics.LatentDirichlet(n_topics=3, max_iter=2, seed=4, tol=1e-6).fit(spark.createDataFrame([(d + "." * i,) for d in docs for i in range(5)] + [(docs[0],)], "text string").repartition(4))
    assert held[1] == [5] * 11 + [6] and spark.conf.get(topics.TASKS, None) is None
    start = np.random.default_rng(4).gamma(100.0, 0.01, (len(m.words), 3))
    assert np.array(m.topics) == pytest.approx(plain_topics([d.split() for d in docs for _ in range(5)] + [docs[0].split()], list(m.words), start, 2, 100, 1e-6), rel=1e-4)
    assert "regexp" not in m.transform(df.withColumnRenamed("t", "text"))._jdf.queryExecution().toString()


def plain_isotonic(x, y, w):
    """The min-max formula at every distinct value."""
    values = np.unique(x)
    s = np.array([(w * y)[x == v].sum() for v in values])
    c = np.array([w[x == v].sum() for v in values])
    mean = lambda a, b: s[a : b + 1].sum() / c[a : b + 1].sum()
    n = len(values)
    return values, [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "cliff"])
@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_isotonic_equals_min_max(spark, monkeypatch, shape, one_task):
    from millrace.operators import isotonic
    from millrace.operators.isotonic import IsotonicRegression

    monkeypatch.setattr(isotonic, "ONE_TASK", one_task)
    r = np.random.default_rng(3)
    x = r.integers(0, 60, 150) / 4
    y = {"noise": x / 3 + r.normal(size=150) * 2, "rising": x * 2, "falling": -x, "cliff": np.where(x < 9, x, x - 20)}[shape]
    w = r.integers(1, 4, 150).astype(float)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(x, y, w)], "x double, label double, w double").repartition(3)
    before = listed(spark)
    m = IsotonicRegression().fit(df, "x", weight="w")
    assert listed(spark) == before
    values, want = plain_isotonic(x, y, w)
    ask = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {v.x: v.prediction for v in m.predict(ask).collect()}
    assert [got[v] for v in values] == pytest.approx(want)
    down = IsotonicRegression(increasing=False).fit(df.withColumn("label", -F.col("label")), "x", weight="w")
    got = {v.x: v.prediction for v in down.predict(ask).collect()}
    assert [-got[v] for v in values] == pytest.approx(want)


def test_isotonic_odd_input(spark):
    from millrace.operators.isotonic import IsotonicRegression

    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (4.0, 6.0), (-0.0, 0.0), (0.0, 1.0)], "x double, label double")
    m = IsotonicRegression().fit(df, "x")
    ask = spark.createDataFrame([(None,), (nan,), (-9.0,), (9.0,), (3.0,), (0.0,)], "x double")
    assert [r.prediction for r in m.predict(ask).collect()] == [None, None, 0.5, 6.0, 4.0, 0.5]
    assert [r.prediction for r in IsotonicRegression(outside="null").fit(df, "x").predict(ask).collect()] == [None, None, None, None, 4.0, 0.5]
    with pytest.raises(EmptyInputError):
        IsotonicRegression().fit(df.limit(0), "x")
    for bad in (df.union(spark.createDataFrame([(None, 1.0)], df.schema)), df.union(spark.createDataFrame([(1.0, nan)], df.schema))):
        with pytest.raises(InvalidParameterError):
            IsotonicRegression().fit(bad, "x")
    with pytest.raises(InvalidParameterError):
        IsotonicRegression().fit(df.withColumn("w", F.lit(0.0)), "x", weight="w")


def plain_expected(a, b, n):
    """Exact fractions over all ways."""
    from fractions import Fraction
    from math import comb, log

    out = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                out += float(Fraction(comb(x, k) * comb(n - x, y - k), comb(n, y))) * k / n * log(n * k / (x * y))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_agreement_equals_plain_version(spark, seed):
    from collections import Counter
    from math import comb, log

    from millrace.operators import agreement

    r = np.random.default_rng(seed)
    a, b = r.integers(0, 5, 80).tolist(), r.integers(0, 4, 80).tolist()
    b = [x if r.random() < 0.5 else y for x, y in zip(a, b)]
    rows = [(x if x else None, y, 1) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "label int, prediction int, n int").repartition(3)
    t, na, nb, n = Counter(zip(a, b)), Counter(a), Counter(b), 80
    pairs = lambda c: sum(comb(v, 2) for v in c.values())
    chance = pairs(na) * pairs(nb) / comb(n, 2)
    mi = sum(v / n * log(v * n / (na[x] * nb[y])) for (x, y), v in t.items())
    entropy = lambda c: -sum(v / n * log(v / n) for v in c.values())
    assert agreement.adjusted_rand(df) == pytest.approx((pairs(t) - chance) / ((pairs(na) + pairs(nb)) / 2 - chance))
    assert agreement.normalized_mutual_information(df) == pytest.approx(2 * mi / (entropy(na) + entropy(nb)))
    expected = plain_expected(na.values(), nb.values(), n)
    assert agreement.adjusted_mutual_information(df) == pytest.approx((mi - expected) / ((entropy(na) + entropy(nb)) / 2 - expected))


def test_agreement_odd_input(spark):
    from millrace.operators import agreement

    kind = "label int, prediction string"
    same = spark.createDataFrame([(i % 4, str(i % 4)) for i in range(20)] + [(None, None)], kind)
    one = spark.createDataFrame([(1, "x")] * 5, kind)
    apart = spark.createDataFrame([(i, str(i)) for i in range(6)], kind)
    for df in (same, one, apart):
        assert agreement.adjusted_rand(df) == pytest.approx(1) and agreement.adjusted_mutual_information(df) == pytest.approx(1)
    row = agreement.agreement_table(same.limit(0)).first()
    assert row.n == 0 and row.adjusted_rand is None and row.homogeneity is None and row.v_measure is None
    for f in (agreement.adjusted_rand, agreement.adjusted_mutual_information, agreement.normalized_mutual_information):
        with pytest.raises(EmptyInputError):
            f(same.limit(0))
    assert agreement._expected_cell(40_000, 50_000, 100_000) == pytest.approx(0.6 * 0.5 / 200_000, rel=0.02)  # to first order

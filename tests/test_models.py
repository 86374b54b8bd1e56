"""Known answers on literal fixtures, invariants and errors."""

import io
from math import sqrt

import pytest

from millrace import core
from millrace.operators import metrics
from millrace.operators.cluster import DBSCAN, KMeans
from millrace.operators.decomposition import PCA
from millrace.operators.ensemble import GradientBoostingClassifier, GradientBoostingRegressor, RandomForestClassifier, RandomForestRegressor
from millrace.operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from millrace.operators.model_selection import GridSearchCV, KFold, StratifiedKFold, cross_val_score, train_test_split
from millrace.operators.naive_bayes import GaussianNB
from millrace.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from millrace.operators.pipeline import Pipeline, Step, estimator_step, transform_step
from millrace.operators.preprocessing import LabelEncoder, MinMaxScaler, OneHotEncoder, SimpleImputer, StandardScaler
from millrace.operators.sparse import Sparse
from millrace.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor
from millrace.sources import persistence
from millrace.sources.datasets import load_iris, make_blobs, make_classification, make_regression

NAN = float("nan")


def frame(spark, rows, labels=None):
    p = len(rows[0])
    cols = [f"f{i}" for i in range(p)]
    data = [(i, *map(float, r), *([float(labels[i])] if labels else [])) for i, r in enumerate(rows)]
    schema = "row_id long, " + ", ".join(f"{c} double" for c in cols) + (", label double" if labels else "")
    return spark.createDataFrame(data, schema).coalesce(1), cols


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("row_id").select(*cols).collect()]


LIN5 = [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


def test_linear(spark):
    df, f = frame(spark, LIN5, [6, 8, 13, 15, 20])
    m = LinearRegression().fit(df, f)
    assert m.coefficients == pytest.approx((2, 3), abs=1e-8) and m.intercept == pytest.approx(1) and m.score(df) == pytest.approx(1)
    assert Ridge(0.001).fit(df, f).coefficients == pytest.approx((2, 3), abs=0.1)
    ols = sum(map(abs, m.coefficients))
    assert sum(map(abs, Ridge(10.0).fit(df, f).coefficients)) < ols
    assert ElasticNet(0.1, 1.0).fit(df, f).coefficients == pytest.approx(Lasso(0.1).fit(df, f).coefficients, abs=1e-9)
    free, f = frame(spark, LIN5, [5, 7, 12, 14, 19])
    m = LinearRegression(fit_intercept=False).fit(free, f)
    assert m.coefficients == pytest.approx((2, 3)) and m.intercept == 0
    same, f = frame(spark, [(1, 2), (2, 4), (3, 6)], [1, 2, 3])
    with pytest.raises(core.SingularMatrixError):
        LinearRegression().fit(same, f)
    for bad in (Ridge(-1.0), Lasso(-1.0), ElasticNet(1.0, 1.5)):
        with pytest.raises(core.InvalidParameterError):
            bad.fit(df, f)
    with pytest.raises(core.DimensionMismatchError):
        m.predict(df.drop("f1"))
    with pytest.raises(core.EmptyInputError):
        LinearRegression().fit(df.limit(0), f)
    with pytest.raises(core.InvalidParameterError):
        LinearRegression().fit(frame(spark, [(1, NAN), (2, 3)], [1, 2])[0], f)


def test_logistic(spark):
    x = [(-3, 0), (-2, 1), (-1, -1), (-2, -1), (-1, 0), (1, 0), (2, 1), (3, -1), (2, -1), (1, 1)]
    df, f = frame(spark, x, [0] * 5 + [1] * 5)
    m = LogisticRegression().fit(df, f)
    assert m.classes == (0.0, 1.0) and m.score(df) == 1
    assert all(abs(sum(p) - 1) < 1e-9 for p in values(m.predict_probabilities(df), "probability"))
    assert LogisticRegression(fit_intercept=False).fit(df, f).intercepts == (0.0,)
    x = [(0, 10), (1, 10), (0, 11), (1, 11), (10, 0), (10, 1), (11, 0), (11, 1), (10, 10), (10, 11), (11, 10), (11, 11)]
    three, f = frame(spark, x, [0] * 4 + [1] * 4 + [2] * 4)
    m = LogisticRegression(10.0).fit(three, f)
    assert m.score(three) >= 0.9 and len(values(m.predict_probabilities(three), "probability")[0]) == 3
    with pytest.raises(core.InvalidParameterError):
        LogisticRegression(0.0).fit(df, f)
    with pytest.raises(core.InvalidParameterError):
        LogisticRegression().fit(df.where("label = 0"), f)


def test_against_mllib(spark):
    from pyspark.ml.classification import LogisticRegression as Other
    from pyspark.ml.feature import VectorAssembler

    df = make_classification(spark, 200, 3, 2, 1, 2, 0.1, 1.0, 3)
    f = ["f0", "f1"]
    theirs = Other(regParam=0.5, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=500).fit(VectorAssembler(inputCols=f, outputCol="features").transform(df))
    assert LogisticRegression(2.0).fit(df, f).coefficients == pytest.approx(tuple(theirs.coefficients), abs=1e-6)


def test_trees(spark):
    df, f = frame(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], [0, 1, 1, 0])
    for criterion in ("gini", "entropy"):
        assert DecisionTreeClassifier(criterion=criterion).fit(df, f).score(df) == 1
    m = DecisionTreeClassifier(max_depth=1).fit(df, f)
    assert m.score(df) < 1 and (m.root.feature, m.root.threshold) == (0, 0.5)
    df, f = frame(spark, [(i,) for i in range(10)], [0] * 5 + [1] * 5)
    assert all(n.n >= 4 for n in DecisionTreeClassifier(min_samples_leaf=4).fit(df, f).root.walk() if n.is_leaf)
    one, f2 = frame(spark, [(1, 2)], [0])
    assert DecisionTreeClassifier().fit(one, f2).root.is_leaf
    sq, f = frame(spark, [(i,) for i in range(1, 9)], [i * i for i in range(1, 9)])
    assert DecisionTreeRegressor(max_depth=1).fit(sq, f).score(sq) < DecisionTreeRegressor().fit(sq, f).score(sq) == 1
    const, f = frame(spark, [(i, i) for i in range(5)], [42] * 5)
    assert DecisionTreeRegressor().fit(const, f).root.value == 42
    m = DecisionTreeClassifier().fit(*frame(spark, [(0, 10), (1, 20), (2, 30), (3, 40), (4, 50), (5, 60)], [0, 0, 0, 1, 1, 1]))
    assert sum(m.feature_importances) == pytest.approx(1) and min(m.feature_importances) >= 0
    for bad in (DecisionTreeClassifier(criterion="mse"), DecisionTreeClassifier(min_samples_split=1), DecisionTreeClassifier(min_samples_leaf=0)):
        with pytest.raises(core.InvalidParameterError):
            bad.fit(df, f)


def test_ensembles(spark):
    rows, y = [], []
    for c, b in enumerate((1, 5, 9)):
        rows += [(b + 0.02 * i, b + 0.01 * i, b + 0.03 * i, b + 0.01 * i) for i in range(20)]
        y += [c] * 20
    df, f = frame(spark, rows, y)
    m = RandomForestClassifier(n_trees=6, max_depth=3, seed=42).fit(df, f)
    assert m.score(df) >= 0.9 and m.classes == (0, 1, 2) and sum(m.feature_importances) == pytest.approx(1)
    assert m == RandomForestClassifier(n_trees=6, max_depth=3, seed=42).fit(df, f)
    assert all(abs(sum(p) - 1) < 1e-9 for p in values(m.predict_probabilities(df), "probability"))
    const, f = frame(spark, [(i, 2 * i) for i in range(20)], [5] * 20)
    assert set(values(RandomForestRegressor(n_trees=3).fit(const, f).predict(const), "prediction")) == {5.0}
    line, f = frame(spark, [(0.1 * i, i % 7) for i in range(40)], [0.3 * i for i in range(40)])
    assert GradientBoostingRegressor(n_trees=6, learning_rate=0.5).fit(line, f).score(line) >= 0.9
    two, f = frame(spark, [(1 + 0.05 * i, 1) for i in range(10)] + [(5 + 0.05 * i, 2) for i in range(10)], [3] * 10 + [7] * 10)
    m = GradientBoostingClassifier(n_trees=3, subsample=0.8).fit(two, f)
    assert m.classes == (3, 7) and m.score(two) >= 0.9
    with pytest.raises(core.InvalidParameterError):
        GradientBoostingClassifier(n_trees=1).fit(*frame(spark, [(1,), (2,), (3,)], [0, 1, 2]))
    for bad in ({"n_trees": 0}, {"learning_rate": 0.0}, {"subsample": 1.5}):
        with pytest.raises(core.InvalidParameterError):
            GradientBoostingRegressor(**bad).fit(line, f)


def test_neighbours(spark):
    train, f = frame(spark, [(0, 0), (0.5, 0.5), (1, 0), (0, 1), (10, 10), (10.5, 10.5), (11, 10), (10, 11)], [0] * 4 + [1] * 4)
    q, _ = frame(spark, [(0.2, 0.3), (9.8, 10.2)])
    assert values(KNeighborsClassifier(3).fit(train, f).predict(q), "prediction") == [0, 1]
    far, f1 = frame(spark, [(0,), (100,), (10,)], [0, 0, 1])
    q, _ = frame(spark, [(10.01,)])
    assert values(KNeighborsClassifier(3).fit(far, f1).predict(q), "prediction") == [0]
    assert values(KNeighborsClassifier(3, "distance").fit(far, f1).predict(q), "prediction") == [1]
    line, f1 = frame(spark, [(i,) for i in range(1, 6)], [2 * i for i in range(1, 6)])
    assert values(KNeighborsRegressor(2).fit(line, f1).predict(frame(spark, [(3.1,)])[0]), "prediction") == [7.0]
    two, _ = frame(spark, [(0,), (1,)], [10, 20])
    assert values(KNeighborsRegressor(2, "distance").fit(two, f1).predict(frame(spark, [(0.9,)])[0]), "prediction") == [pytest.approx(19)]
    for k in (0, 9):
        with pytest.raises(core.InvalidParameterError):
            KNeighborsClassifier(k).fit(line, f1)
    with pytest.raises(core.InvalidParameterError):
        KNeighborsClassifier(1, "odd").fit(line, f1)


def test_blockwise_neighbours_agree(spark, monkeypatch):
    from millrace.operators import neighbors

    df = make_blobs(spark, 60, 2, 3, 2.0, 5)
    want = values(KNeighborsClassifier(4).fit(df, ["f0", "f1"]).predict(df), "prediction")
    monkeypatch.setattr(neighbors, "SMALL", 0)
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    assert values(KNeighborsClassifier(4).fit(df, ["f0", "f1"]).predict(df), "prediction") == want


def test_naive_bayes(spark):
    x = [(0.1, 0.2), (-0.1, -0.2), (0.2, -0.1), (-0.2, 0.1), (0, 0), (10.1, 10.2), (9.9, 9.8), (10.2, 9.9), (9.8, 10.1), (10, 10)]
    df, f = frame(spark, x, [0] * 5 + [1] * 5)
    m = GaussianNB().fit(df, f)
    assert values(m.predict(df), "prediction") == [0] * 5 + [1] * 5
    assert all(abs(sum(p) - 1) < 1e-10 for p in values(m.predict_probabilities(df), "probability"))


def test_clusters(spark):
    df = make_blobs(spark, 60, 2, 3, 0.05, 42)
    m = KMeans(3, n_init=2, seed=42).fit(df, ["f0", "f1"])
    assert m.inertia < 2 and len({(r.label, r.k) for r in m.labels(df, "k").collect()}) == 3
    same, f = frame(spark, [(1, 1)] * 4)
    assert KMeans(2, n_init=1).fit(same, f).inertia == 0
    with pytest.raises(core.InvalidParameterError):
        KMeans(5).fit(same, f)
    line, f = frame(spark, [(i, 0) for i in range(5)])
    assert values(DBSCAN(0.5, 2).fit(line, f).labels, "label") == [-1] * 5
    m = DBSCAN(1.5, 2).fit(line, f)
    assert values(m.labels, "label") == [0] * 5
    assert values(m.predict(frame(spark, [(0.4, 0), (50, 0)])[0]), "prediction") == [0, -1]
    with pytest.raises(core.InvalidParameterError):
        DBSCAN(0.0).fit(line, f)


def test_pca(spark):
    rows = [(1, 2, 3), (4, 5, 6), (7, 8, 10), (2, 3, 5), (6, 7, 8)]
    df, f = frame(spark, rows)
    m = PCA().fit(df, f)
    back = m.inverse_transform(m.transform(df))
    for a, b in zip(values(back, *f), rows):
        assert a == pytest.approx(b, abs=1e-9)
    assert sum(m.explained_variance_ratio) == pytest.approx(1)
    for i, a in enumerate(m.components):
        for j, b in enumerate(m.components):
            assert sum(x * y for x, y in zip(a, b)) == pytest.approx(float(i == j), abs=1e-10)
    with pytest.raises(core.InvalidParameterError):
        PCA(10).fit(df, f)


def test_scalers(spark):
    df, f = frame(spark, [(1, 2), (3, 4), (5, 6)])
    m = StandardScaler().fit(df, f)
    assert m.mean == (3, 4) and sum(x * x for x in values(m.transform(df), "f0")) / 3 == pytest.approx(1)
    assert values(StandardScaler(with_std=False).fit_transform(df, f), "f0") == [-2, 0, 2]
    assert values(m.inverse_transform(m.transform(df)), *f) == [pytest.approx(x) for x in ((1, 2), (3, 4), (5, 6))]
    flat, f = frame(spark, [(5, 1), (5, 2), (5, 3)])
    assert StandardScaler().fit(flat, f).scale[0] == 1 and values(MinMaxScaler().fit_transform(flat, f), "f0") == [0, 0, 0]
    m = MinMaxScaler().fit(flat, f)
    assert values(m.inverse_transform(m.transform(flat)), "f0") == [5, 5, 5]
    with pytest.raises(core.InvalidParameterError):
        MinMaxScaler(1.0, 0.0).fit(df, f)


def test_imputer(spark):
    df, f = frame(spark, [(1, 10), (NAN, 20), (3, NAN), (5, 40)])
    assert SimpleImputer().fit(df, f).statistics == pytest.approx((3, 70 / 3))
    assert SimpleImputer("median").fit(frame(spark, [(1,), (NAN,), (3,), (5,)])[0], ["f0"]).statistics == (3.0,)
    assert values(SimpleImputer("constant", -999.0).fit_transform(df, f), "f0") == [1, -999, 3, 5]
    none, f = frame(spark, [(NAN,)] * 3)
    assert all(x != x for x in values(SimpleImputer().fit_transform(none, f), "f0"))
    with pytest.raises(core.InvalidParameterError):
        SimpleImputer("mode").fit(df, ["f0"])


def test_encoders(spark):
    df, f = frame(spark, [(0, 0), (1, 1), (0, 2)])
    m = OneHotEncoder().fit(df, f)
    assert m.n_output_features == 5 and OneHotEncoder(True).fit(df, f).n_output_features == 3
    assert values(m.transform(df), *m.outputs)[0] == (1, 0, 1, 0, 0)
    with pytest.raises(Exception, match="unknown category"):
        m.transform(frame(spark, [(3, 0)])[0]).collect()
    for bad in (-1, 1.5, NAN):
        with pytest.raises(core.InvalidParameterError):
            OneHotEncoder().fit(frame(spark, [(bad,)])[0], ["f0"])
    df, f = frame(spark, [(3,), (1,), (2,), (1,), (3,)])
    m = LabelEncoder().fit(df, f)
    assert values(m.transform(df), "f0") == [2, 0, 1, 0, 2] and values(m.inverse_transform(m.transform(df)), "f0") == [3, 1, 2, 1, 3]
    with pytest.raises(Exception, match="unknown label"):
        m.transform(frame(spark, [(4,)])[0]).collect()
    with pytest.raises(core.DimensionMismatchError):
        LabelEncoder().fit(df, ["f0", "f0"])


def test_metrics(spark):
    def two(y, p):
        return spark.createDataFrame(list(zip(map(float, y), map(float, p))), "label double, prediction double")

    b = two([0, 1, 1, 0, 1], [0, 1, 1, 1, 0])
    assert [f(b) for f in (metrics.precision, metrics.recall, metrics.f1)] == [pytest.approx(2 / 3)] * 3
    m = two([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 2])
    assert metrics.accuracy(m) == 0.5 and metrics.precision(m, "macro") == pytest.approx((2 / 3 + 0 + 0.5) / 3) and metrics.recall(m, "weighted") == 0.5
    assert metrics.confusion_matrix(m)[1] == [[2, 0, 0], [1, 0, 1], [0, 1, 1]]
    assert metrics.f1(two([0, 0, 0], [0, 0, 1])) == 0
    r = two([3, -0.5, 2, 7], [2.5, 0, 2, 8])
    assert (metrics.mae(r), metrics.mse(r), metrics.rmse(r)) == (0.5, 0.375, pytest.approx(sqrt(0.375))) and metrics.r2(r) == pytest.approx(1 - 1.5 / 29.1875)
    assert metrics.r2(two([5] * 3, [5] * 3)) == 1 and metrics.r2(two([5] * 3, [4, 5, 6])) == 0
    s = lambda y, p: metrics.roc_auc(two(y, p), score="prediction")
    assert s([0, 0, 0, 1, 1, 1], [0.1, 0.4, 0.6, 0.3, 0.7, 0.9]) == pytest.approx(7 / 9) and s([0, 1], [0.5, 0.5]) == 0.5 and s([1, 1], [0.1, 0.2]) == 0
    with pytest.raises(ValueError):
        metrics.accuracy(b.limit(0))


def test_selection(spark):
    df, f = frame(spark, [(i, 2 * i) for i in range(60)], [3 * i for i in range(60)])
    a, b = train_test_split(df, 0.2, 42)
    assert (a.count(), b.count()) == (48, 12) and a.union(b).distinct().count() == 60
    assert sorted(values(b, "row_id")) == sorted(values(train_test_split(df, 0.2, 42)[1], "row_id")) != sorted(values(train_test_split(df, 0.2, 1)[1], "row_id"))
    assert sorted(r["count"] for r in KFold(7).split(df).groupBy("fold").count().collect()) == [8, 8, 8, 9, 9, 9, 9]
    y, _ = frame(spark, [(i,) for i in range(60)], [0] * 40 + [1] * 20)
    assert {(r.label, r["count"]) for r in StratifiedKFold(4).split(y).groupBy("fold", "label").count().collect()} == {(0, 10), (1, 5)}
    s = cross_val_score(LinearRegression(), df.drop("f1"), ["f0"], cv=3, seed=42)
    assert s == pytest.approx([1, 1, 1]) and s == cross_val_score(LinearRegression(), df.drop("f1"), ["f0"], cv=3, seed=42)
    g = GridSearchCV(Ridge(), [{"alpha": 1e6}, {"alpha": 0.0}, {"alpha": 1.0}], 3).fit(df, ["f0"])
    assert g.best_params == {"alpha": 0.0} and len(g.results) == 3
    for bad in (0, 1):
        with pytest.raises(core.InvalidParameterError):
            KFold(bad).split(df)
        with pytest.raises(core.InvalidParameterError):
            train_test_split(df, float(bad))
    with pytest.raises(core.InvalidParameterError):
        GridSearchCV(Ridge(), []).fit(df, f)
    with pytest.raises(core.InvalidParameterError):
        Ridge().set_params(beta=1)


def test_pipeline(spark):
    df, f = frame(spark, LIN5, [6, 8, 13, 15, 20])
    p = Pipeline(transform_step("scale", StandardScaler()), transform_step("pca", PCA()), estimator_step("ols", LinearRegression()))
    assert p.fit(df, f).score(df) == pytest.approx(1)
    assert p.set_params(pca__n_components=1).steps[1].transformer.n_components == 1
    assert len(cross_val_score(Pipeline(*p.steps[:2], estimator_step("ridge", Ridge())), df, f, cv=2)) == 2
    for bad in (Pipeline(), Pipeline(Step("x", transformer=PCA())), Pipeline(estimator_step("a", Ridge()), estimator_step("b", Ridge()))):
        with pytest.raises(core.InvalidParameterError):
            bad.fit(df, f)


def test_generators(spark, tmp_path):
    b = make_blobs(spark, 300, 3, 4, 0.5, 42)
    assert {r["count"] for r in b.groupBy("label").count().collect()} == {75} and b.collect() == make_blobs(spark, 300, 3, 4, 0.5, 42).collect()
    c = make_classification(spark, 200, 10, 5, 3, 3, seed=42)
    assert len(c.columns) == 12 and c.select("label").distinct().count() == 3
    r = make_regression(spark, 2000, 1, 1, 0.1, 5.0, 1)
    assert abs(r.agg({"label": "avg"}).first()[0] - 5) < 0.2
    for bad in (lambda: make_blobs(spark, 0), lambda: make_classification(spark, n_features=2), lambda: make_regression(spark, 10, 2, 3)):
        with pytest.raises(core.InvalidParameterError):
            bad()
    (tmp_path / "iris.csv").write_text("a,b,c,d,e\n" + "1,2,3,4,0\n" * 150)
    assert load_iris(spark, str(tmp_path / "iris.csv")).count() == 150
    (tmp_path / "short.csv").write_text("a,b,c,d,e\n1,2,3,4,0\n")
    with pytest.raises(core.DimensionMismatchError):
        load_iris(spark, str(tmp_path / "short.csv"))


def test_sparse(spark):
    s = Sparse.from_csr(spark, 3, 4, [1, 2, 3, 4, 5, 6], [0, 3, 2, 0, 2, 3], [0, 2, 3, 6])
    dense = [(1, 0, 0, 2), (0, 0, 3, 0), (4, 0, 5, 6)]
    assert [tuple(r)[1:] for r in s.to_dense().orderBy("row").collect()] == dense and s.nnz() == 6 and s.density() == 0.5
    assert all(s.at(i, j) == dense[i][j] for i, j in ((0, 3), (1, 1), (2, 2)))
    assert s.row_view(2) == ([0, 2, 3], [4, 5, 6]) and s.transpose().at(3, 0) == 2
    x = spark.createDataFrame([(i, i + 1.0) for i in range(4)], "col int, x double")
    assert [r.y for r in s.mul_vec(x).orderBy("row").collect()] == [9, 9, 43]
    assert s.scale(0).nnz() == 6 and s.scale(2).at(2, 3) == 12
    assert Sparse.from_csr(spark, 0, 0, [], [], [0]).density() == 0
    for bad in ((-1, 2, [], [], [0]), (1, 1, [1], [1], [0, 1]), (1, 1, [1], [0], [0, 2]), (2, 2, [1], [0], [0, 1])):
        with pytest.raises(ValueError):
            Sparse.from_csr(spark, *bad)
    with pytest.raises(IndexError):
        s.at(3, 0)


def test_persistence(spark, tmp_path):
    df, f = frame(spark, LIN5, [6, 8, 13, 15, 20])
    models = [Ridge(0.1).fit(df, f), PCA().fit(df, f), SimpleImputer().fit(frame(spark, [(NAN,)] * 2)[0], ["f0"]), DecisionTreeRegressor().fit(df, f)]
    for m in models:
        text, raw = io.StringIO(), io.BytesIO()
        persistence.save_json(text, m)
        persistence.save_msgpack(raw, m)
        text.seek(0), raw.seek(0)
        assert repr(persistence.load_json(text)) == repr(m) == repr(persistence.load_msgpack(raw))
    persistence.save_json_file(str(tmp_path / "m.json"), models[0])
    body = (tmp_path / "m.json").read_text().replace('"checksum": ', '"checksum": 1')
    with pytest.raises(persistence.ChecksumError, match="checksum mismatch"):
        persistence.load_json(io.StringIO(body))
    with pytest.raises(FileNotFoundError):
        persistence.load_json_file(str(tmp_path / "none.json"))
    m = DBSCAN(1.5, 2).fit(df, f)
    persistence.save_native(spark, str(tmp_path / "db"), m)
    again = persistence.load_native(spark, str(tmp_path / "db"))
    assert values(again.predict(df), "prediction") == values(m.predict(df), "prediction")
    for v in (None, True, -5, 2**40, 1.5, "é", b"x", [1, {"a": []}]):
        assert persistence.unpack(persistence.pack(v)) == v


def test_protocols():
    assert isinstance(Ridge(), core.Estimator) and isinstance(Ridge(), core.ParamSetter) and isinstance(Ridge(), core.Cloneable)
    assert isinstance(StandardScaler(), core.FitTransformer)
    assert Ridge(2.0).clone() == Ridge(2.0)


def test_medians_of_odd_even_tied_and_missing(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from millrace.plans.frame import medians

    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 400, 401):
        x = np.stack([rng.integers(0, 5, n), rng.normal(size=n).round(2)], 1).astype(float)
        df = spark.createDataFrame([(*map(float, r), None) for r in x], "a double, b double, c double")
        assert medians(df, [F.col("a"), F.col("b"), F.col("c")]) == pytest.approx([*np.median(x, 0), None])


@pytest.mark.parametrize("p, eps", [(1, 0.02), (2, 0.12), (4, 0.35)])
def test_density_clusters_against_plain_version(spark, p, eps):
    """Dense cells, repeated rows, chains over many cells and points on the border, by all distances."""
    import numpy as np

    rng = np.random.default_rng(p)
    x = np.concatenate([rng.random((150, p)), rng.normal(0.5, 0.03, (80, p)), np.repeat(rng.random((3, p)), 9, 0)])
    near = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(p))) <= eps
    core, label, c = near.sum(1) >= 5, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = c
                    todo += list(np.flatnonzero(near[j] & core & (label < 0)))
            c += 1
    want = [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
    names = [f"f{k}" for k in range(p)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{n} double" for n in names))
    got = DBSCAN(eps, 5).fit(df, names).labels.orderBy("row_id").collect()
    assert [r.label for r in got] == want


def test_labels_beyond_the_literal_bound(spark):
    df = spark.range(300).selectExpr("id AS row_id", "CAST(id * 3 AS DOUBLE) AS x")
    m = LabelEncoder().fit(df, ["x"])
    assert values(m.transform(df), "x") == [float(i) for i in range(300)]
    assert values(m.inverse_transform(m.transform(df)), "x") == [3.0 * i for i in range(300)]
    with pytest.raises(Exception, match="unknown label"):
        m.transform(spark.createDataFrame([(1.0,)], "x double")).collect()


def test_logistic_sums_by_blocks_are_those_of_expressions(spark, monkeypatch):
    import numpy as np

    from millrace.operators import linear

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = np.digitize(x[:, 0] - x[:, 1], [-0.7, 0.7])
    df = spark.createDataFrame([(*map(float, r), float(c)) for r, c in zip(x, y)], "a double, b double, c double, label double")
    for intercept in (True, False):
        fit = linear.LogisticRegression(2.0, fit_intercept=intercept).fit
        monkeypatch.setattr(linear, "EXPRESSIONS", 400)
        want = fit(df, ["a", "b", "c"])
        monkeypatch.setattr(linear, "EXPRESSIONS", 0)
        got = fit(df, ["a", "b", "c"])
        assert np.allclose(got.weights, want.weights, atol=1e-9) and np.allclose(got.intercepts, want.intercepts, atol=1e-9)

"""Queries of the boosted histograms, mixtures, decompositions and factorisations, with their SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from .core import ConvergenceWarning
from .operators.agreement import agreement_table
from .operators.factorization import NMF
from .operators.hist_boosting import HistGradientBoosting
from .operators.isotonic import IsotonicRegression
from .operators.mixture import GaussianMixture
from .operators.sparse import Sparse
from .operators.topics import LatentDirichlet
from .operators.truncated_svd import TruncatedSVD
from .queries import _TREE, _md5, _r, _tree, query, rounded, table

# --- boosted histograms --------------------------------------------------------------------------------------------


def _hist_sql(target: str, log_loss: bool, trees: int, depth: int, bins: int, rate: float, least: int) -> str:
    """CTEs of the bins, then level by level; the last one, `s{trees}`, has i and raw."""
    start = "ln(avg(y) / (1 - avg(y)))" if log_loss else "avg(y)"
    g, h = ("1 / (1 + exp(-raw)) - y", "(1 / (1 + exp(-raw))) * (1 - 1 / (1 + exp(-raw)))") if log_loss else ("raw - y", "1.0::DOUBLE")
    out = f"""WITH v AS (SELECT i, f0, f1, {target}::DOUBLE AS y FROM ({_TREE})),
u AS (SELECT 0 AS f, f0 AS x FROM v UNION ALL SELECT 1, f1 FROM v),
o AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS rn, count(*) OVER (PARTITION BY f) AS n FROM u),
ends AS MATERIALIZED (SELECT DISTINCT f, x AS e FROM o WHERE EXISTS (SELECT 1 FROM range(1, {bins}) AS t(q) WHERE rn = ceil(n * q / {bins}))),
codes AS (SELECT f, x, (SELECT count(*) FROM ends WHERE ends.f = d.f AND e < x) AS b FROM (SELECT DISTINCT f, x FROM u) AS d),
s0 AS MATERIALIZED (SELECT i, y, p.b AS b0, q.b AS b1, (SELECT {start} FROM v) AS raw FROM v JOIN codes AS p ON p.f = 0 AND p.x = f0 JOIN codes AS q ON q.f = 1 AND q.x = f1),
"""
    for t in range(trees):
        out += f"t{t}d0 AS MATERIALIZED (SELECT *, 1 AS node, {g} AS g, {h} AS h FROM s{t}),\n"
        for k in range(depth):
            d = f"t{t}d{k}"
            out += f"""{d}h AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT node, g, h, 0 AS f, b0 AS b FROM {d} UNION ALL SELECT node, g, h, 1, b1 FROM {d}) GROUP BY ALL),
{d}w AS (SELECT node, f, b, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(n) OVER o AS ln, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn FROM {d}h WINDOW o AS (PARTITION BY node, f ORDER BY b), p AS (PARTITION BY node, f)),
{d}b AS MATERIALIZED (SELECT node, f, b AS t FROM (SELECT *, round(lg * lg / lh + (tg - lg) ** 2 / (th - lh) - tg * tg / th, 9) AS gain FROM {d}w WHERE ln >= {least} AND tn - ln >= {least}) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1),
t{t}d{k + 1} AS MATERIALIZED (SELECT {d}.* EXCLUDE (node), CASE WHEN f IS NULL THEN node ELSE node * 2 + CAST(CASE f WHEN 0 THEN b0 ELSE b1 END > t AS INT) END AS node FROM {d} LEFT JOIN {d}b USING (node)),
"""
            # A node that isn't split keeps its number; no child has the number of such a node.
        out += f"s{t + 1} AS MATERIALIZED (SELECT i, y, b0, b1, raw - {rate} * sum(g) OVER (PARTITION BY node) / sum(h) OVER (PARTITION BY node) AS raw FROM t{t}d{depth}),\n"
    return out.rstrip().rstrip(",")


@query(_hist_sql("y", False, 3, 3, 32, 0.3, 20) + f" SELECT i, {_r('raw', 6)} AS prediction FROM s3")
def hist_boosting_regressor(spark, d):
    df = _tree(spark, d)
    m = HistGradientBoosting(max_iter=3, max_depth=3, max_bins=32, learning_rate=0.3).fit(df, ["f0", "f1"], "y")
    return rounded(m.predict(df).select("i", "prediction"), 6, "prediction")


@query(_hist_sql("least(c, 1)", True, 2, 3, 16, 0.5, 20) + f" SELECT i, {_r('1 / (1 + exp(-raw))', 6)} AS p1, (raw >= 0)::INT::DOUBLE AS prediction FROM s2")
def hist_boosting_classifier(spark, d):
    df = _tree(spark, d).withColumn("c", F.least("c", F.lit(1.0)))
    m = HistGradientBoosting(loss="log_loss", max_iter=2, max_depth=3, max_bins=16, learning_rate=0.5).fit(df, ["f0", "f1"], "c")
    return rounded(m.predict(m.predict_probabilities(df)).select("i", F.col("probability")[1].alias("p1"), "prediction"), 6, "p1")


# --- Gaussian mixtures ---------------------------------------------------------------------------------------------

_MIX_ROWS = "SELECT c_custkey AS i, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS z FROM customer"
_MIX_START = ((0.5, 0.5), ((1.0, 5.0), (8.0, 18.0)), (((4.0, 0.0), (0.0, 9.0)), ((4.0, 1.0), (1.0, 9.0))))


def _mix_sql(steps: int) -> str:
    (w, m, c) = _MIX_START
    values = ", ".join(f"({k}, {w[k]}::DOUBLE, {m[k][0]}::DOUBLE, {m[k][1]}::DOUBLE, {c[k][0][0]}::DOUBLE, {c[k][0][1]}::DOUBLE, {c[k][1][1]}::DOUBLE)" for k in range(len(w)))
    out = f"WITH v AS MATERIALIZED ({_MIX_ROWS}), m0 AS (SELECT * FROM (VALUES {values}) AS t(k, w, mx, mz, cxx, cxz, czz))"
    for s in range(steps + 1):
        out += f""",
l{s} AS (SELECT i, x, z, k, ln(w) - ln(2 * pi()) - 0.5 * ln(cxx * czz - cxz * cxz) - 0.5 * (czz * (x - mx) ** 2 - 2 * cxz * (x - mx) * (z - mz) + cxx * (z - mz) ** 2) / (cxx * czz - cxz * cxz) AS lp FROM v, m{s}),
e{s} AS (SELECT *, lp - max(lp) OVER (PARTITION BY i) AS d FROM l{s}),
r{s} AS MATERIALIZED (SELECT i, x, z, k, exp(d) / sum(exp(d)) OVER (PARTITION BY i) AS r FROM e{s})"""
        if s < steps:
            out += f""",
n{s} AS (SELECT k, sum(r) AS n, sum(r * x) / sum(r) AS mx, sum(r * z) / sum(r) AS mz FROM r{s} GROUP BY k),
m{s + 1} AS MATERIALIZED (SELECT k, any_value(n) / (SELECT count(*) FROM v) AS w, any_value(mx) AS mx, any_value(mz) AS mz, sum(r * (x - mx) ** 2) / any_value(n) + 1e-6 AS cxx, sum(r * (x - mx) * (z - mz)) / any_value(n) AS cxz, sum(r * (z - mz) ** 2) / any_value(n) + 1e-6 AS czz FROM r{s} JOIN n{s} USING (k) GROUP BY k)"""
    return out


def _mix(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("z"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        return df, GaussianMixture(n_components=2, max_iter=2, tol=0.0).fit(df, ["x", "z"], _MIX_START)


@query(_mix_sql(2) + f" SELECT k, {_r('w', 7)} AS w, {_r('mx', 6)} AS mx, {_r('mz', 6)} AS mz, {_r('cxx', 6)} AS cxx, {_r('cxz', 6)} AS cxz, {_r('czz', 6)} AS czz FROM m2")
def gaussian_mixture_parameters(spark, d):
    """Two steps from given parameters."""
    _, m = _mix(spark, d)
    rows = [(k, m.weights[k], *m.means[k], m.covariances[k][0][0], m.covariances[k][0][1], m.covariances[k][1][1]) for k in range(2)]
    df = spark.createDataFrame(rows, "k int, w double, mx double, mz double, cxx double, cxz double, czz double")
    return rounded(rounded(df, 7, "w"), 6, "mx", "mz", "cxx", "cxz", "czz")


@query(_mix_sql(2) + f" SELECT i, {_r('max(r) FILTER (k = 0)', 6)} AS p0, (CASE WHEN max(r) FILTER (k = 0) >= max(r) FILTER (k = 1) THEN 0 ELSE 1 END)::INT AS prediction FROM r2 GROUP BY i")
def gaussian_mixture_predict(spark, d):
    df, m = _mix(spark, d)
    return rounded(m.predict(m.predict_probabilities(df)).select("i", F.col("probability")[0].alias("p0"), "prediction"), 6, "p0")


# --- truncated SVD -------------------------------------------------------------------------------------------------

@query()
def truncated_svd_embeddings(spark, d):
    """Singular values of the embeddings' first eight directions, and the mean squared projection on each."""
    df = table(spark, d, "embeddings")
    m = TruncatedSVD(n_components=8).fit_arrays(df, "embedding")
    p = m.transform(df.select("embedding")).select(F.posexplode("components").alias("k", "v")).groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    values = spark.createDataFrame(list(enumerate(m.singular_values)), "k int, singular_value double")
    return rounded(values.join(p, "k"), 5, "singular_value", "norm")


# --- non-negative factorisation ------------------------------------------------------------------------------------

_NMF_ROUNDS, _NMF_PARTS = 2, 2
_CELLS = "SELECT l_suppkey::BIGINT AS row, month(l_shipdate)::INT AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def _nmf_sql(rounds: int, k: int) -> str:
    parts = range(k)

    def begin(side: str) -> str:
        return "SELECT DISTINCT " + side + "::BIGINT AS id, " + ", ".join(f"{_md5(0, repr(side), side, repr(str(c)))} + 0.01 AS f{c}" for c in parts) + " FROM v"

    def half(fixed: str, moving: str, by: str, to: str) -> str:
        gram = "SELECT " + ", ".join(f"sum(f{i} * f{j}) AS g{i}{j}" for i in parts for j in parts) + f" FROM {fixed}"
        sums = f"SELECT {to}::BIGINT AS id, " + ", ".join(f"sum(value * f{c}) AS s{c}" for c in parts) + f" FROM v JOIN {fixed} ON {by} = id GROUP BY 1"
        new = ", ".join(f"f{c} * s{c} / (" + " + ".join(f"g{c}{j} * f{j}" for j in parts) + f" + 1e-12) AS f{c}" for c in parts)
        return f"SELECT id, {new} FROM ({sums}) JOIN {moving} USING (id), ({gram})"

    out = f"WITH v AS MATERIALIZED ({_CELLS}), w0 AS MATERIALIZED ({begin('row')}), h0 AS MATERIALIZED ({begin('col')})"
    for r in range(rounds):
        out += f", h{r + 1} AS MATERIALIZED ({half(f'w{r}', f'h{r}', 'row', 'col')}), w{r + 1} AS MATERIALIZED ({half(f'h{r + 1}', f'w{r}', 'col', 'row')})"
    return out


def _nmf(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("row"), F.month("l_shipdate").alias("col")).agg(F.sum("l_quantity").alias("value"))
    n = items.agg(F.max("row")).first()[0]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        return items, NMF(n_components=_NMF_PARTS, max_iter=_NMF_ROUNDS, tol=0.0).fit(Sparse((n or 0) + 1, 13, items))


@query(_nmf_sql(_NMF_ROUNDS, _NMF_PARTS) + f" SELECT row, col, {_r(' + '.join(f'w.f{c} * h.f{c}' for c in range(_NMF_PARTS)), 5)} AS value FROM v JOIN w{_NMF_ROUNDS} AS w ON w.id = row JOIN h{_NMF_ROUNDS} AS h ON h.id = col")
def nmf_supplier_months(spark, d):
    """Quantities by supplier and month after two rounds."""
    items, m = _nmf(spark, d)
    return rounded(m.values(items.select("row", "col")), 5, "value")


# --- topics --------------------------------------------------------------------------------------------------------


@query()
def topic_model_documents(spark, d):
    """The main topic of every document, and its share."""
    df = table(spark, d, "documents").select("doc_id", "text")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", ConvergenceWarning)
        m = LatentDirichlet(n_topics=6, max_iter=8, vocabulary=5000).fit(df)
    best = F.array_max("topics")
    return rounded(m.transform(df).select("doc_id", (F.array_position("topics", best) - 1).cast("int").alias("topic"), best.alias("share")), 4, "share")


# --- isotonic regression -------------------------------------------------------------------------------------------

_ISO_ROWS = "SELECT c_custkey AS i, floor(c_acctbal / 50)::DOUBLE AS x, c_nationkey + c_acctbal / 7000 AS y FROM customer"


@query(
    f"""WITH v AS ({_ISO_ROWS}), u AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS k, sum(y) AS s, count(*) AS w FROM v GROUP BY x),
c AS MATERIALIZED (SELECT k, x, sum(s) OVER (ORDER BY k) AS cs, sum(w) OVER (ORDER BY k) AS cw, s, w FROM u),
m AS (SELECT a.k AS a, b.k AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM c AS a JOIN c AS b ON b.k >= a.k),
l AS MATERIALIZED (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m),
f AS (SELECT b AS k, max(least) AS value FROM l GROUP BY b)
SELECT i, {_r('value', 6)} AS prediction FROM v JOIN u USING (x) JOIN f USING (k)"""
)
def isotonic_regression(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.floor(F.col("c_acctbal") / 50).cast("double").alias("x"), (F.col("c_nationkey") + F.col("c_acctbal") / 7000).alias("y"))
    return rounded(IsotonicRegression().fit(df, "x", "y").predict(df).select("i", "prediction"), 6, "prediction")


# --- agreement of labellings ---------------------------------------------------------------------------------------

_TWO = "SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 7 < 4 THEN o_orderpriority END AS b FROM orders"


@query(
    f"""WITH v AS ({_TWO}), t AS (SELECT a, b, count(*) AS n FROM v GROUP BY ALL), z AS (SELECT count(*)::DOUBLE AS z FROM v),
x AS (SELECT a, sum(n)::DOUBLE AS n FROM t GROUP BY a), y AS (SELECT b, sum(n)::DOUBLE AS n FROM t GROUP BY b),
p AS (SELECT sum(n * (n - 1) / 2) AS p FROM t), q AS (SELECT sum(n * (n - 1) / 2) AS q, -sum(n / z * ln(n / z)) AS ha FROM x, z), r AS (SELECT sum(n * (n - 1) / 2) AS r, -sum(n / z * ln(n / z)) AS hb FROM y, z),
m AS (SELECT sum(t.n / z * ln(t.n * z / (x.n * y.n))) AS mi FROM t JOIN x ON t.a IS NOT DISTINCT FROM x.a JOIN y ON t.b IS NOT DISTINCT FROM y.b, z)
SELECT z::BIGINT AS n, {_r('(p - q * r / (z * (z - 1) / 2)) / ((q + r) / 2 - q * r / (z * (z - 1) / 2))', 8)} AS adjusted_rand, {_r('mi', 8)} AS mutual_information, {_r('mi / ha', 8)} AS homogeneity, {_r('mi / hb', 8)} AS completeness, {_r('2 * mi / (ha + hb)', 8)} AS v_measure FROM p, q, r, m, z"""
)
def labelling_agreement(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 7 < 4, F.col("o_orderpriority")).alias("b"))
    cols = ("adjusted_rand", "mutual_information", "homogeneity", "completeness", "v_measure")
    return rounded(agreement_table(df, "a", "b").select("n", *cols), 8, *cols)

"""Matrix sums, correlations of many columns, regularisation paths."""

import time

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from donorlift.operators import gram
from donorlift.operators import profile as pf


def frame(spark, x, *more, names=None):
    p = x.shape[1]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], *[m[i].item() for m in more]) for i, r in enumerate(x)]
    cols = ", ".join([f"c{j} double" for j in range(p)] + (names or []))
    return spark.createDataFrame(rows, cols).repartition(4)


def test_scatter_and_correlations_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + [1e6, 0, -50, 3, 1]
    x[:, 4] = 7.1
    names = [f"c{j}" for j in range(5)]
    s = gram.scatter(frame(spark, x), names)
    c = x - x.mean(0)
    assert s.n == 300 and np.allclose(s.mean, x.mean(0)) and np.allclose(s.products, c.T @ c, rtol=1e-9, atol=1e-6)
    gaps = x.copy()
    gaps[rng.random(x.shape) < 0.2] = np.nan
    n, r = gram.correlation_matrix(frame(spark, gaps), names)
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(gaps[:, i]) & ~np.isnan(gaps[:, j])
            assert n[i, j] == both.sum() and abs(r[i, j] - np.corrcoef(gaps[both, i], gaps[both, j])[0, 1]) < 1e-9
    assert np.isnan(r[4]).all()
    got = {(k.col_a, k.col_b): k.corr for k in pf.correlations(frame(spark, gaps), names).collect()}
    assert len(got) == 10 and got["c0", "c1"] == round(r[0, 1], 4) and got["c0", "c4"] is None
    empty = frame(spark, x).where("c0 IS NULL")
    assert gram.scatter(empty, names).n == 0 and np.isnan(gram.correlation_matrix(empty, names)[1]).all()


def test_correlations_of_653_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 653))
    names = [f"c{j}" for j in range(653)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3).checkpoint()
    t = time.time()
    rows = pf.correlations(df, names).collect()
    assert time.time() - t < 60 and len(rows) == 653 * 652 // 2
    want = np.corrcoef(x.T)
    assert all(abs(r["corr"] - want[int(r.col_a[1:]), int(r.col_b[1:])]) < 1e-4 for r in rows[::997])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5)) * [1, 10, 0.1, 1, 1] + [0, 100, 0, 0, 0]
    x[:, 4] = 2.0  # constant
    lin = x[:, 0] - 0.1 * (x[:, 1] - 100) + 5 * x[:, 2] * 0
    y = (rng.random(900) < 1 / (1 + np.exp(-lin + 1.5))).astype(int)
    t = 3 + 2 * lin + rng.normal(size=900)
    fold = np.arange(900) % 4
    return frame(spark, x, y, t, fold, names=["y int", "t double", "fold int"]).checkpoint(), x, y, t, fold


NAMES = [f"c{j}" for j in range(5)]


def test_linear_path_equals_fits_of_each_fold(spark, labelled):
    df, x, y, t, fold = labelled
    lambdas = [1.0, 0.3, 0.02]
    rows, best = gram.linear_path(df, NAMES, "t", "fold", 4, lambdas, 0.5)
    assert sorted((r["lambda"], r["fold"]) for r in rows) == sorted((lam, f) for lam in lambdas for f in range(4))
    va = VectorAssembler(inputCols=NAMES, outputCol="features")
    for lam, f in ((0.3, 1), (0.02, 3)):
        m = LinearRegression(labelCol="t", regParam=lam, elasticNetParam=0.5, maxIter=500, tol=1e-12).fit(va.transform(df.where(F.col("fold") != f)))
        test = fold == f
        mse = np.mean((x[test] @ m.coefficients.toArray() + m.intercept - t[test]) ** 2)
        got = next(r for r in rows if (r["lambda"], r["fold"]) == (lam, f))
        assert abs(got["mse"] / mse - 1) < 1e-5 and got["rows"] == test.sum()
    m = LinearRegression(labelCol="t", regParam=best["lambda"], elasticNetParam=0.5, maxIter=500, tol=1e-12).fit(va.transform(df))
    assert np.allclose(list(best["coef"].values()), m.coefficients.toArray(), atol=1e-5) and abs(best["intercept"] - m.intercept) < 1e-3


def test_logit_path_equals_fits_of_each_fold(spark, labelled):
    df, x, y, t, fold = labelled
    lambdas = [0.2, 0.05, 0.005]
    rows, best = gram.logit_path(df, NAMES, "y", "fold", 4, lambdas, 0.5)
    assert sorted((r["lambda"], r["fold"]) for r in rows) == sorted((lam, f) for lam in lambdas for f in range(4))
    va = VectorAssembler(inputCols=NAMES, outputCol="features")
    for lam, f in ((0.05, 2), (0.005, 0), (best["lambda"], None)):
        train = np.ones(900, bool) if f is None else fold != f
        share = y[train].mean()
        part = df if f is None else df.where(F.col("fold") != f)
        part = va.transform(part.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share))))
        m = LogisticRegression(labelCol="y", weightCol="w", regParam=float(lam), elasticNetParam=0.5, maxIter=1000, tol=1e-12).fit(part)
        if f is None:
            # MLlib's deviations are weighted ones, so coefficients agree closely, not exactly
            assert np.allclose(list(best["coef"].values()), m.coefficients.toArray(), rtol=0.1, atol=0.02)
            continue
        q = 1 / (1 + np.exp(-(x[~train] @ m.coefficients.toArray() + m.intercept)))
        got = next(r for r in rows if (r["lambda"], r["fold"]) == (lam, f))
        assert abs(got["recall"] - ((q >= 0.5) & (y[~train] == 1)).sum() / y[~train].sum()) < 0.05
    assert max(r["nonzero"] for r in rows) <= 4  # the constant column stays out


def test_logit_path_without_weights_equals_a_newton_fit(spark, labelled):
    df, x, y, t, fold = labelled
    _, best = gram.logit_path(df, NAMES, "y", "fold", 4, [0.03], 0.5, balanced=False)
    m = LogisticRegression(labelCol="y", regParam=0.03, elasticNetParam=0.5, maxIter=1000, tol=1e-12).fit(VectorAssembler(inputCols=NAMES, outputCol="features").transform(df))
    assert np.allclose(list(best["coef"].values()), m.coefficients.toArray(), atol=1e-4) and abs(best["intercept"] - m.intercept) < 1e-2

"""Chained imputation against a brute-force chain; selection and registry rules."""

import random

import numpy as np

from donorlift.operators import models as md


def test_chained_imputation_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        a, b = rnd.random(), rnd.random()
        x = [a, b, a + 2 * b + rnd.random() / 10, a - b + rnd.random() / 10]
        rows.append((i, *[None if j and rnd.random() < 0.1 * j else v for j, v in enumerate(x)]))
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double").repartition(3)
    got = {r["k"]: [r[c] for c in cols] for r in md.impute_iterative(df, "k", cols, rounds=2, medians={"b": 0.5, "c": 1.5, "d": 0.0}).collect()}
    x = np.array([[v if v is not None else np.nan for v in r[1:]] for r in rows])
    m = np.isnan(x)
    x[m] = np.take([0.0, 0.5, 1.5, 0.0], np.where(m)[1])
    for _ in range(2):
        for c in np.argsort(m.sum(0), kind="stable"):
            if m[:, c].any():
                z = x.copy()
                z[:, c] = 1
                w = np.linalg.lstsq(z[~m[:, c]], x[~m[:, c], c], rcond=None)[0]
                x[m[:, c], c] = (z @ w)[m[:, c]]
    assert np.allclose(np.array([got[i] for i in range(200)]), x, atol=1e-5)


def test_best_is_kept_per_model_and_direction(spark, tmp_path):
    from pyspark.ml.feature import Binarizer

    root, m = str(tmp_path / "r"), Binarizer(threshold=0.5, inputCol="a", outputCol="b")
    md.record_result(root, spark, "x", "", "auc", 0.9, m)
    md.record_result(root, spark, "y", "", "auc", 0.7, m)   # a weaker second model is stored, too
    md.record_result(root, spark, "x", "", "auc", 0.8, m)   # no improvement
    md.record_result(root, spark, "x", "", "logloss", 0.4, m, greater_is_better=False)
    res = md.record_result(root, spark, "x", "", "logloss", 0.3, m, greater_is_better=False)
    stored = sorted((r["model"], r["metric"], r["score"]) for r in res.where("path IS NOT NULL").collect())
    assert stored == [("x", "auc", 0.9), ("x", "logloss", 0.3), ("x", "logloss", 0.4), ("y", "auc", 0.7)]
    assert md.best_model(res, "auc").first()["model"] == "x"
    assert md.best_model(res, "logloss").first()["score"] == 0.3

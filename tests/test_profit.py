"""The one-pass profit curve equals the naive scan (one pass per alpha)."""

import random

from pyspark.sql import functions as F

from donorlift.operators import profit as pr


def test_curve_equals_naive(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        p = rnd.choice([0.0, rnd.random()])
        d = rnd.uniform(1, 50)
        amt = rnd.choice([0.0, 0.0, 0.0, round(rnd.uniform(1, 60), 2)])
        rows.append((i, p, d, amt))
    df = spark.createDataFrame(rows, "k long, p double, d double, amt double")
    df = df.withColumn("c", pr.critical_alpha_amount(F.col("p"), F.col("d"), 0.68))
    n = 1000
    curve = {r["k"]: (r["n_mailed"], r["profit"]) for r in pr.profit_curve(df, "c", "amt", 0.68, n).collect()}
    local = [(r["c"], r["amt"]) for r in df.collect()]
    for k in list(range(0, n, 37)) + [n - 1]:
        a = k / (n - 1)
        sel = [amt for c, amt in local if c is not None and a > c]
        assert curve[k][0] == len(sel)
        assert abs(curve[k][1] - sum(round(x - 0.68, 2) for x in sel)) < 1e-6


def test_zero_probability_never_mailed(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 5.0), (2, None, 10.0, 5.0)], "k long, p double, d double, amt double")
    df = df.withColumn("c", pr.critical_alpha_amount(F.col("p"), F.col("d"), 0.68))
    curve = pr.profit_curve(df, "c", "amt", 0.68, 100)
    assert curve.agg(F.max("n_mailed")).first()[0] == 0


def test_alpha_star_first_of_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0, 10.0)], "k long, p double, d double, amt double")
    df = df.withColumn("c", pr.critical_alpha_amount(F.col("p"), F.col("d"), 0.68))
    curve = pr.profit_curve(df, "c", "amt", 0.68, 101)
    best = pr.alpha_star(curve).first()
    # mailed once alpha > 0.068, profit flat afterwards: the first such grid point
    assert best["k"] == 7 and abs(best["profit"] - 9.32) < 1e-9


def test_mailing_summary_edge_cases(spark):
    from donorlift.operators import profit as pr

    schema = "crit double, amount double, pred double"
    one = pr.mailing_summary(spark.createDataFrame([(0.1, 30.0, 20.0), (2.0, 0.0, 1.0)], schema), "crit", "amount", "pred", 10.0, None, 11).first()
    assert (one["n_mailed"], one["profit"], one["std_profit"]) == (1, 20.0, None)
    loss = pr.mailing_summary(spark.createDataFrame([(0.1, 0.0, 20.0), (0.5, 1.0, 20.0)], schema), "crit", "amount", "pred", 10.0, None, 11).first()
    assert (loss["k"], loss["n_mailed"], loss["profit"], loss["predicted_profit"]) == (0, 0, 0.0, 0.0)
    none = pr.mailing_summary(spark.createDataFrame([(0.1, 0.0, 20.0)], schema), "crit", "amount", "pred", 10.0, None, 11).first()
    assert none["pct_of_max"] is None


def test_exact_alpha_is_best_of_all(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([round(rnd.random() * 1.3, 2), rnd.random(), None]), rnd.choice([0.0, 0.0, 0.0, round(rnd.uniform(1, 9), 2)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, c double, amt double").repartition(3)
    net = lambda a: sum(round(x - 0.68, 2) for _, c, x in rows if c is not None and a > c)
    got = pr.exact_alpha_star(df, "c", "amt", 0.68).first()
    values = sorted({c for _, c, _ in rows if c is not None and c < 1})
    best = max(net(c + 1e-12) for c in values)
    assert abs(got.profit - best) < 1e-6 and abs(net(got.alpha) - best) < 1e-6 and got.above < got.alpha <= min(1.0, got.upto)
    assert got.above == min(c for c in values if abs(net(c + 1e-12) - best) < 1e-6)
    assert got.n_mailed == sum(c is not None and got.alpha > c for _, c, _ in rows)
    assert got.profit >= pr.alpha_star(pr.profit_curve(df, "c", "amt", 0.68, 5000)).first().profit
    nobody = pr.exact_alpha_star(df, "c", "amt", 100.0).first()
    assert (nobody.alpha, nobody.n_mailed, nobody.profit, nobody.above) == (0.0, 0, 0.0, None)
    assert pr.exact_alpha_star(df.where("k < 0"), "c", "amt", 0.68).first().profit == 0

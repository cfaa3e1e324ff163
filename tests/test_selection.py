"""Power transforms of many columns, Boruta as a stage, shadows."""

import random

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from donorlift.operators import models as md
from donorlift.operators import sampling as sm
from donorlift.operators import transformers as tr


def test_lambdas_of_many_columns_equal_those_of_one(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.lognormvariate(0, 1), rnd.expovariate(0.5) - 0.2, rnd.gauss(0, 3) if rnd.random() < 0.9 else None, 4.5, None) for i in range(500)]
    cols = ["a", "b", "c", "flat", "gone"]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, flat double, gone double").repartition(3)
    got = sm.fit_power_lambdas(df, cols)
    assert got["flat"] == got["gone"] == 1.0
    for c in "abc":
        assert abs(got[c] - sm.fit_power_lambda(df, c, "yeo-johnson")[1]) <= 0.0006
    assert abs(sm.fit_power_lambdas(df, ["a"], "box-cox")["a"] - sm.fit_power_lambda(df, "a", "box-cox")[1]) <= 0.0006
    model = Pipeline(stages=[tr.PowerTransformer(cols)]).fit(df)
    model.write().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(df)
    r = out.agg(*[f(c).alias(f"{n}_{c}") for c in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("c").alias("n"), F.max("flat").alias("flat")).first()
    assert all(abs(r[f"m_{c}"]) < 1e-9 and abs(r[f"s_{c}"] - 1) < 1e-9 for c in "abc")
    assert r.n == sum(x[3] is not None for x in rows) and r.flat == 0.0
    empty = df.where("k < 0")
    assert sm.fit_power_lambdas(empty, cols) == dict.fromkeys(cols, 1.0)


def test_shadows_keep_values_and_lose_the_label(spark):
    rows = [(i, i % 2, 1.0, float(i), float(i * i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int, w double, a double, b double").orderBy(F.md5(F.col("k").cast("string")))
    got = np.array([r.features.toArray() for r in md.shadowed(df.coalesce(1), "k", "y", ["a", "b"], 5).collect()])
    assert sorted(got[:, 2]) == sorted(got[:, 0]) and sorted(got[:, 3]) == sorted(got[:, 1])
    assert abs(np.corrcoef(got[:, 0], got[:, 2])[0, 1]) < 0.15 and abs(np.corrcoef(got[:, 2], got[:, 3])[0, 1]) < 0.15


def test_boruta_corrections():
    assert md._passed({"a": 0.001, "b": 0.04, "c": 0.5}, 0.05, 1) == {"a"}
    assert md._passed({"a": 0.001, "b": 0.02, "c": 0.5}, 0.05, 1) == {"a", "b"}
    assert md._passed({"a": 0.001, "b": 0.02, "c": 0.5}, 0.05, 10) == {"a"}
    assert md.auto_trees(14, 6) == 88


def test_boruta_model_is_learned_stored_and_applied(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, y := int(rnd.random() < 0.4), y + rnd.gauss(0, 0.3), rnd.gauss(0, 1), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, y int, good double, bad double, worse double").repartition(2)
    model = Pipeline(stages=[tr.BorutaSelector(["good", "bad", "worse"], "k", "y", maxRounds=40)]).fit(df)
    model.write().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(df.limit(3)).columns == ["k", "y", "good"]
    loose = md.boruta(md.FeatureFrame(md.with_class_weight(df, "y"), ["good", "bad", "worse"], "k"), "y", 8, trees=10, perc=50.0).collect()
    assert {r.feature for r in loose} == {"good", "bad", "worse"} and max(r.rounds for r in loose) <= 8


def _labelled(spark, n=400):
    rnd = random.Random(8)
    rows = [(i, y, *[rnd.gauss(1.5 * y, 1), rnd.gauss(-y, 1), rnd.gauss(0, 1)]) for i in range(n) for y in [int(rnd.random() < 0.4)]]
    df = spark.createDataFrame(rows, "k long, y int, good double, fair double, noise double").repartition(3).checkpoint()
    return md.FeatureFrame(md.with_class_weight(df, "y"), ["good", "fair", "noise"], "k")


def test_boruta_makes_a_round_s_shadows_once(spark, monkeypatch):
    """A fit reads its rows several times; the shadows are not made anew each time."""
    read, shadowed = spark.sparkContext.accumulator(0), md.shadowed

    def counted(df, *args):
        def run(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return shadowed(df.mapInArrow(run, df.schema), *args)

    monkeypatch.setattr(md, "shadowed", counted)
    md.boruta(_labelled(spark), "y", 2, trees=4)
    assert read.value == 2 * 400


def test_boruta_of_little_memory_fits_fewer_rounds_and_finds_the_same(spark, monkeypatch):
    made, shadowed = [], md.shadowed
    monkeypatch.setattr(md, "shadowed", lambda df, key, label, names, seed: made.append(seed) or shadowed(df, key, label, names, seed))
    many = md.boruta(_labelled(spark), "y", 30, trees=6).collect()
    at_first = len(made)
    made.clear()
    monkeypatch.setattr(md, "fits_at_once", lambda *_: 1)
    assert md.boruta(_labelled(spark), "y", 30, trees=6).collect() == many
    assert len(made) == max(r["rounds"] for r in many) <= at_first  # no round after the last decision
    monkeypatch.undo()
    assert md.fits_at_once(spark, 1 << 60, 8) == 1 and md.fits_at_once(spark, 1, 8) == 8

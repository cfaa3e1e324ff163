"""Step registry: hooks, drops, types, stored models, no second computation."""

import pytest
from pyspark.ml.util import DefaultParamsReadable
from pyspark.sql import functions as F

from donorlift.operators import transformers as tr
from donorlift.operators.steps import Chain, Step


def steps(seen):
    def before(df):
        seen.append("before")
        return df.where("a IS NOT NULL OR b > 0")

    return [
        Step("numbers", [tr.ToNumber(["a"])], types={"a": "int"}),
        Step("filled", [tr.MedianImputer(["a"])], drop=["b", "absent"], before=before, after=lambda df: df.withColumn("twice", F.col("a") * 2), file="full"),
    ]


def test_chain_learns_once_and_applies_stored_models(spark, tmp_path):
    seen = []
    learn = spark.createDataFrame([(1, "1", 0), (2, "5", 0), (3, None, 1), (4, None, 0)], "k long, a string, b int")
    chain = Chain(spark, str(tmp_path / "c"), steps(seen))
    got = chain.learn(lambda: learn)
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, 2.0), (2, 5.0, 10.0), (3, 3.0, 6.0)] and seen == ["before"]
    chain.learn(lambda: pytest.fail("computed twice"))  # both tables are there
    later = Chain(spark, str(tmp_path / "c"), steps(seen))  # a new application: models come from the folder
    new = spark.createDataFrame([(7, None, 2), (8, "x", 9), (9, "4", 0)], "k long, a string, b int")
    assert sorted(map(tuple, later.apply(lambda: new, "validation").collect())) == [(7, 3.0, 6.0), (8, 3.0, 6.0), (9, 4.0, 8.0)]
    assert seen == ["before", "before"]


def test_chain_rejects_wrong_types_and_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1")], "k long, a string")
    with pytest.raises(TypeError, match="step s"):
        Chain(spark, str(tmp_path / "t"), [Step("s", [tr.KeepColumns(["k", "a"])], types={"a": "int"})]).learn(lambda: rows)
    with pytest.raises(ValueError):
        Chain(spark, str(tmp_path / "n"), [Step("s"), Step("t", file="s")])


def test_stages_are_readable():
    assert all(issubclass(c, DefaultParamsReadable) for c in (tr.PowerModel, tr.PowerTransformer, tr.BorutaSelector, tr.DropColumnsModel))

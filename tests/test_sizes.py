"""What keeps a task and the driver from growing with the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlift.operators import models as md
from donorlift.operators import ordering as od
from donorlift.plans import q_search as qs
from donorlift.session import shuffled_by_rows


def test_shuffles_grow_with_the_rows(spark):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    rows = spark.range(1000).groupBy("id").count()
    with shuffled_by_rows(spark, 1000, 50):
        assert spark.conf.get(key) == "20"
        assert rows.count() == 1000
    with shuffled_by_rows(spark, 1000, 100_000):
        assert spark.conf.get(key) == old
    assert spark.conf.get(key) == old


def test_split_of_a_large_table_is_not_broadcast(spark, monkeypatch):
    """The driver holds no column of the whole table."""
    monkeypatch.setattr(od, "BROADCAST_TABLE_MAX_ROWS", 0)
    sf = "/root/testdata/sf0.001"
    _, marked = qs.split_frame(spark, sf)
    _, folds, _ = qs._donors(spark, sf)
    for df in (marked, folds):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        # the offsets of slices are the only table sent to all
        assert "SortMergeJoin [member_id" in plan and "BroadcastHashJoin [member_id" not in plan


def test_iterative_imputation_passes_arrow_batches(spark, monkeypatch):
    """No row becomes a Python object; the fill equals least squares."""
    import numpy as np

    monkeypatch.setattr(DataFrame, "mapInPandas", None)
    rows = [(i, float(i % 7), None if i % 5 == 0 else 2.0 * (i % 7) + 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(3)
    got = {r.k: r.b for r in md.impute_iterative(df, "k", ["a", "b"], rounds=2, medians={"b": 7.0}).collect()}
    assert len(got) == 200 and all(np.isclose(got[i], 2.0 * (i % 7) + 1.0, atol=1e-6) for i in range(200))
    assert df.where(F.col("b").isNull()).count() == 40

"""The distributed exact-order helpers equal single-task windows, also when
one group holds a third of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from donorlift.operators import ordering as od


def skewed(spark, n=3000):
    # group 0 holds a third of the rows; values with ties
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("g"),
        ((F.col("id") * 7919) % 101).cast("double").alias("v"),
    )


def test_positions_equal_row_number(spark):
    df = skewed(spark)
    got = od.with_positions(df, [("v", True), ("k", True)], ["g"], slices=6)
    w = Window.partitionBy("g").orderBy("v", "k")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn("cnt", F.count("*").over(Window.partitionBy("g")))
    j = got.join(ref, ["k"])
    assert j.where((F.col("_pos") != F.col("rn")) | (F.col("_n") != F.col("cnt"))).count() == 0
    assert j.count() == df.count()


def test_prefix_sums_equal_window(spark):
    df = skewed(spark)
    got = od.with_prefix_sums(df, [("v", False), ("k", True)], ["v"], ["g"], slices=5)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rs", F.sum("v").over(w))
    j = got.join(ref, "k")
    assert j.where(F.abs(F.col("cum_v") - F.col("rs")) > 1e-9).count() == 0


def test_exact_quantiles_equal_percentile(spark):
    df = skewed(spark)
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in od.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], slices=4).collect()}
    ref = df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.9]).alias("p")).collect()
    for r in ref:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[r["g"]], r["p"]))


def test_ntile(spark):
    df = spark.range(23).select(F.col("id").alias("k"))
    got = od.with_positions(df, [("k", True)]).select("k", od.ntile_of(F.col("_pos"), F.col("_n"), 5).alias("t"))
    ref = df.select("k", F.ntile(5).over(Window.orderBy("k")).alias("t2"))
    assert got.join(ref, "k").where("t <> t2").count() == 0


def test_positions_shuffle_the_table_once(spark):
    """Numbering adds no exchange of rows behind the range exchange: the plan
    reads the checkpoint and joins the small offsets."""
    from donorlift.operators.ordering import with_positions

    df = spark.range(5000).selectExpr("id % 3 AS g", "id * 7919 % 5003 AS v", "id")
    out = with_positions(df, [("v", True), ("id", True)], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Scan ExistingRDD")[0]
    assert "Window" not in above and "BroadcastHashJoin" in plan
    rows = out.collect()
    for g in range(3):
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["_pos"] for r in own] == list(range(1, len(own) + 1)) and {r["_n"] for r in own} == {len(own)}

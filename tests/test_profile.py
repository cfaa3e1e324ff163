"""Zero / near-zero variance and sparse column rules."""

from donorlift.operators import profile as pf


def test_near_zero_rules(spark):
    rows = []
    for i in range(1000):
        rows.append((
            "a" if i < 960 else "b",          # 960:40 -> ratio 24 > 19 -> dropped
            "a" if i < 940 else "b",          # 940:60 -> ratio 15.7 -> kept
            "k" if i % 3 == 0 else None,      # one level + missing -> zero variance
            str(i) if i < 100 else None,      # 10 % non-null -> sparse
            str(i % 50),                      # 50 levels, uniform -> kept
        ))
    df = spark.createDataFrame(rows, "nz string, keep string, const string, sparse string, ok string")
    rep = {r["feature"]: r for r in pf.near_zero_report(pf.column_profile(df, df.columns)).collect()}
    assert rep["nz"]["dropped"] and rep["nz"]["near_zero_var"]
    assert not rep["keep"]["dropped"]
    assert rep["const"]["dropped"] and rep["const"]["zero_var"]
    assert rep["sparse"]["dropped"] and rep["sparse"]["sparse"]
    assert not rep["ok"]["dropped"]
    rep2 = {r["feature"]: r["dropped"] for r in pf.near_zero_report(
        pf.column_profile(df, df.columns), override=["nz"]).collect()}
    assert rep2["nz"] is False


def test_top2_with_tie(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "x string")
    r = pf.column_profile(df, ["x"]).first()
    assert (r["top1"], r["top2"], r["n_distinct"]) == (2, 2, 3)


def test_keep_single_level_option(spark):
    df = spark.createDataFrame([("k" if i % 2 else None,) for i in range(100)], "flag string")
    prof = pf.column_profile(df, ["flag"])
    assert pf.near_zero_report(prof).first()["dropped"]
    assert not pf.near_zero_report(prof, keep_single_level=True).first()["dropped"]


def test_big_integers_are_counted_exactly(spark):
    from donorlift.operators import profile as pf

    df = spark.range(100).selectExpr("id + 9007199254740993 AS big", "CAST(id AS DECIMAL(38,0)) + 90071992547409930000 AS dec", "id / 4.0D AS real")
    got = {r["feature"]: (r["n_distinct"], r["top1"]) for r in pf.column_profile(df, ["big", "dec", "real"]).collect()}
    assert got == {"big": (100, 1), "dec": (100, 1), "real": (100, 1)}


def test_skewness_of_millions_of_rows(spark):
    """The standard error's n^3 is beyond a long."""
    df = spark.range(3_000_000).selectExpr("CASE WHEN id % 4 = 0 THEN 3 ELSE 0 END AS x", "id % 2 AS even")
    got = {r["feature"]: (r["n"], r["skewness"], r["significant"]) for r in pf.skewness_report(df, ["x", "even"]).collect()}
    assert got == {"x": (3_000_000, 1.1547, True), "even": (3_000_000, 0.0, False)}

"""Edge rows of FIXTURES.md section 3 for the cleaning and date functions."""

import datetime as dt

from pyspark.sql import functions as F

from donorlift.functions import codes as fx
from donorlift.operators import features as fe


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_short_date(spark):
    assert col1(spark, ["704", "9801", None], fx.fix_short_date) == ["0704", "9801", None]


def test_century_rule(spark):
    got = col1(spark, ["9706", "9801", "0104", "6801", "9913", "98x1", None], lambda c: fx.parse_yymm(c, 1997))
    assert got == [dt.date(1997, 6, 1), dt.date(1898, 1, 1), dt.date(1901, 4, 1), dt.date(1968, 1, 1), None, None, None]


def test_zip(spark):
    assert col1(spark, ["61081-", " ", ".", "02134", None], fx.clean_zip) == [61081, None, None, 2134, None]


def test_flags(spark):
    got = col1(spark, ["X", " ", "", "1", "0", "?", None], lambda c: fx.recode_binary(c, "X", " "))
    assert got == [1, 0, None, 1, 0, None, None]


def test_noexch_and_x_to_null(spark):
    assert col1(spark, ["X", "0", "1"], lambda c: fx.recode_binary(fx.replace_x_with_1(c), "1", "0")) == [1, 0, 1]
    assert col1(spark, ["X", "D"], fx.null_if_x) == [None, "D"]


def test_rfa_bytes(spark):
    vals = ["L4", "L4EE", "L4E"]
    assert col1(spark, vals, lambda c: fx.byte_at(c, 3, 1)) == [None, None, "L"]
    assert col1(spark, vals, lambda c: fx.byte_at(c, 3, 2).try_cast("int")) == [None, None, 4]
    assert col1(spark, vals, lambda c: fx.map_codes(fx.byte_at(c, 3, 3), fx.RFA_AMOUNT_ORDER)) == [None, None, 5]


def test_amount_repair(spark):
    df = spark.createDataFrame([(0, None, None), (1, None, "9604"), (2, 5.0, None)], "i int, a double, d string")
    got = [r[0] for r in df.orderBy("i").select(fx.repair_amount(F.col("a"), F.col("d"))).collect()]
    assert got == [0.0, None, 5.0]


def test_urban_ses(spark):
    df = spark.createDataFrame([(0, "U", "4"), (1, "U", "3"), (2, "R", "3")], "i int, u string, s string")
    got = [r[0] for r in df.orderBy("i").select(fx.urban_ses(F.col("u"), F.col("s"))).collect()]
    assert got == [3, 2, 3]


def test_months_to_donation(spark):
    df = spark.createDataFrame(
        [(0, dt.date(1996, 6, 1)), (1, dt.date(1996, 2, 1)), (2, None)], "i int, r date"
    )
    send = F.lit(dt.date(1996, 4, 1))
    got = [x[0] for x in df.orderBy("i").select(fe.months_to_donation(send, send, F.col("r"))).collect()]
    assert got == [2, 10, None]


def test_delta_months_and_years(spark):
    ref = dt.date(1997, 6, 1)
    df = spark.createDataFrame([(0, dt.date(1996, 1, 1)), (1, dt.date(1997, 9, 1))], "i int, d date")
    assert [r[0] for r in df.orderBy("i").select(fe.delta_months(ref, F.col("d"))).collect()] == [17, -3]
    df2 = spark.createDataFrame([(0, dt.date(1996, 7, 1)), (1, dt.date(1996, 6, 1))], "i int, d date")
    assert [r[0] for r in df2.orderBy("i").select(fe.membership_years(ref, F.col("d"))).collect()] == [1, 2]

"""Hot key: one member holds a third of all gifts.  The per-member summaries
and the grouped exact quartiles equal a brute-force computation."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from donorlift.operators import segments as sg

REF = dt.date(2001, 7, 1)


def fixture(spark, n=3000):
    rnd = random.Random(11)
    rows = []
    for g in range(n):
        m = 1 if g % 3 == 0 else rnd.randint(2, 200)
        d = dt.date(1995, 1, 1) + dt.timedelta(days=rnd.randint(0, 2370))
        rows.append((m, g, d, round(rnd.uniform(1000, 500000), 2)))
    return spark.createDataFrame(rows, "member_id long, gift_id long, gift_date date, amount double"), rows


def test_giving_summary_hot_member(spark):
    df, rows = fixture(spark)
    got = {r["member_id"]: r for r in sg.giving_summary(df, REF).collect()}
    pdf = pd.DataFrame(rows, columns=["member_id", "gift_id", "gift_date", "amount"])
    for m, grp in pdf.groupby("member_id"):
        r = got[m]
        srt = grp.sort_values(["gift_date", "gift_id"])
        assert r["ngiftall"] == len(grp)
        assert abs(r["ramntall"] - round(grp["amount"].sum(), 2)) < 1e-6
        assert r["fistdate"] == srt["gift_date"].iloc[0]
        if len(grp) > 1:
            assert r["nextdate"] == srt["gift_date"].iloc[1]
        last = grp.sort_values(["gift_date", "gift_id"]).iloc[-1]
        assert r["lastdate"] == last["gift_date"] and r["lastgift"] == last["amount"]
        assert r["maxramnt"] == grp["amount"].max() and r["minramnt"] == grp["amount"].min()
    assert got[1]["ngiftall"] == 1000


def test_quartiles_hot_group(spark):
    df, rows = fixture(spark)
    g = df.withColumn("seg", F.when(F.col("member_id") == 1, "hot").otherwise("rest"))
    got = {r["seg"]: r for r in sg.group_quartiles(g, ["seg"], "amount").collect()}
    pdf = pd.DataFrame(rows, columns=["member_id", "gift_id", "gift_date", "amount"])
    pdf["seg"] = ["hot" if m == 1 else "rest" for m in pdf["member_id"]]
    for seg, grp in pdf.groupby("seg"):
        for col, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert abs(got[seg][col] - round(grp["amount"].quantile(q), 4)) < 1e-4

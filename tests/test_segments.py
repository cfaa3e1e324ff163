"""Status at every campaign date."""

import datetime as dt

from pyspark.sql import functions as F

from donorlift.operators import segments as sg
from donorlift.sources import standin as si


def test_history_sends_no_gift_once_per_date(spark):
    """Gifts are combined by day and meet by member before the dates are spread."""
    gifts = si.gifts(si.Tables(spark, "/root/testdata/sf0.001"))
    plan = sg.rfa_history(gifts, si.campaigns(spark), si.REF, si.SCALE)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and "Aggregate" not in plan[: plan.index("Generate explode")]


def test_history_equals_the_status_of_each_date(spark):
    """Days with several gifts, members and gifts without a key or an amount."""
    at = lambda k: dt.date(1999, 1, 1) + dt.timedelta(days=37 * k % 900)
    rows = [(None if k % 50 == 0 else k % 17, k // 2, at(k // 3), None if k % 23 == 0 else 1000.0 * (k % 400)) for k in range(1500)]
    gifts = spark.createDataFrame(rows, "member_id long, gift_id long, gift_date date, amount double")
    campaigns = spark.createDataFrame([(3, dt.date(2001, 4, 1)), (4, dt.date(2000, 12, 15)), (7, dt.date(1999, 3, 1))], "i int, send_date date")
    got = sg.rfa_history(gifts, campaigns, si.REF, si.SCALE)
    for c in campaigns.collect():
        # the same rules, from the gifts before the date
        back = (c.send_date.year * 12 + c.send_date.month) - (F.year("gift_date") * 12 + F.month("gift_date"))
        card = F.ceil(((si.REF.year * 12 + si.REF.month) - (F.year("gift_date") * 12 + F.month("gift_date"))) / 3).cast("int") + 2
        g = gifts.where(F.col("gift_date") < F.lit(c.send_date)).withColumn("back", back).withColumn("ci", F.when((card <= 24) & (card % 3 == 0), card))
        want = sg._rfa_of(g, ["member_id"], si.SCALE)
        mine = got.where(F.col("i") == c.i).select(want.columns)
        assert want.count() > 10 and mine.exceptAll(want).isEmpty() and want.exceptAll(mine).isEmpty()

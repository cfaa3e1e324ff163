"""Plan shape: filters and projections reach the Parquet scan, tables are read
and built no oftener than needed."""

from donorlift.sources import standin as si

SMALL = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_gift_scan_pushdown(spark):
    t = si.Tables(spark, SMALL)
    p = plan_text(si.gifts(t).select("member_id", "amount"))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in p
    assert "o_orderpriority" not in p and "o_orderstatus" not in p


def test_giving_summary_scans_twice_and_copies_no_member(spark):
    from donorlift.operators import segments as sg

    t = si.Tables(spark, SMALL)
    df = sg.giving_summary(si.gifts(t), si.REF)
    p = plan_text(df)
    initial = p.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan") <= 2 and "Generate" not in initial and "WindowGroupLimit" in initial


def test_feature_table_is_stored_once(spark, monkeypatch):
    from donorlift.plans import q_models as q

    first = q.feature_frame(spark, SMALL)
    monkeypatch.setattr(q, "_build_features", None)  # a second build would fail
    again = q.feature_frame(spark, SMALL)
    assert first.df.inputFiles() == again.df.inputFiles() and again.names == q.FEATURES

"""Late data: a gift older than the watermark is dropped; windows are emitted
once the watermark passes their end.  (Spark judges late input of a
micro-batch against the previous batch's watermark, so the late file comes
two batches after the one that moves the watermark.)"""

import datetime as dt
import time

from pyspark.sql import functions as F

from donorlift.streaming import gifts as st


def test_late_gift_dropped(spark, tmp_path):
    src = tmp_path / "events"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    first = [(1, day(1), 7, "purchase", 10.0), (2, day(2), 7, "purchase", 5.0), (3, day(9), 8, "purchase", 1.0)]
    middle = [(5, day(8), 8, "purchase", 2.0)]        # within the watermark: counted
    late = [(4, day(1, 13), 7, "purchase", 100.0),    # behind the watermark (day 9 - 2 days): dropped
            (6, day(12), 9, "purchase", 3.0)]         # moves the watermark to day 10
    for name, rows in (("a", first), ("b", middle), ("c", late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
        time.sleep(1.2)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(src)))
    out = tmp_path / "out"
    q = (st.gift_window_agg(stream, "1 day", "2 days").writeStream.format("parquet")
         .option("path", str(out)).option("checkpointLocation", str(tmp_path / "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["window_start"].day, r["user_id"]): (r["n_gifts"], r["amount"])
           for r in spark.read.parquet(str(out)).collect()}
    assert got[(1, 7)] == (1, 10.0)      # the late 100.0 gift was dropped
    assert got[(2, 7)] == (1, 5.0)
    assert got[(8, 8)] == (1, 2.0)
    assert (12, 9) not in got            # its window is still open at the end


def _as_folder(spark, sf_dir, to, tables, files=3):
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(files).write.parquet(f"{to}/{t}.parquet")


def test_streams_read_tables_of_several_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    _as_folder(spark, sf, str(tmp_path), ["events"])
    for run in (st.gift_windows, st.gift_months, st.running_rfa, st.responses_to_mailings, st.dedup_gifts):
        one, folder = run(spark, sf), run(spark, str(tmp_path))
        assert one.count() > 0, run.__name__
        assert one.exceptAll(folder).isEmpty() and folder.exceptAll(one).isEmpty(), run.__name__


def test_redelivered_gift_dropped_across_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    day = lambda d: dt.datetime(2024, 1, d, 12)
    batches = [[(1, day(1), 7, "purchase", 10.0), (2, day(2), 7, "purchase", 10.0)],
               [(1, day(1), 7, "purchase", 10.0), (3, day(9), 7, "purchase", 10.0)],
               [(2, day(2), 7, "purchase", 10.0), (3, day(9), 7, "purchase", 10.0), (4, day(3), 8, "view", 0.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)
    got = st.dedup_gifts(spark, str(tmp_path), files_per_trigger=1)
    # equal amounts of one donor are gifts of their own; only equal ids go
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 4]


def test_months_drop_gifts_of_days_behind_the_watermark(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    at = lambda m, d: dt.datetime(2024, m, d, 12)
    batches = [[(1, at(1, 1), 7, "purchase", 10.0), (2, at(1, 31), 7, "purchase", 1.0)],
               [(3, at(4, 20), 7, "purchase", 2.0)],                  # moves the watermark to March
               [(4, at(4, 21), 8, "view", 0.0)],
               [(5, at(1, 1), 7, "purchase", 100.0), (6, at(4, 2), 7, "purchase", 4.0)]]  # dropped; counted
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)
    got = {(str(r["month"]), r["user_id"]): (r["n_gifts"], r["amount"]) for r in st.gift_months(spark, str(tmp_path), files_per_trigger=1).collect()}
    assert got == {("2024-01-01", 7): (2, 11.0), ("2024-04-01", 7): (2, 6.0)}


def test_parts_of_a_hot_donor_give_the_same_responses(spark):
    sf = "/root/testdata/sf0.001"
    one, many = (st.responses_to_mailings(spark, sf, parts=k) for k in (1, 5))
    assert one.count() > 0 and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_running_rfa_keeps_the_latest_state(spark, tmp_path, monkeypatch):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    day = lambda d: dt.datetime(2024, 1, d, 12)
    for i, rows in enumerate(([(1, day(1), 7, "purchase", 10.0), (2, day(1), 8, "purchase", 1.0)], [(3, day(2), 7, "purchase", 5.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)
    every = st.table_stream
    monkeypatch.setattr(st, "table_stream", lambda s, d, t: every(s, d, t, 1))
    got = {r["user_id"]: (r["frequency"], r["amount"]) for r in st.running_rfa(spark, str(tmp_path)).collect()}
    assert got == {7: (2, 15.0), 8: (1, 1.0)}


def test_status_on_a_stream_of_many_batches_equals_the_history(spark, tmp_path):
    """Classes age by timers: one file or many, some of them out of order, give
    the status of every campaign date."""
    from pyspark.sql import functions as F

    from donorlift.operators import segments as sg
    from donorlift.sources import standin as si

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    quarter = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
    low, high = orders.agg(F.min(quarter), F.max(quarter)).first()
    cuts = [low + (high - low) * k // 5 for k in range(6)]
    for k in range(5):
        part = orders.where((quarter >= cuts[k]) & ((quarter < cuts[k + 1]) | (F.lit(k) == 4)))
        part.orderBy(F.desc("o_orderdate")).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
        time.sleep(1.1)
    dates = [(r["i"], r["send_date"]) for r in si.campaigns(spark).collect()]
    want = sg.rfa_history(si.gifts(si.Tables(spark, sf)), si.campaigns(spark), si.REF, si.SCALE)
    for folder, files in ((sf, None), (str(tmp_path), 1)):
        got = st.rfa_status_stream(spark, folder, dates, si.REF, si.SCALE, files).select(want.columns)
        assert got.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_status_of_members_in_few_states(spark, tmp_path):
    """Members share states: so many at most as groups, whatever the key's
    type, members without a key, and the number of groups."""
    from donorlift.operators import segments as sg
    from donorlift.sources import standin as si

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    # some without a key, some members with two gifts a day
    orders = orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 10 != 1, F.col("o_custkey") % 40)).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    dates = [(r["i"], r["send_date"]) for r in si.campaigns(spark).collect()]
    want = sg.rfa_history(si.gifts(si.Tables(spark, str(tmp_path))), si.campaigns(spark), si.REF, si.SCALE)
    assert want.where("member_id IS NULL").count() > 0
    for kind, groups in (("bigint", 4), ("string", 4), ("bigint", 1000)):
        gifts = st.table_stream(spark, str(tmp_path), "orders").select(
            F.col("o_custkey").cast(kind).alias("member_id"), F.col("o_orderkey").alias("gift_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"))
        name = f"status_{kind}_{groups}"
        q = (st.rfa_changes(gifts, dates, si.REF, si.SCALE, groups=groups).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= groups + 1
        got = spark.table(name).withColumn("member_id", F.col("member_id").cast("bigint")).select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

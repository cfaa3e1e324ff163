"""Structured Streaming re-aims.

The reference has no streaming operator; its one streaming-shaped property
is "learn once, then apply the frozen transformations to later data".  The
stream jobs here read a Parquet table, one file or a folder of files, as a
file stream, run with ``trigger(availableNow=True)`` and write to a sink
under the shared checkpoint folder, so a restarted job resumes from its
checkpoint instead of recomputing.  All files that are there at the start
form one micro-batch unless ``files_per_trigger`` limits it.

Stand-in semantics on the driver's ``events`` table: an event of type
``purchase`` is a gift (``value`` = amount), a ``view`` is a mailing.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlift.session import ensure_checkpoint_dir

GIFT = "purchase"
MAILING = "view"


def _scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stream-{name}-{uuid.uuid4().hex}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(target).isDirectory()


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one Parquet table (schema from the batch reader: a
    stream source needs it up front).  A table that is a folder is read with
    all its files; a single file is picked out of its folder by name."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        s = reader.parquet(path)
    else:
        s = reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    # event time must be TIMESTAMP for watermarks; wall clock read as UTC
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return s.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in s.columns])


def _wall_clock(df: DataFrame) -> DataFrame:
    """Event-time columns back to wall-clock TIMESTAMP_NTZ for output."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema.fields
    ])


def _start(writer, spark: SparkSession):
    """Start a stream query with one state partition per core of the
    cluster (``defaultParallelism``).  The state partition count is fixed at
    a query's first start from the shuffle-partition setting; the session's
    own setting is restored right after the start."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def _run_append(df: DataFrame, name: str) -> DataFrame:
    """Append-mode query to a Parquet sink; returns the sink as a table."""
    spark = df.sparkSession
    root = _scratch(spark, name)
    q = (
        df.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/ckpt")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    q = _start(q, spark)
    q.awaitTermination()
    return _wall_clock(spark.read.schema(df.schema).parquet(f"{root}/out"))


def _run_update(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Update-mode aggregation: every micro-batch writes the rows that it
    changed, under its number (a repeated batch replaces its own folder), and
    the latest row of each key is the result."""
    spark = df.sparkSession
    root = _scratch(spark, name)
    out = f"{root}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/ckpt")
        .outputMode("update")
        .trigger(availableNow=True)
    )
    q = _start(q, spark)
    q.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return _wall_clock(last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns]))


def gift_windows(spark: SparkSession, sf_dir: str, window: str = "1 day", lateness: str = "2 days", slide: str | None = None) -> DataFrame:
    """Gifts and amount per donor per tumbling or sliding window; gifts
    later than the watermark are dropped, a window is emitted once the
    watermark has passed its end."""
    ev = table_stream(spark, sf_dir, "events")
    return _run_append(gift_window_agg(ev, window, lateness, slide), "gift-windows")


def gift_months(spark: SparkSession, sf_dir: str, lateness: str = "31 days", files_per_trigger: int | None = None) -> DataFrame:
    """T2 by calendar month: running gifts and amount per donor and month.
    Months are no fixed window, so the stream adds up days, each under its
    month; a day's state goes once the watermark has passed it, and later gifts
    of that day are dropped.  The days become months when the result is read."""
    ev = table_stream(spark, sf_dir, "events", files_per_trigger)
    days = (
        ev.where(F.col("event_type") == GIFT)
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), F.trunc("ts", "month").alias("month"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_gifts"), F.sum("value").alias("amount"))
        .select(F.col("w.start").alias("day"), "month", "user_id", "n_gifts", "amount")
    )
    return _run_update(days, "gift-months", ["day", "month", "user_id"]).groupBy("month", "user_id").agg(
        F.sum("n_gifts").alias("n_gifts"), F.round(F.sum("amount"), 2).alias("amount")
    )


def gift_window_agg(events: DataFrame, window: str = "1 day", lateness: str = "2 days", slide: str | None = None) -> DataFrame:
    """The T2 transformation on an event stream (event time ``ts``)."""
    return (
        events.where(F.col("event_type") == GIFT)
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", window, slide).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_gifts"), F.sum("value").alias("amount"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "user_id", "n_gifts", F.round("amount", 2).alias("amount"))
    )


def running_rfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running recency / frequency / amount per donor; each batch writes
    the donors that it changed."""
    ev = table_stream(spark, sf_dir, "events").where(F.col("event_type") == GIFT)
    agg = ev.groupBy("user_id").agg(
        F.max("ts").alias("last_gift_ts"),
        F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("value"), 2).alias("amount"),
    )
    return _run_update(agg, "running-rfa", ["user_id"])


def responses_to_mailings(spark: SparkSession, sf_dir: str, within: str = "1 day", parts: int = 4) -> DataFrame:
    """T4: each gift matched to the mailings of the same donor in the
    preceding ``within`` (stream-stream inner join with time bounds and
    watermarks on both sides, so join state is cleaned up).  AQE does not split
    a hot key of a stream: a donor's gifts are dealt to ``parts`` by their id,
    and each mailing goes to every part, so any number gives the same rows."""
    ev = table_stream(spark, sf_dir, "events")
    mail = ev.where(F.col("event_type") == MAILING).select(
        F.col("event_id").alias("mailing_id"), F.col("user_id").alias("m_user"), F.col("ts").alias("mailed_ts"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("m_part"),
    ).withWatermark("mailed_ts", "2 days")
    gift = ev.where(F.col("event_type") == GIFT).select(
        F.col("event_id").alias("gift_id"), F.col("user_id").alias("g_user"), F.col("ts").alias("gift_ts"),
        F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int").alias("g_part"),
    ).withWatermark("gift_ts", "2 days")
    j = mail.join(
        gift,
        F.expr(f"m_user = g_user AND m_part = g_part AND gift_ts >= mailed_ts AND gift_ts <= mailed_ts + interval {within}"),
        "inner",
    ).select("mailing_id", "gift_id", F.col("m_user").alias("user_id"), "mailed_ts", "gift_ts")
    return _run_append(j, "responses")


def dedup_gifts(spark: SparkSession, sf_dir: str, keep: str = "30 days", files_per_trigger: int | None = None) -> DataFrame:
    """T5: events delivered again (same ``event_id``) are dropped.  Ids are
    remembered for ``keep`` behind the latest event time; a redelivery counts
    as such in whatever batch it arrives, and events later than that are
    dropped as late."""
    ev = table_stream(spark, sf_dir, "events", files_per_trigger).withWatermark("ts", keep)
    d = ev.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type", "value")
    return _run_append(d, "dedup")


def score_stream(spark: SparkSession, sf_dir: str, model: PipelineModel, features: DataFrame, key: str) -> DataFrame:
    """Score arriving members with a frozen, fitted pipeline.  The
    member stream is joined to a static feature table (stream-static join)
    and only ``transform`` runs on the stream."""
    members = table_stream(spark, sf_dir, "customer").select(F.col("c_custkey").alias(key))
    scored = model.transform(members.join(features, key, "inner"))
    out = scored.select(key, vector_to_array("probability")[1].alias("p"))
    return _run_append(out, "score")


# ---- T3 with E11: recency / frequency / amount status on a stream ------------------
#: Columns of a status row after its key, as ``rfa_history`` gives them.
STATUS = "i int, recency string, frequency int, amount string, rfa string, star boolean, months_since_last int"


#: Groups that the members of a status stream are dealt to.
STATUS_GROUPS = 1024


def rfa_changes(gifts: DataFrame, campaigns: list[tuple], ref, scale: float, key: str = "member_id", lateness: str = "31 days", groups: int = STATUS_GROUPS) -> DataFrame:
    """E11 on a stream of gifts (key, gift_id, ts, amount): the status of a
    member at the sending date of each campaign (i, date), from the gifts
    before it.  A class ages without a new gift, so the status is not given
    when a gift arrives but by an event-time timer at each date, once the
    watermark has passed it.

    Members are dealt to ``groups`` by hash; a group has one state and one
    timer, and its members are judged together.  State: for each member and day
    with gifts their number and the last one -- at most as many entries
    as there are days, however many gifts a member makes, and the same in
    whatever order they arrive -- and the dates that are done.  Gifts later than
    the watermark are dropped.  Dates without an earlier gift give no row."""
    import datetime as dt

    import numpy as np
    import pandas as pd

    from donorlift.operators import segments as sg

    edges, codes = [e * scale for e in sg.RFA_AMOUNT_EDGES], np.array(sg.RFA_AMOUNT_CODES, object)
    every, ref_month = sg.CARD_EVERY, ref.year * 12 + ref.month - 1
    first = dt.date(1970, 1, 1).toordinal()
    # a date counts as passed a day later, in any time zone of the session
    dates = sorted(((d.toordinal() + 1 - first) * 86_400_000, d.toordinal() - first, i, d.year * 12 + d.month - 1) for i, d in campaigns)
    kind = gifts.schema[key].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")  # kept as bytes, others as a list
    names = [key, *[c.split()[0] for c in STATUS.split(", ")]]

    def merged(member, day, n, gid, amount):
        """One entry per member and day, in this order: gifts added up, the last one kept."""
        order = np.lexsort((amount, gid, day, member))
        member, day, n, gid, amount = (v[order] for v in (member, day, n, gid, amount))
        new = np.ones(len(day), bool)
        new[1:] = (member[1:] != member[:-1]) | (day[1:] != day[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(day)) - 1
        return member[at], day[at], np.add.reduceat(n, at) if len(at) else n, gid[last], amount[last]

    def status(held, day: int, i: int, month: int):
        """The status rows of all members with an entry before the date."""
        before = held[1] < day
        member, days, n, _, amount = (v[before] for v in held)
        if not len(days):
            return None
        at = np.flatnonzero(np.append(True, member[1:] != member[:-1]))
        last = np.append(at[1:], len(days)) - 1
        months = days.astype("datetime64[D]").astype("datetime64[M]").astype("int64") + 1970 * 12
        back = month - months
        total = lambda v: np.add.reduceat(v, at)
        n12, n24, n36 = (total(np.where((back >= lo) & (back <= hi), n, 0)) for lo, hi in ((-10**9, 12), (13, 24), (25, 36)))
        card = -(-(ref_month - months) // 3) + 2
        answers = (card <= 24) & (card % every == 0)
        owner = np.repeat(np.arange(len(at)), last - at + 1)[answers]
        low = card.min()
        wide = int(card.max() - low) + 2 * every + 1
        held_cards = owner * wide + (card[answers] - low)
        star = np.zeros(len(at), bool)
        star[owner[np.isin(held_cards + every, held_cards) & np.isin(held_cards + 2 * every, held_cards)]] = True
        oldest, newest = back[at], back[last]
        recency = np.select([star, (oldest <= 6) & (total(n) == 1), oldest <= 12, newest <= 12, newest <= 24], list("SFNAL"), "I").astype(object)
        frequency = np.clip(np.where(recency == "L", n24, np.where(recency == "I", n36, n12)), 1, 4)
        band = codes[np.searchsorted(edges, amount[last], side="right")]
        rfa = recency + frequency.astype(str).astype(object) + band
        return pd.DataFrame(dict(zip(names, (member[at], np.full(len(at), i), recency, frequency, band, rfa, star, newest), strict=True)))

    def step(keys, frames, state):
        done, held = 0, (np.zeros(0, "int64" if whole else object), *(np.zeros(0, t) for t in ("int32", "int64", "int64", "float64")))
        if state.exists:
            done, member, *rest = state.get
            held = (np.frombuffer(member, "int64") if whole else np.array(member, object), *(np.frombuffer(v, h.dtype) for v, h in zip(rest, held[1:], strict=True)))
        passed, more = state.getCurrentWatermarkMs(), [held]
        for pdf in frames if not state.hasTimedOut else ():
            day = pdf["ts"].to_numpy().astype("datetime64[D]").astype("int32")
            more.append((pdf["_member"].to_numpy(), day, np.ones(len(day), "int64"), pdf["gift_id"].to_numpy(), pdf["amount"].to_numpy(float)))
        if len(more) > 1:
            held = merged(*(np.concatenate(v) for v in zip(*more, strict=True)))
        out = []
        while done < len(dates) and dates[done][0] <= passed:
            out.append(status(held, *dates[done][1:]))
            done += 1
        if done == len(dates):  # nothing is left to judge
            held = tuple(v[:0] for v in held)
        member, *rest = held
        state.update((done, member.astype("int64").tobytes() if whole else member.tolist(), *(v.tobytes() for v in rest)))
        if done < len(dates):
            state.setTimeoutTimestamp(dates[done][0])
        for rows in out:
            if rows is not None:
                yield rows if keys[0] >= 0 else rows.assign(**{key: None})  # members without a key are one member

    member = F.coalesce(F.col(key), F.lit(0).cast(kind)).cast("bigint") if whole else F.coalesce(F.col(key), F.lit("").cast(kind))
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups))).cast("int")
    rows = gifts.where(F.col("ts").isNotNull()).select(
        group.alias("_group"), member.alias("_member"), F.coalesce(F.col("gift_id").cast("bigint"), F.lit(-(1 << 63))).alias("gift_id"), "ts", F.col("amount").cast("double").alias("amount")
    ).withWatermark("ts", lateness)
    kept = f"done int, member {'binary' if whole else f'array<{kind}>'}, day binary, n binary, gift_id binary, amount binary"
    return rows.groupBy("_group").applyInPandasWithState(step, f"{key} {kind}, {STATUS}", kept, "append", "EventTimeTimeout")


def rfa_status_stream(spark: SparkSession, sf_dir: str, campaigns: list[tuple], ref, scale: float, files_per_trigger: int | None = None) -> DataFrame:
    """The status at every campaign date from the stream of orders."""
    orders = table_stream(spark, sf_dir, "orders", files_per_trigger)
    gifts = orders.select(F.col("o_custkey").alias("member_id"), F.col("o_orderkey").alias("gift_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"))
    return _run_append(rfa_changes(gifts, campaigns, ref, scale), "rfa-status")

"""Feature engineering (E1-E13): elapsed-time features, history reshaping,
recency/frequency/amount status and encoders' helpers.

All features are column expressions or grouped aggregations keyed by
member; nothing runs per row in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlift.functions import codes as fx


def wide_history(history: DataFrame, campaigns: Sequence[int], key: str = "member_id") -> DataFrame:
    """Long (member, i, rdate, ramnt) -> one row per member with
    RDATE_i / RAMNT_i columns, by conditional aggregation on the key
    (partial aggregation map-side; the campaign list is fixed)."""
    aggs = []
    for i in campaigns:
        aggs.append(F.max(F.when(F.col("i") == i, F.col("rdate"))).alias(f"RDATE_{i}"))
        aggs.append(F.max(F.when(F.col("i") == i, F.col("ramnt"))).alias(f"RAMNT_{i}"))
    return history.groupBy(key).agg(*aggs)


def delta_months(ref, d: Column) -> Column:
    """Whole months from a month-precision date to the reference date."""
    r = ref if isinstance(ref, Column) else F.lit(ref)
    return fx.months_between_whole(r, F.trunc(d, "month"))


def membership_years(ref, d: Column) -> Column:
    """Whole years between the date and the reference date, plus one."""
    return fx.whole_years(delta_months(ref, d)) + 1


def months_to_donation(send: Column, first_send: Column, received: Column) -> Column:
    """Months from the campaign's first sending month to the gift month;
    a negative span means the year was off: add 12.  No gift -> null."""
    m = fx.months_between_whole(F.trunc(received, "month"), F.trunc(first_send, "month"))
    return F.when(received.isNull(), F.lit(None).cast("int")).when(m < 0, m + 12).otherwise(m)


def fit_first_send(history: DataFrame) -> DataFrame:
    """Learn each campaign's first sending month once (a table of
    one row per campaign)."""
    return history.groupBy("i").agg(F.min("send_date").alias("first_send"))


def first_send_lookup(history: DataFrame) -> Column:
    """E2/Q7 fit, applied as a literal: the learned (campaign -> first send)
    table has one row per campaign, so it is collected once and becomes a
    map expression; the history is then not evaluated twice in one plan."""
    rows = fit_first_send(history).collect()
    m = F.create_map(*[x for r in rows for x in (F.lit(r["i"]), F.lit(r["first_send"]))])
    return m[F.col("i")]


def member_features(
    members: DataFrame,
    giving: DataFrame,
    promotions: DataFrame,
    targets: DataFrame,
    ref,
    scale: float,
    segments: Sequence[str],
    key: str = "member_id",
) -> tuple[DataFrame, list[str]]:
    """Model table: one row per member with numeric features (non-donors get
    zeros and a recency of 99 months) and the targets.  All inputs are keyed
    by member, so the joins are co-partitioned on the key."""
    ref_idx = fx.month_index(F.lit(ref))
    g = giving.select(
        key,
        F.col("ngiftall").cast("double").alias("n_gifts"),
        (F.col("ramntall") / scale).alias("total_amount"),
        (F.col("avggift") / scale).alias("mean_gift"),
        (F.col("lastgift") / scale).alias("last_gift"),
        (ref_idx - fx.month_index(F.col("lastdate"))).cast("double").alias("months_since_last"),
        F.col("timelag").cast("double").alias("timelag"),
    )
    p = promotions.select(key, F.col("numprom").cast("double").alias("n_promotions"),
                          F.col("n_responses").cast("double").alias("n_responses"))
    m = members.select(key, (F.col("acctbal") / 1000.0).alias("acctbal"), "segment")
    j = m.join(targets, key, "inner").join(g, key, "left").join(p, key, "left")
    zero = ["n_gifts", "total_amount", "mean_gift", "last_gift", "timelag", "n_promotions", "n_responses"]
    j = j.fillna(0.0, zero).fillna(99.0, ["months_since_last"])
    seg = [F.coalesce(F.col("segment") == F.lit(s), F.lit(False)).cast("double").alias(f"seg_{s}") for s in segments]
    names = ["acctbal"] + zero[:4] + ["months_since_last", "timelag", "n_promotions", "n_responses"] + [
        f"seg_{s}" for s in segments
    ]
    out = j.select(key, "target_b", "target_d", *[c for c in names if not c.startswith("seg_")], *seg)
    return out, names

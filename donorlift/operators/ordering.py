"""Exact order statistics without sending a whole group to one task.

A plain ``Window.partitionBy(g).orderBy(x)`` puts every row of a group into
one task, and an un-partitioned window puts the whole table there.  When a
single group may hold a third of all rows, that task is the job.  The
helpers below instead

1. range-partition on (group, order) so that one hot group is split into
   several slices of about equal size,
2. checkpoint the narrow slice table into the shared checkpoint folder so
   slice numbers are fixed for the two passes that follow,
3. compute per-(slice, group) counts / sums (a small table: slices x groups),
   turn them into offsets with a window over at most ``slices`` rows per
   group, and
4. add the offset to the number that a row got inside its (slice, group)
   chunk when the slice was sorted (running sums: from a window per chunk).

Every result equals the single-task window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlift.session import ensure_checkpoint_dir


# Offsets tables up to this many rows are broadcast; bigger ones are joined
# with a shuffle.  The table has (slices x groups) rows, so it is bounded by
# the number of groups, never by the number of rows.
BROADCAST_OFFSETS_MAX_ROWS = 200_000
# Rows (group, value, count) up to which quantiles need no slices; more are
# range-partitioned.  The result is the same.
SMALL_VALUES = 200_000

# Tables of more rows are never broadcast: Spark goes by the size of compressed
# files, and the driver would hold the whole table.
BROADCAST_TABLE_MAX_ROWS = 200_000

OrderSpec = Sequence[tuple[str, bool]]  # (column, ascending)


def not_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one side of a join of tables of so many rows: large ones are
    shuffled, none passes through the driver."""
    return df.hint("merge") if rows > BROADCAST_TABLE_MAX_ROWS else df


def _sort_cols(group_cols: Sequence[str], order: OrderSpec) -> list[Column]:
    cols = [F.col(g).asc_nulls_first() for g in group_cols]
    for c, asc in order:
        cols.append(F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last())
    return cols


def sliced(
    df: DataFrame,
    order: OrderSpec,
    group_cols: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Range-partition on (group, order), tag each row with its slice and
    checkpoint, so later passes see the same slices even after a retry."""
    ensure_checkpoint_dir(df.sparkSession)
    sort = _sort_cols(group_cols, order)
    # Without an explicit count the range exchange may be coalesced by AQE:
    # adjacent ranges merge up to the advisory partition size, so small
    # inputs get few slices and large ones many; order is preserved.
    ranged = df.repartitionByRange(slices, *sort) if slices else df.repartitionByRange(*sort)
    # rows are numbered in their slice on the spot: the low 33 bits of Spark's
    # increasing id count the rows of a partition
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = ranged.sortWithinPartitions(*sort).withColumn("_slice", F.spark_partition_id()).withColumn("_idx", inside)
    return out.checkpoint(eager=True)


def _offsets(
    sl: DataFrame, group_cols: Sequence[str], sum_cols: Sequence[str]
) -> DataFrame:
    """Per (slice, group): rows and sums in all earlier slices of the group,
    and the group's totals."""
    aggs = [F.count(F.lit(1)).alias("_cnt"), F.min("_idx").alias("_at")] + [
        F.sum(c).alias(f"_sum_{c}") for c in sum_cols
    ]
    stats = sl.groupBy("_slice", *group_cols).agg(*aggs)
    before = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*group_cols)
    cols = [
        "_slice",
        *group_cols,
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off_cnt"),
        F.sum("_cnt").over(whole).alias("_n"),
        "_at",
    ]
    for c in sum_cols:
        cols.append(F.sum(f"_sum_{c}").over(before).alias(f"_off_{c}"))
        cols.append(F.sum(f"_sum_{c}").over(whole).alias(f"_tot_{c}"))
    return stats.select(*cols)


def _attach(sl: DataFrame, off: DataFrame, keys: list[str]) -> DataFrame:
    """Join the offsets (slices x groups rows) back: broadcast after a
    count shows it is small, so the big sliced side is never shuffled;
    otherwise a shuffle join."""
    n = off.count()
    if n <= BROADCAST_OFFSETS_MAX_ROWS:
        off = F.broadcast(off)
    # null-safe on group keys: groups may be null
    cond = [sl[k].eqNullSafe(off[k]) for k in keys]
    joined = sl.join(off, cond, "inner")
    return joined.select(sl["*"], *[off[c] for c in off.columns if c not in keys])


def with_positions(
    df: DataFrame,
    order: OrderSpec,
    group_cols: Sequence[str] = (),
    slices: int | None = None,
    pos_col: str = "_pos",
    size_col: str = "_n",
) -> DataFrame:
    """Add the exact 1-based position of each row in its group (like
    ``row_number``) and the group size.  The order must be total (end it
    with a unique key) for the result to be deterministic."""
    sl = sliced(df, order, group_cols, slices)
    off = _offsets(sl, group_cols, [])
    out = _attach(sl, off, ["_slice", *group_cols])
    # a group's rows lie together in a slice, from its row number _at on: no
    # second shuffle of the table
    return out.withColumn(pos_col, F.col("_off_cnt") + F.col("_idx") - F.col("_at") + 1).withColumnRenamed(
        "_n", size_col
    ).drop("_slice", "_idx", "_at", "_off_cnt")


def with_prefix_sums(
    df: DataFrame,
    order: OrderSpec,
    sum_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``cum_<c>`` (rows up to and including this
    one in order) and group totals ``tot_<c>``, plus ``_pos`` and ``_n``."""
    sl = sliced(df, order, group_cols, slices)
    off = _offsets(sl, group_cols, sum_cols)
    local = (
        Window.partitionBy("_slice", *group_cols)
        .orderBy(*_sort_cols((), order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    sl = sl.withColumn("_lpos", F.row_number().over(
        Window.partitionBy("_slice", *group_cols).orderBy(*_sort_cols((), order))
    ))
    for c in sum_cols:
        sl = sl.withColumn(f"_lcum_{c}", F.sum(c).over(local))
    out = _attach(sl, off, ["_slice", *group_cols])
    out = out.withColumn("_pos", F.col("_off_cnt") + F.col("_lpos"))
    for c in sum_cols:
        out = out.withColumn(
            f"cum_{c}", F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.col(f"_lcum_{c}")
        ).withColumnRenamed(f"_tot_{c}", f"tot_{c}")
    drop = ["_slice", "_lpos", "_idx", "_at", "_off_cnt"] + [f"_off_{c}" for c in sum_cols] + [
        f"_lcum_{c}" for c in sum_cols
    ]
    return out.drop(*drop)


def ntile_of(pos: Column, n: Column, buckets: int) -> Column:
    """SQL NTILE(buckets) from an exact position and group size: the first
    (n mod b) tiles hold one extra row."""
    q = F.floor(n / buckets)
    r = n % buckets
    big = r * (q + 1)
    return F.when(pos <= big, F.floor((pos - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((pos - big - 1) / q) + 1
    ).cast("int")


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    key_col: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (``percentile`` /
    ``quantile_cont``) per group, with hot groups split across slices.

    The rows are first reduced to (group, value, count) by a partial +
    final aggregation, so repeated values cost nothing; running counts in
    value order then give each distinct value its position range, and only
    the values covering the needed positions survive.  Output: group
    columns + one column ``q<i>`` per probability.  Nulls are ignored."""
    del key_col  # ties share a value: the order among them does not matter
    counts = (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, value_col)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ensure_checkpoint_dir(df.sparkSession)
    counts = counts.checkpoint(eager=True)
    if slices is None and counts.count() <= SMALL_VALUES:
        # few distinct values: one ordered pass over a bounded table, no slices
        by = Window.partitionBy(*group_cols)
        pref = counts.withColumn("cum__c", F.sum("_c").over(by.orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot__c", F.sum("_c").over(by))
    else:
        pref = with_prefix_sums(counts, [(value_col, True)], ["_c"], group_cols, slices)
    want = []
    for i, p in enumerate(probs):
        h = (F.col("tot__c") - 1) * F.lit(float(p)) + 1
        want.append(
            F.struct(
                F.lit(i).alias("qi"),
                F.floor(h).cast("long").alias("lo"),
                F.ceil(h).cast("long").alias("hi"),
                (h - F.floor(h)).alias("frac"),
            )
        )
    first = F.col("cum__c") - F.col("_c") + 1
    last = F.col("cum__c")
    has_lo = (first <= F.col("w.lo")) & (F.col("w.lo") <= last)
    has_hi = (first <= F.col("w.hi")) & (F.col("w.hi") <= last)
    picked = pref.select(
        *group_cols, value_col, "_c", "cum__c", F.explode(F.array(*want)).alias("w")
    ).where(has_lo | has_hi)
    per = picked.groupBy(*group_cols, F.col("w.qi").alias("qi")).agg(
        F.max(F.when(has_lo, F.col(value_col))).alias("vlo"),
        F.max(F.when(has_hi, F.col(value_col))).alias("vhi"),
        F.first("w.frac").alias("frac"),
    )
    per = per.select(
        *group_cols,
        "qi",
        (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("qv"),
    )
    return (
        per.groupBy(*group_cols)
        .pivot("qi", list(range(len(probs))))
        .agg(F.first("qv"))
        .select(*group_cols, *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))])
    )

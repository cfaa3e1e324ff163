"""Campaign profit: whom to mail and what it earns.

A member is mailed at alpha when ``p * exp(d_t) * alpha > exp(u_t)``, with p
the response probability, d_t the (transformed) predicted amount and u_t the
unit cost under the same transform.  Equivalently, each member has a
*critical alpha* ``c = exp(u_t - d_t) / p`` and is mailed iff ``alpha > c``.

The reference evaluates the profit on a grid of N alphas with one full scan
per alpha.  Here every member is assigned once to the first grid index
where it is mailed; a grouped sum per index and a running sum over at most N
grid rows give the whole curve in one pass over the members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlift.functions.money import cents, cents_lit, from_cents
from donorlift.operators.ordering import exact_quantiles, with_prefix_sums

DEFAULT_GRID = 10_000


def critical_alpha(p: Column, d_t: Column, u_t: Column | float) -> Column:
    """c = exp(u_t - d_t) / p; null (never mailed) when p <= 0 or unknown."""
    u = u_t if isinstance(u_t, Column) else F.lit(float(u_t))
    return F.when(p > 0, F.exp(u - d_t) / p)


def critical_alpha_amount(p: Column, d_hat: Column, unit_cost: float) -> Column:
    """Same rule with a log transform (d_t = ln d_hat, u_t = ln U), written
    without exp/ln: c = U / (p * d_hat)."""
    return F.when((p > 0) & (d_hat > 0), F.lit(float(unit_cost)) / (p * d_hat))


def donor_indicator(crit: Column, alpha: Column | float) -> Column:
    """Mailed iff alpha > c; a null c is never mailed."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.coalesce(a > crit, F.lit(False))


def grid_alpha(k: Column, n_grid: int) -> Column:
    return k / F.lit(n_grid - 1)


def first_mailed_index(crit: Column, n_grid: int) -> Column:
    """Smallest k with k/(N-1) > c (exactly the naive comparison: the
    floor estimate is corrected by one step either way)."""
    m = n_grid - 1
    b0 = (F.floor(crit * F.lit(m)) + 1).cast("long")
    return (
        F.when(grid_alpha(b0 - 1, n_grid) > crit, b0 - 1)
        .when(grid_alpha(b0, n_grid) <= crit, b0 + 1)
        .otherwise(b0)
    )


def _net(amount: Column, unit_cost: float) -> Column:
    """Profit of one mailed member, in integer cents (exact)."""
    return cents(amount) - cents_lit(unit_cost)


def bucket_stats(
    df: DataFrame, crit_col: str, amount_col: str, unit_cost: float, n_grid: int = DEFAULT_GRID
) -> DataFrame:
    """Per first-mailed grid index: members, sum/sum of squares/min/max of
    net profit.  At most N rows; partial aggregation happens map-side."""
    b = first_mailed_index(F.col(crit_col), n_grid)
    net = _net(F.col(amount_col), unit_cost)
    return (
        df.select(b.alias("k"), net.alias("net"))
        .where(F.col("k").isNotNull() & (F.col("k") <= n_grid - 1))
        .groupBy("k")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("net").alias("s"),
            F.sum(from_cents(F.col("net")) * from_cents(F.col("net"))).alias("ss"),
            F.min("net").alias("mn"),
            F.max("net").alias("mx"),
        )
    )


def profit_curve(
    df: DataFrame,
    crit_col: str,
    amount_col: str,
    unit_cost: float,
    n_grid: int = DEFAULT_GRID,
) -> DataFrame:
    """(k, alpha, n_mailed, profit) for k = 0 .. N-1, alpha = k/(N-1).

    One grouped pass over the members; the running sum runs over the N grid
    rows only (a parameter-bounded, un-partitioned window)."""
    spark = df.sparkSession
    stats = bucket_stats(df, crit_col, amount_col, unit_cost, n_grid)
    grid = spark.range(0, n_grid).select(F.col("id").alias("k"))
    # stats has at most n_grid rows: a bounded broadcast
    j = grid.join(F.broadcast(stats.select("k", "n", "s")), "k", "left")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        F.col("k"),
        grid_alpha(F.col("k"), n_grid).alias("alpha"),
        F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("n_mailed"),
        from_cents(F.coalesce(F.sum("s").over(w), F.lit(0).cast("long"))).alias("profit"),
    )


def predicted_curve(
    df: DataFrame, crit_col: str, pred_amount_col: str, unit_cost: float, n_grid: int = DEFAULT_GRID
) -> DataFrame:
    """G7 over the grid: profit if every mailed member gave its predicted
    amount (k, profit), one pass as in ``profit_curve``."""
    spark = df.sparkSession
    b = first_mailed_index(F.col(crit_col), n_grid)
    stats = (
        df.select(b.alias("k"), (F.col(pred_amount_col) - F.lit(unit_cost)).alias("v"))
        .where(F.col("k").isNotNull() & (F.col("k") <= n_grid - 1))
        .groupBy("k").agg(F.sum("v").alias("s"))
    )
    grid = spark.range(0, n_grid).select(F.col("id").alias("k"))
    j = grid.join(F.broadcast(stats), "k", "left")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("k", F.round(F.coalesce(F.sum("s").over(w), F.lit(0.0)), 2).alias("profit"))


def alpha_star(curve: DataFrame) -> DataFrame:
    """The grid point of greatest profit; ties go to the smallest
    alpha.  Exact: the curve is a step function evaluated on the grid.
    The window spans the N grid rows only."""
    w = Window.partitionBy()
    best = F.max(F.struct("profit", (-F.col("k")).alias("nk"))).over(w)
    return (
        curve.withColumn("_b", best)
        .where(F.col("k") == -F.col("_b.nk"))
        .select("k", "alpha", "n_mailed", "profit")
    )


def fit_alpha_star(curve: DataFrame) -> int:
    """Learn k* once (a single scalar reaches the driver); applying it to
    members is then a literal comparison, as with any fitted threshold."""
    return int(alpha_star(curve).first()["k"])


def exact_alpha_star(df: DataFrame, crit_col: str, amount_col: str, unit_cost: float, greatest: float = 1.0) -> DataFrame:
    """G5 without a grid: profit is a step function of alpha that changes at the
    members' critical values, so its greatest value is a running sum over those
    values in order (a distributed one; the best step of each slice meets the
    others' in an aggregation).  One row: the profit holds for ``above`` <
    alpha <= ``upto`` (null: without end), ``alpha`` lies between the two;
    ties go to the smallest alpha.  Only alphas up to ``greatest`` count, and
    where mailing anybody loses money alpha is 0."""
    steps = (
        df.where(F.col(crit_col) < F.lit(greatest))
        .groupBy(F.col(crit_col).alias("crit"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_net(F.col(amount_col), unit_cost)).alias("s"))
    )
    running = with_prefix_sums(steps, [("crit", True)], ["n", "s"]).select("crit", "cum_n", "cum_s").checkpoint(eager=True)
    best = running.where("cum_s > 0").agg(F.max(F.struct("cum_s", (-F.col("crit")).alias("nc"), "cum_n")).alias("b")).first()["b"]  # one row
    spark = df.sparkSession
    if best is None:
        low, n, s = None, 0, 0
        high = running.agg(F.min("crit")).first()[0]
        alpha = 0.0
    else:
        low, n, s = -best["nc"], best["cum_n"], best["cum_s"]
        high = df.where(F.col(crit_col) > F.lit(low)).agg(F.min(crit_col)).first()[0]
        top = greatest if high is None else min(high, greatest)
        alpha = (low + top) / 2 if low < (low + top) / 2 else top
    one = spark.createDataFrame([(low, high, alpha, n, int(s))], "above double, upto double, alpha double, n_mailed long, _s long")
    return one.select("above", "upto", "alpha", "n_mailed", from_cents(F.col("_s")).alias("profit"))


def early_stop_point(curve: DataFrame, patience: int = 200) -> DataFrame:
    """First grid index where the last ``patience`` profits are equal
    (the reference's stop rule on a flat curve)."""
    w = Window.orderBy("k").rowsBetween(-(patience - 1), 0)
    flat = curve.select(
        "k",
        "alpha",
        "profit",
        (F.max("profit").over(w) - F.min("profit").over(w)).alias("spread"),
        F.count(F.lit(1)).over(w).alias("seen"),
    ).where((F.col("seen") == patience) & (F.col("spread") == 0))
    return flat.agg(F.min(F.struct("k", "alpha", "profit")).alias("f")).select(
        F.col("f.k").alias("k"), F.col("f.alpha").alias("alpha"), F.col("f.profit").alias("profit")
    )


def max_profit(df: DataFrame, amount_col: str, unit_cost: float) -> DataFrame:
    """Profit when exactly the responders are mailed."""
    net = _net(F.col(amount_col), unit_cost)
    return df.agg(
        from_cents(F.sum(F.when(F.col(amount_col) > 0, net))).alias("max_profit"),
        F.count(F.when(F.col(amount_col) > 0, 1)).alias("n_responders"),
    )


def mailed_at(crit_col: str, kstar: int, n_grid: int = DEFAULT_GRID) -> Column:
    """G2 at a learned grid index: mailed iff first index <= k*."""
    return F.coalesce(first_mailed_index(F.col(crit_col), n_grid) <= F.lit(kstar), F.lit(False))


def net_profit(
    df: DataFrame, key: str, crit_col: str, amount_col: str, unit_cost: float, kstar: int,
    n_grid: int = DEFAULT_GRID,
) -> DataFrame:
    """Per member (mailed 0/1, realised profit)."""
    m = mailed_at(crit_col, kstar, n_grid)
    return df.select(
        key,
        m.cast("int").alias("mailed"),
        from_cents(F.when(m, _net(F.col(amount_col), unit_cost)).otherwise(F.lit(0).cast("long")))
        .alias("profit"),
    )


def mailing_summary(
    df: DataFrame,
    crit_col: str,
    amount_col: str,
    pred_amount_col: str,
    unit_cost: float,
    kstar: int | None = None,
    n_grid: int = DEFAULT_GRID,
) -> DataFrame:
    """G9/G7/A21 at alpha*: mailed count; min/mean/std/max of profit per
    mailed member; realised and predicted total; share of the maximum.
    If every mailing loses money, nobody is mailed (index 0, profit 0), as
    ``alpha_star`` has it; a deviation of one member and a share of a maximum
    of 0 are null.

    One pass over the members: they are reduced to one row per first-mailed
    grid index (plus one row for the never mailed) with count, sum, sum of
    squares, min, max, predicted sum and responders' sum; alpha* (unless
    given) and every statistic then come from that table of <= N + 1 rows."""
    b = first_mailed_index(F.col(crit_col), n_grid)
    never = F.lit(n_grid)
    k = F.when(b.isNull() | (b > n_grid - 1), never).otherwise(b)
    net = _net(F.col(amount_col), unit_cost)
    pnet = F.col(pred_amount_col) - F.lit(unit_cost)
    stats = df.select(k.alias("k"), net.alias("net"), pnet.alias("pnet"),
                      (F.col(amount_col) > 0).alias("resp")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("net").alias("s"),
        F.sum(from_cents(F.col("net")) * from_cents(F.col("net"))).alias("ss"),
        F.min("net").alias("mn"),
        F.max("net").alias("mx"),
        F.sum("pnet").alias("ps"),
        F.sum(F.when(F.col("resp"), F.col("net"))).alias("rs"),
    )
    mailed_rows = F.col("k") < n_grid
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy()
    t = stats.withColumn("_cum", F.when(mailed_rows, F.sum(F.when(mailed_rows, F.col("s"))).over(w)))
    if kstar is None:
        best = F.max(F.when(mailed_rows, F.struct(F.col("_cum"), (-F.col("k")).alias("nk")))).over(allw)
        nobody = F.struct(F.lit(0).cast("long").alias("_cum"), F.lit(0).cast("long").alias("nk"))  # alpha 0: profit 0
        t = t.withColumn("_kstar", -F.greatest(best, nobody)["nk"])
    else:
        t = t.withColumn("_kstar", F.lit(kstar).cast("long"))
    sel = mailed_rows & (F.col("k") <= F.col("_kstar"))
    agg = t.agg(
        F.max("_kstar").alias("k"),
        F.sum(F.when(sel, F.col("n"))).alias("n_mailed"),
        F.sum(F.when(sel, F.col("s"))).alias("_s"),
        F.sum(F.when(sel, F.col("ss"))).alias("_ss"),
        from_cents(F.min(F.when(sel, F.col("mn")))).alias("min_profit"),
        from_cents(F.max(F.when(sel, F.col("mx")))).alias("max_member_profit"),
        F.sum("rs").alias("_mx"),
        F.sum(F.when(sel, F.col("ps"))).alias("_pred"),
    )
    n = F.col("n_mailed")
    s = from_cents(F.col("_s"))
    var = F.try_divide(F.col("_ss") - s * s / n, n - 1)  # one member mailed: no deviation
    return agg.select(
        F.col("k").cast("long").alias("k"),
        (F.col("k") / F.lit(n_grid - 1)).alias("alpha"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_mailed"),
        F.coalesce(s, F.lit(0.0)).alias("profit"),
        "min_profit",
        F.round(s / n, 4).alias("mean_profit"),
        F.when(var.isNotNull(), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 2)).alias("std_profit"),
        "max_member_profit",
        from_cents(F.col("_mx")).alias("max_profit"),
        F.round(F.try_divide(F.coalesce(s, F.lit(0.0)), from_cents(F.col("_mx"))) * 100, 4).alias("pct_of_max"),
        F.round(F.coalesce("_pred", F.lit(0.0)), 2).alias("predicted_profit"),
    )


def predicted_amounts(
    df: DataFrame, crit_col: str, pred_amount_col: str, kstar: int, n_grid: int = DEFAULT_GRID
) -> DataFrame:
    """Smallest, median and largest predicted amount of the mailed.
    The median is exact and distributed (no group goes to one task)."""
    m = df.where(mailed_at(crit_col, kstar, n_grid)).select(
        F.lit(1).alias("_g"), F.col(pred_amount_col).alias("v")
    )
    q = exact_quantiles(m, "v", [0.0, 0.5, 1.0], group_cols=["_g"])
    return q.select(
        F.round("q0", 2).alias("min_amount"),
        F.round("q1", 2).alias("median_amount"),
        F.round("q2", 2).alias("max_amount"),
    )


def cup_measure(df: DataFrame, pred_amount_col: str, amount_col: str, unit_cost: float) -> DataFrame:
    """Sum of (actual - U) over members whose predicted amount exceeds
    U, rounded to tens of dollars, with the mailed count."""
    sel = F.col(pred_amount_col) > F.lit(unit_cost)
    net = _net(F.col(amount_col), unit_cost)
    return df.agg(
        F.count(F.when(sel, 1)).alias("n_mailed"),
        from_cents(F.sum(F.when(sel, net))).alias("net"),
    ).select("n_mailed", "net", F.round(F.col("net"), -1).alias("cup_measure"))

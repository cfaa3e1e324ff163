"""Column profiling in one pass over many columns.

The reference loops over columns in Python and calls ``value_counts`` per
column.  Here the table is unpivoted once to (column, value) and all
statistics come from grouped aggregations keyed by column.  No statistic
needs one column's values in one task: the top-2 counts come from two
small aggregations over the (column, value, count) table, quantiles from
the distributed exact-quantile helper.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlift.operators.ordering import exact_quantiles

# C12 defaults, as in the reference (caret's nearZeroVar rule)
FREQ_CUT = 95 / 5
UNIQUE_CUT = 0.1
SPARSE_CUT = 0.1


def long_values(df: DataFrame, cols: Sequence[str], as_type: str = "string") -> DataFrame:
    """Unpivot ``cols`` to (column, value) with one value type."""
    return df.select(*[F.col(c).cast(as_type).alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value"
    )


def value_counts(df: DataFrame, cols: Sequence[str], keep_null: bool = False) -> DataFrame:
    """(column, value, cnt); map-side partial counts.  With ``keep_null``
    the missing values form one more (column, null) group."""
    lv = long_values(df, cols)
    if not keep_null:
        lv = lv.where(F.col("value").isNotNull())
    return lv.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))


INTEGERS = ("byte", "short", "integer", "long")


def typed_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, cnt) with nulls.  Each family of types is counted in
    its own type, so that equal values are equal and others are not: integers
    as longs, floats as doubles, decimals and the rest as text.  The value is
    rendered as text only for the (far fewer) distinct ones."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    whole = [c for c in cols if types[c] in INTEGERS]
    real = [c for c in cols if types[c] in ("float", "double")]
    parts = []
    for names, as_type in ((whole, "long"), (real, "double"), ([c for c in cols if c not in whole + real], "string")):
        if names:
            counted = long_values(df, names, as_type).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
            parts.append(counted.select("feature", F.col("value").cast("string").alias("value"), "cnt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1 + A2: per column: rows, non-null, distinct, top-1 and top-2
    counts, their ratio and the share of distinct values."""
    vc = typed_value_counts(df, cols)
    nn = F.col("value").isNotNull()
    s1 = vc.groupBy("feature").agg(
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(nn, F.col("cnt")).otherwise(0)).alias("n_nonnull"),
        F.count("value").alias("n_distinct"),
        F.max(F.when(nn, F.col("cnt"))).alias("top1"),
    )
    # second largest count: top1 again if two values share it
    s2 = (
        vc.where(nn)
        .join(F.broadcast(s1.select("feature", "top1")), "feature")
        .groupBy("feature")
        .agg(
            F.count_if(F.col("cnt") == F.col("top1")).alias("_ties"),
            F.max(F.when(F.col("cnt") < F.col("top1"), F.col("cnt"))).alias("_below"),
        )
    )
    out = s1.join(s2, "feature", "left").withColumn(
        "top2",
        F.when(F.col("_ties") >= 2, F.col("top1")).otherwise(F.col("_below")),
    )
    return out.select(
        "feature",
        "n_rows",
        "n_nonnull",
        "n_distinct",
        "top1",
        "top2",
        F.round(F.col("top1") / F.col("top2"), 4).alias("freq_ratio"),
        F.round(F.col("n_distinct") / F.col("n_rows"), 6).alias("unique_share"),
        F.round(F.col("n_nonnull") / F.col("n_rows"), 6).alias("nonnull_share"),
    )


def near_zero_report(
    profile: DataFrame,
    freq_cut: float = FREQ_CUT,
    unique_cut: float = UNIQUE_CUT,
    sparse_cut: float = SPARSE_CUT,
    override: Sequence[str] = (),
    near_zero: bool = True,
    keep_single_level: bool = False,
) -> DataFrame:
    """Decisions per column from a ``column_profile`` table.

    zero variance: at most one distinct value; near zero: distinct share
    below ``unique_cut`` and top1/top2 above ``freq_cut``; sparse: non-null
    share at most ``sparse_cut``.  ``override`` columns are always kept.
    With ``keep_single_level`` one valid level next to missing values is not
    zero variance (the missing values make it a flag)."""
    zero = F.col("n_distinct") <= 1
    if keep_single_level:
        zero = (F.col("n_distinct") == 0) | ((F.col("n_distinct") == 1) & (F.col("n_nonnull") == F.col("n_rows")))
    nz = zero | (
        (F.col("n_distinct") / F.col("n_rows") < unique_cut)
        & (F.col("top1") / F.col("top2") > freq_cut)
    )
    sparse = F.col("n_nonnull") / F.col("n_rows") <= sparse_cut
    keep = F.col("feature").isin(list(override)) if override else F.lit(False)
    drop = (nz if near_zero else zero) | sparse
    return profile.select(
        "feature",
        zero.alias("zero_var"),
        F.coalesce(nz, F.lit(False)).alias("near_zero_var"),
        sparse.alias("sparse"),
        (F.coalesce(drop, F.lit(False)) & ~keep).alias("dropped"),
    )


def drop_by_report(df: DataFrame, report: DataFrame) -> DataFrame:
    """Apply C12: the decision table has one row per column, so its
    dropped names reach the driver as a bounded list."""
    names = [r["feature"] for r in report.where("dropped").select("feature").collect()]
    return df.drop(*names)


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2: missing count and share per column, ranked most-missing first."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(F.col(c).isNull()).alias(c) for c in cols
    ]
    wide = df.agg(*aggs)
    long = wide.unpivot(["_n"], list(cols), "feature", "n_missing")
    w = Window.orderBy(F.col("n_missing").desc(), F.col("feature").asc())
    return long.select(
        "feature",
        "n_missing",
        F.round(F.col("n_missing") / F.col("_n"), 4).alias("missing_share"),
        F.row_number().over(w).alias("rank"),
    )


def skewness_report(df: DataFrame, cols: Sequence[str], top: int = 6) -> DataFrame:
    """A9 + K4: adjusted Fisher-Pearson skewness G1 per column, whether it is
    beyond twice its standard error under normality, and rank flags for
    the ``top`` most and least skewed columns."""
    lv = long_values(df, cols, "double").where(F.col("value").isNotNull())
    g = lv.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.skewness("value").alias("g1")
    )
    n = F.col("n").cast("double")  # n^3 passes a long at some two million rows
    big_g = F.try_divide(F.col("g1") * F.sqrt(n * (n - 1)), n - 2)
    ses = F.sqrt(F.try_divide(6 * n * (n - 1), (n - 2) * (n + 1) * (n + 3)))
    g = g.select("feature", "n", F.round(big_g, 4).alias("skewness"), ses.alias("_ses"))
    w_hi = Window.orderBy(F.col("skewness").desc(), F.col("feature").asc())
    w_lo = Window.orderBy(F.col("skewness").asc(), F.col("feature").asc())
    return g.select(
        "feature",
        "n",
        "skewness",
        (F.abs(F.col("skewness")) > 2 * F.col("_ses")).alias("significant"),
        (F.row_number().over(w_hi) <= top).alias("most_skewed"),
        (F.row_number().over(w_lo) <= top).alias("least_skewed"),
    )


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: Pearson correlation of every pair of columns, over the rows where
    both are known, from one sum of matrices (long form, a before b); null for
    constant columns and fewer than two rows."""
    import numpy as np
    import pandas as pd

    from donorlift.operators.gram import correlation_matrix

    _, r = correlation_matrix(df, cols)
    i, j = np.triu_indices(len(cols), 1)
    names = np.array(cols, object)
    long = pd.DataFrame({"col_a": names[i], "col_b": names[j], "corr": r[i, j]})
    out = df.sparkSession.createDataFrame(long, "col_a string, col_b string, corr double")
    return out.select("col_a", "col_b", F.round(F.when(~F.isnan("corr"), F.col("corr")), 4).alias("corr"))


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation),
    max per column; quartiles exact and distributed."""
    # moments and extremes: one wide aggregation over the original rows
    # (no C-fold expansion), turned into one row per column
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    basic = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("count"),
                 F.round(F.col(f"m{i}"), 4).alias("mean"), F.round(F.col(f"s{i}"), 4).alias("std"),
                 F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)
    ])).alias("r")).select("r.*")
    # exact quartiles need the values in order: unpivot only for them
    lv = long_values(df, cols, "double").where(F.col("value").isNotNull())
    q = exact_quantiles(lv, "value", [0.25, 0.5, 0.75], group_cols=["feature"])
    q = q.select(
        "feature",
        F.round("q0", 4).alias("q25"),
        F.round("q1", 4).alias("q50"),
        F.round("q2", 4).alias("q75"),
    )
    return basic.join(q, "feature")


def describe_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A6 for strings: count, distinct, top (ties: smallest value), freq."""
    vc = value_counts(df, cols)
    s = vc.groupBy("feature").agg(
        F.sum("cnt").alias("count"),
        F.count(F.lit(1)).alias("distinct"),
        F.max("cnt").alias("freq"),
    )
    top = (
        vc.join(F.broadcast(s.select("feature", "freq")), "feature")
        .where(F.col("cnt") == F.col("freq"))
        .groupBy("feature")
        .agg(F.min("value").alias("top"))
    )
    return s.join(top, "feature").select("feature", "count", "distinct", "top", "freq")


def skew_standard_error(n: int) -> float:
    return math.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3)))

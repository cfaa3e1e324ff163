"""Encoders and imputers learned once and applied unchanged (E1, E6-E9,
I1-I3).

Learned state is small and bounded: level tables (one row per level),
per-column medians or modes (one value per column).  Applying it is a
projection or a broadcast join against that small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlift.functions import codes as fx
from donorlift.operators.clean import apply_levels, fit_levels
from donorlift.operators.ordering import exact_quantiles
from donorlift.operators.profile import long_values

# One-hot encoding emits one column per level; above this many levels the
# binary encoder is the right tool (the reference's rule is > 10 levels).
ONE_HOT_MAX_LEVELS = 10
ONE_HOT_HARD_LIMIT = 1000
# Rows of a coordinate table that is broadcast (about 40 bytes each).
COORDS_BROADCAST_ROWS = 200_000


def n_bits(n_codes: int) -> int:
    """Bits needed for codes 0..n_codes (Q16: ceil(log2(L + 1)) and the
    missing code L + 1 included)."""
    return max(1, int(n_codes).bit_length())


def binary_encode(df: DataFrame, col: str, levels: DataFrame, n_levels: int) -> DataFrame:
    """Level -> ordinal code 1..L (missing gets L + 1, unseen 0) ->
    base-2 digits in columns ``<col>_0`` (most significant) .. ``<col>_{b-1}``."""
    coded = apply_levels(df, col, levels, "_code")
    code = F.when(F.col(col).isNull(), F.lit(n_levels + 1)).otherwise(F.coalesce("_code", F.lit(0)))
    bits = n_bits(n_levels + 1)
    cols = [
        F.shiftright(code, bits - 1 - k).bitwiseAND(F.lit(1)).cast("int").alias(f"{col}_{k}")
        for k in range(bits)
    ]
    keep = [c for c in df.columns]
    return coded.select(*keep, *cols)


def fit_one_hot(df: DataFrame, col: str, max_levels: int = ONE_HOT_HARD_LIMIT) -> list[str]:
    """Learn the levels of a low-cardinality column.  The list is
    bounded: more than ``max_levels`` levels is an error (use E6)."""
    lv = df.where(F.col(col).isNotNull()).select(col).distinct().limit(max_levels + 1)
    levels = sorted(r[0] for r in lv.collect())
    if len(levels) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels; use binary_encode")
    return levels


def one_hot(df: DataFrame, col: str, levels: Sequence[str], missing_indicator: bool = True) -> DataFrame:
    """One 0/1 column per learned level, named ``<col>_<level>``,
    plus ``<col>_nan`` for missing values; unseen levels give all zeros."""
    c = F.col(col)
    cols = [F.coalesce(c == F.lit(lv), F.lit(False)).cast("int").alias(f"{col}_{lv}") for lv in levels]
    if missing_indicator:
        cols.append(c.isNull().cast("int").alias(f"{col}_nan"))
    return df.select(*[x for x in df.columns], *cols)


def encode_nominals(df: DataFrame, cols: Sequence[str], max_levels: int = ONE_HOT_MAX_LEVELS) -> DataFrame:
    """One-hot for columns with at most ``max_levels`` levels, binary code
    for the others.  Levels are counted exactly, in one aggregation."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    for c in cols:
        if counts[c] <= max_levels:
            df = one_hot(df, c, fit_one_hot(df, c, max_levels))
        else:
            df = binary_encode(df, c, fit_levels(df, c), counts[c])
    return df


def hash_bucket(value: Column, n: int) -> Column:
    """md5 of the text; int(hexdigest, 16) mod n, for any n below 2^31:
    eight hex digits at a time, from the front (Horner's rule mod n)."""
    digest = F.md5(value.cast("string"))
    rest = F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        rest = (rest * F.lit(1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % n
    return rest.cast("int")


def hash_encode(df: DataFrame, cols: Sequence[str], n: int = 8, key: str | None = None) -> DataFrame:
    """Hashing trick over several nominal columns into ``n`` count
    columns ``col_0`` .. ``col_{n-1}``."""
    buckets = [hash_bucket(F.col(c), n) for c in cols]
    outs = []
    for k in range(n):
        expr = sum((F.when(b == k, 1).otherwise(0) for b in buckets), F.lit(0))
        outs.append(expr.cast("int").alias(f"col_{k}"))
    lead = [key] if key else list(df.columns)
    return df.select(*lead, *outs)


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """I1 fit: exact median per column (distributed); one number per column
    reaches the driver."""
    lv = long_values(df, cols, "double").where(F.col("value").isNotNull())
    q = exact_quantiles(lv, "value", [0.5], group_cols=["feature"])
    return {r["feature"]: r["q0"] for r in q.collect()}


def impute(df: DataFrame, fills: Mapping[str, object], as_type: str | None = "double") -> DataFrame:
    """I1/I2 apply: fill missing values with learned constants, one select."""
    out = []
    for c in df.columns:
        if c in fills:
            v = F.col(c).cast(as_type) if as_type else F.col(c)
            out.append(F.coalesce(v, F.lit(fills[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """I2/A4 fit: most frequent value per column; ties -> smallest value."""
    lv = long_values(df, cols).where(F.col("value").isNotNull())
    vc = lv.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top =vc.groupBy("feature").agg(F.max("cnt").alias("m"))
    pick = (
        vc.join(F.broadcast(top), "feature")
        .where(F.col("cnt") == F.col("m"))
        .groupBy("feature")
        .agg(F.min("value").alias("mode"))
    )
    return {r["feature"]: r["mode"] for r in pick.collect()}


def coords_lookup(
    df: DataFrame,
    key_col: str,
    state_col: str,
    table: DataFrame,
    military_states: Sequence[str],
    military_point: tuple[float, float] = fx.MILITARY_POINT,
) -> DataFrame:
    """Key -> (latitude, longitude) from a lookup table; a miss for a
    military state gets the fixed point, any other miss (0, 0); a missing
    key stays missing.  The table is joined by broadcast if it has at most
    COORDS_BROADCAST_ROWS rows, by a shuffle otherwise."""
    t = table.select(
        F.col("key").alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")
    )
    small = t.limit(COORDS_BROADCAST_ROWS + 1).count() <= COORDS_BROADCAST_ROWS
    j = df.join(F.broadcast(t) if small else t, df[key_col] == t["_k"], "left")
    hit = F.col("_k").isNotNull()
    mil = F.col(state_col).isin(list(military_states))
    lat = (
        F.when(F.col(key_col).isNull(), F.lit(None).cast("double"))
        .when(hit, F.col("_lat"))
        .when(mil, F.lit(military_point[0]))
        .otherwise(F.lit(0.0))
    )
    lon = (
        F.when(F.col(key_col).isNull(), F.lit(None).cast("double"))
        .when(hit, F.col("_lon"))
        .when(mil, F.lit(military_point[1]))
        .otherwise(F.lit(0.0))
    )
    return j.select(*df.columns, lat.alias("latitude"), lon.alias("longitude"))


__all__ = [
    "apply_levels", "fit_levels", "binary_encode", "fit_one_hot", "one_hot", "hash_bucket",
    "hash_encode", "fit_medians", "impute", "fit_modes", "coords_lookup", "n_bits",
]

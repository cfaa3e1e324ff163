"""Cleaning stage (C1-C14, P1-P11) as one wide projection.

The reference applies its cleaning steps column group by column group with
row-at-a-time Python; here a ``CleanSpec`` names the column groups and
``clean_select`` emits a single ``select`` of built-in expressions, so the
whole stage is one narrow, codegen'd pass with no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlift.functions import codes as fx

# Learned level tables up to this size are broadcast (the table grows with
# the number of distinct levels, never with the number of rows).
BROADCAST_LEVELS_MAX = 100_000


@dataclass
class CleanSpec:
    key: str
    dates: Sequence[str] = ()                 # C1 + E5 parse
    ref_year: int = 1997
    zips: Sequence[str] = ()                  # C2
    noexch: Sequence[str] = ()                # C3 then C7 with 1/0
    x_to_null: Sequence[str] = ()             # C4
    rfa: Sequence[str] = ()                   # C5 + C8 (R, F, A) + C9 on A
    flags: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # C7 (true, false)
    splits: Mapping[str, Sequence[str]] = field(default_factory=dict)   # C8 name -> suffixes
    ordinal_maps: Mapping[str, Mapping[str, int]] = field(default_factory=dict)  # C9
    drop: Sequence[str] = ()                  # C13 / P1
    keep_raw: bool = False


def clean_select(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """All cleaning steps of ``spec`` in one projection."""
    out: list[Column] = [F.col(spec.key)]
    handled = {spec.key}
    for c in spec.dates:
        fixed = fx.fix_short_date(F.col(c))
        out.append(fixed.alias(f"{c}_fixed"))
        out.append(fx.parse_yymm(fixed, spec.ref_year).alias(c))
        handled.add(c)
    for c in spec.zips:
        out.append(fx.clean_zip(F.col(c)).alias(c))
        handled.add(c)
    for c in spec.noexch:
        out.append(fx.recode_binary(fx.replace_x_with_1(F.col(c)), "1", "0").alias(c))
        handled.add(c)
    for c in spec.x_to_null:
        out.append(fx.null_if_x(F.col(c)).alias(f"{c}_clean"))
    for c, (t, f) in spec.flags.items():
        out.append(fx.recode_binary(F.col(c), t, f).alias(f"{c}_bin"))
    for c in spec.rfa:
        v = fx.valid_length(F.col(c), 3)
        out.append(v.alias(f"{c}_valid"))
        out.append(fx.byte_at(F.col(c), 3, 1).alias(f"{c}R"))
        out.append(fx.byte_at(F.col(c), 3, 2).try_cast("int").alias(f"{c}F"))
        out.append(fx.map_codes(fx.byte_at(F.col(c), 3, 3), fx.RFA_AMOUNT_ORDER).alias(f"{c}A"))
    for c, suffixes in spec.splits.items():
        n = len(suffixes)
        for i, s in enumerate(suffixes, start=1):
            out.append(fx.byte_at(F.col(c), n, i).alias(f"{c}{s}"))
    for c, m in spec.ordinal_maps.items():
        out.append(fx.map_codes(F.col(c), m).alias(f"{c}_ord"))
    if spec.keep_raw:
        out.extend(F.col(c).alias(f"{c}_raw") for c in df.columns if c not in handled)
    res = df.select(*out)
    return res.drop(*spec.drop)


def malformed_report(
    df: DataFrame,
    lengths: Mapping[str, int],
    trailing_dash: Sequence[str] = (),
) -> DataFrame:
    """P10: counts of malformed values for many columns in one aggregation:
    wrong length (dates 4, RFA 3) and trailing '-' (ZIP)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c, n in lengths.items():
        aggs.append(F.count_if(F.length(c) != n).alias(f"{c}_bad_length"))
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}_missing"))
    for c in trailing_dash:
        aggs.append(F.count_if(F.col(c).endswith("-")).alias(f"{c}_trailing_dash"))
    return df.agg(*aggs)


def fit_levels(df: DataFrame, col: str, order: str = "alphabetAsc") -> DataFrame:
    """Learn the levels of a nominal column once.

    Output (level, code) with code 1..L in natural (ascending) order, or by
    descending frequency (ties by level) with ``order='frequencyDesc'``.
    The distinct step is a partial + final aggregation; the levels are then
    numbered by exact distributed positions."""
    from donorlift.operators.ordering import with_positions

    lv = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(
        F.count(F.lit(1)).alias("freq")
    )
    spec = [("freq", False), ("level", True)] if order == "frequencyDesc" else [("level", True)]
    # distributed numbering: a nominal with very many levels is not ordered in one task
    return with_positions(lv, spec, pos_col="code").select("level", F.col("code").cast("int").alias("code"))


def apply_levels(
    df: DataFrame, col: str, levels: DataFrame, out_col: str, unknown: int | None = None
) -> DataFrame:
    """Attach the learned code of ``col``; unseen or missing levels get
    ``unknown`` (null by default).  Small level tables are broadcast."""
    n = levels.count()
    lv = levels.withColumnRenamed("code", out_col)
    if n <= BROADCAST_LEVELS_MAX:
        lv = F.broadcast(lv)
    j = df.join(lv, df[col].eqNullSafe(lv["level"]), "left").drop("level")
    if unknown is not None:
        j = j.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(unknown)))
    return j

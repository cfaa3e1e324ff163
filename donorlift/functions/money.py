"""Exact money arithmetic.

Amounts carry two decimals.  Sums run in integer cents (exact, and a
fixed-width LONG aggregation buffer keeps Spark on the fast hash-aggregate
path, unlike a wide DECIMAL buffer); a mean rounded to cents uses half-up
integer division, so results are exact decimal answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def cents(c: Column) -> Column:
    """Amount in integer cents (exact for two-decimal amounts)."""
    return (c.cast(MONEY) * 100).cast("long")


def from_cents(c: Column) -> Column:
    """Integer cents back to an amount; the same (correctly rounded) double
    as casting the exact decimal."""
    return c.cast("double") / F.lit(100.0)


def cents_lit(amount: float) -> Column:
    return F.lit(int(round(amount * 100))).cast("long")


def mean_from_cents(sum_cents: str, n: str, decimals: int = 2) -> Column:
    """Mean of amounts, rounded half away from zero to ``decimals`` (>= 2),
    from the names of a cents-sum column and a count column."""
    scale = 10 ** (decimals - 2)
    return F.expr(
        f"CAST(signum({sum_cents}) * ((2 * abs({sum_cents}) * {scale} + {n}) div (2 * {n})) "
        f"/ {10 ** decimals} AS DOUBLE)"
    )


def sql_mean_from_cents(sum_cents: str, n: str, decimals: int = 2) -> str:
    """DuckDB text of the same rule, for the oracle."""
    scale = 10 ** (decimals - 2)
    return (
        f"CAST(sign({sum_cents}) * ((2 * abs({sum_cents}) * {scale} + {n}) // (2 * {n})) "
        f"/ {10 ** decimals} AS DOUBLE)"
    )


def sql_cents(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS BIGINT)"

"""Column-expression helpers for noisy codes, flags and two-digit dates.

All of them are built-in Spark expressions (whole-stage codegen, no Python
per row).  Fixed values that must equal the reference's are listed together
below.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's) ------------------------------
# Two-digit years: 69..99 -> 19yy, 00..68 -> 20yy (Python's %y pivot), then
# one century back when the year is later than the reference year.
YY_PIVOT = 69
# Ordinal maps of the cleaning stage.
MDMAUD_R_ORDER = {"D": 1, "I": 2, "L": 3, "C": 4}
MDMAUD_A_ORDER = {"L": 1, "C": 2, "M": 3, "T": 4}
RFA_AMOUNT_ORDER = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}
SES_ORDER = {"1": 1, "2": 2, "3": 2, "4": 3}
URBAN_SES = {"1": 1, "2": 2, "3": 2, "4": 3}
# Military ZIPs without a table entry get this fixed point (the longitude is
# west, so negative; a positive sign would place it in Asia).
MILITARY_STATES = ["AA", "AE", "AP"]
MILITARY_POINT = (38.8719, -77.0563)
# -----------------------------------------------------------------------------

# 'yyM' or 'yyMM' with a valid month, as Python's strptime("%y%m") accepts
YYMM_PATTERN = r"^([0-9]{2})(1[0-2]|0[1-9]|[1-9])$"


def fix_short_date(c: Column) -> Column:
    """A 3-character date lost its leading zero; put it back."""
    return F.when(F.length(c) == 3, F.concat(F.lit("0"), c)).otherwise(c)


def parse_yymm(c: Column, ref_year: int) -> Column:
    """E5: 'yyMM' -> first day of that month, with the two-digit-year pivot
    and the century rule; anything malformed -> null."""
    ok = c.rlike(YYMM_PATTERN)
    yy = F.regexp_extract(c, YYMM_PATTERN, 1).cast("int")
    mm = F.regexp_extract(c, YYMM_PATTERN, 2).cast("int")
    year = F.when(yy >= YY_PIVOT, yy + 1900).otherwise(yy + 2000)
    year = F.when(year > ref_year, year - 100).otherwise(year)
    return F.when(ok, F.make_date(year, mm, F.lit(1)))


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def months_between_whole(later: Column, earlier: Column) -> Column:
    """Whole months between two month-precision dates (relativedelta on
    first-of-month dates): (y1 - y2) * 12 + (m1 - m2)."""
    return month_index(later) - month_index(earlier)


def whole_years(months: Column) -> Column:
    """Months -> whole years, truncated toward zero."""
    return F.when(months >= 0, F.floor(months / 12)).otherwise(F.ceil(months / 12)).cast("int")


def clean_zip(c: Column) -> Column:
    """Drop '-', blank or '.' -> null, to integer (null stays null)."""
    s = F.trim(F.replace(c, F.lit("-"), F.lit("")))
    return F.when((s == "") | (s == "."), F.lit(None).cast("int")).otherwise(s.try_cast("int"))


def recode_binary(c: Column, true_code: str, false_code: str) -> Column:
    """(true, '1') -> 1; (false, '0') -> 0; anything else -> null."""
    return (
        F.when(c.isin(true_code, "1"), 1)
        .when(c.isin(false_code, "0"), 0)
        .cast("int")
    )


def recode_binary_noisy(c: Column, true_code: str, false_code: str, fixes: dict[str, int | None] | None = None) -> Column:
    """C7b (documented meaning): as C7, but blank and missing count as false;
    ``fixes`` maps further codes to 1, 0 or null and goes before both."""
    if fixes:
        expr = recode_binary_noisy(c, true_code, false_code)
        for code, value in fixes.items():
            expr = F.when(c == code, F.lit(value).cast("int")).otherwise(expr)
        return expr
    return F.coalesce(
        F.when(c.isin(true_code, "1"), 1).when(c.isin(false_code, "0", "", " "), 0),
        F.lit(0),
    ).cast("int")


def replace_x_with_1(c: Column) -> Column:
    """NOEXCH stores 'X' where '1' is meant."""
    return F.replace(c, F.lit("X"), F.lit("1"))


def null_if_x(c: Column) -> Column:
    """C4: a whole value 'X' is missing."""
    return F.nullif(c, F.lit("X"))


def valid_length(c: Column, n: int) -> Column:
    """Keep only values of length n."""
    return F.when(F.length(c) == n, c)


def byte_at(c: Column, n: int, i: int) -> Column:
    """The i-th (1-based) character of an n-character code; a code of
    any other length gives null in every position."""
    return F.when(F.length(c) == n, F.substring(c, i, 1))


def map_codes(c: Column, mapping: Mapping[str, int]) -> Column:
    """Ordinal recode by a fixed map; unknown or missing -> null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def urban_ses(urbanicity: Column, ses: Column) -> Column:
    """C11: socio-economic status has four levels only for urban places;
    merge them to three there, keep the code elsewhere."""
    return F.when(urbanicity == "U", map_codes(ses, URBAN_SES)).otherwise(ses.try_cast("int"))


def repair_amount(amount: Column, date: Column) -> Column:
    """No amount and no date means no gift (0); an amount missing
    next to a date is really missing (null)."""
    return F.when(amount.isNull() & date.isNull(), F.lit(0.0)).otherwise(amount)

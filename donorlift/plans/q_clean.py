"""Cleaning queries on the noisy member file."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorlift.functions import codes as fx
from donorlift.operators import clean as cl
from donorlift.plans.oracle_views import with_views
from donorlift.plans.registry import register
from donorlift.sources import standin as si

REF_YEAR = si.REF.year
PAT = fx.YYMM_PATTERN


def sql_fix_date(c: str) -> str:
    return f"(CASE WHEN length({c}) = 3 THEN '0' || {c} ELSE {c} END)"


def sql_parse_yymm(c: str, ref_year: int) -> str:
    yy = f"CAST(regexp_extract({c}, '{PAT}', 1) AS INTEGER)"
    mm = f"CAST(regexp_extract({c}, '{PAT}', 2) AS INTEGER)"
    y = f"(CASE WHEN {yy} >= 69 THEN {yy} + 1900 ELSE {yy} + 2000 END)"
    y2 = f"(CASE WHEN {y} > {ref_year} THEN {y} - 100 ELSE {y} END)"
    return f"(CASE WHEN regexp_matches({c}, '{PAT}') THEN make_date({y2}, {mm}, 1) END)"


def _raw(spark, sf_dir):
    return si.raw_members(si.Tables(spark, sf_dir))


@register(
    "clean_dates",
    with_views(
        ["raw_members"],
        f"""
SELECT member_id, odate AS odate_raw, {sql_fix_date('odate')} AS odate_fixed,
       {sql_parse_yymm(sql_fix_date('odate'), REF_YEAR)} AS odate
FROM raw_members""",
    ),
    ids="C1 E5",
)
def q_clean_dates(spark, sf_dir):
    r = _raw(spark, sf_dir).withColumn("odate_raw", F.col("odate"))
    spec = cl.CleanSpec(key="member_id", dates=["odate"], ref_year=REF_YEAR, keep_raw=True)
    return cl.clean_select(r.select("member_id", "odate", "odate_raw"), spec).withColumnRenamed(
        "odate_raw_raw", "odate_raw"
    )


@register(
    "clean_zip",
    with_views(
        ["raw_members"],
        """
SELECT member_id, zip AS zip_raw,
  CASE WHEN trim(replace(zip, '-', '')) IN ('', '.') THEN NULL
       ELSE TRY_CAST(trim(replace(zip, '-', '')) AS INTEGER) END AS zip
FROM raw_members""",
    ),
    ids="C2 P10",
)
def q_clean_zip(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return r.select("member_id", F.col("zip").alias("zip_raw"), fx.clean_zip(F.col("zip")).alias("zip"))


@register(
    "clean_flags",
    with_views(
        ["raw_members"],
        """
SELECT member_id, flag AS flag_raw,
  CAST(CASE WHEN flag IN ('X', '1') THEN 1 WHEN flag IN (' ', '0') THEN 0 END AS INTEGER) AS flag_bin,
  CAST(CASE WHEN replace(flag, 'X', '1') IN ('1') THEN 1
            WHEN replace(flag, 'X', '1') IN ('0') THEN 0 END AS INTEGER) AS noexch,
  nullif(flag, 'X') AS flag_clean,
  CAST(COALESCE(CASE WHEN flag IN ('X', '1') THEN 1 WHEN flag IN (' ', '0', '') THEN 0 END, 0)
       AS INTEGER) AS flag_noisy
FROM raw_members""",
    ),
    ids="C3 C4 C7 C7b",
)
def q_clean_flags(spark, sf_dir):
    r = _raw(spark, sf_dir)
    f = F.col("flag")
    return r.select(
        "member_id",
        f.alias("flag_raw"),
        fx.recode_binary(f, "X", " ").alias("flag_bin"),
        fx.recode_binary(fx.replace_x_with_1(f), "1", "0").alias("noexch"),
        fx.null_if_x(f).alias("flag_clean"),
        fx.recode_binary_noisy(f, "X", " ").alias("flag_noisy"),
    )


@register(
    "clean_rfa",
    with_views(
        ["raw_members"],
        """
SELECT member_id,
  CASE WHEN length(rfa) = 3 THEN rfa END AS rfa_valid,
  CASE WHEN length(rfa) = 3 THEN substr(rfa, 1, 1) END AS rfaR,
  TRY_CAST(CASE WHEN length(rfa) = 3 THEN substr(rfa, 2, 1) END AS INTEGER) AS rfaF,
  CASE CASE WHEN length(rfa) = 3 THEN substr(rfa, 3, 1) END
       WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4
       WHEN 'E' THEN 5 WHEN 'F' THEN 6 WHEN 'G' THEN 7 END AS rfaA
FROM raw_members""",
    ),
    ids="C5 C8 C9",
)
def q_clean_rfa(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return cl.clean_select(r, cl.CleanSpec(key="member_id", rfa=["rfa"]))


@register(
    "repair_amounts",
    with_views(
        ["history"],
        """
SELECT member_id, i, rdate,
  CASE WHEN ramnt IS NULL AND rdate IS NULL THEN 0.0 ELSE ramnt END AS ramnt
FROM history""",
    ),
    ids="C6",
)
def q_repair_amounts(spark, sf_dir):
    h = si.history(si.Tables(spark, sf_dir))
    return h.select(
        "member_id", "i", "rdate", fx.repair_amount(F.col("ramnt"), F.col("rdate")).alias("ramnt")
    )


@register(
    "split_codes",
    with_views(
        ["raw_members"],
        """
SELECT member_id,
  CASE WHEN length(domain) = 2 THEN substr(domain, 1, 1) END AS domainUrbanicity,
  CASE WHEN length(domain) = 2 THEN substr(domain, 2, 1) END AS domainSocioEconomic
FROM raw_members""",
    ),
    ids="C8",
)
def q_split_codes(spark, sf_dir):
    r = _raw(spark, sf_dir)
    spec = cl.CleanSpec(key="member_id", splits={"domain": ["Urbanicity", "SocioEconomic"]})
    return cl.clean_select(r, spec)


@register(
    "ordinal_codes",
    """
SELECT o_orderkey, o_orderpriority,
       CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) AS INTEGER) AS priority_code
FROM orders""",
    ids="C10",
)
def q_ordinal_codes(spark, sf_dir):
    o = si.Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority")
    levels = cl.fit_levels(o, "o_orderpriority")
    return cl.apply_levels(o, "o_orderpriority", levels, "priority_code")


@register(
    "urban_ses",
    with_views(
        ["raw_members"],
        """
SELECT member_id, u AS urbanicity, s AS ses_raw,
  CASE s WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 2 WHEN '4' THEN 3 END AS ses_ord,
  CASE WHEN u = 'U' THEN CASE s WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 2 WHEN '4' THEN 3 END
       ELSE TRY_CAST(s AS INTEGER) END AS ses_urban
FROM (SELECT member_id,
        CASE WHEN length(domain) = 2 THEN substr(domain, 1, 1) END AS u,
        CASE WHEN length(domain) = 2 THEN substr(domain, 2, 1) END AS s
      FROM raw_members)""",
    ),
    ids="C9 C11",
)
def q_urban_ses(spark, sf_dir):
    r = _raw(spark, sf_dir)
    u = fx.byte_at(F.col("domain"), 2, 1)
    s = fx.byte_at(F.col("domain"), 2, 2)
    return r.select(
        "member_id",
        u.alias("urbanicity"),
        s.alias("ses_raw"),
        fx.map_codes(s, fx.SES_ORDER).alias("ses_ord"),
        fx.urban_ses(u, s).alias("ses_urban"),
    )


@register(
    "malformed_report",
    with_views(
        ["raw_members"],
        """
SELECT COUNT(*) AS n_rows,
  COUNT(CASE WHEN length(odate) <> 4 THEN 1 END) AS odate_bad_length,
  COUNT(CASE WHEN odate IS NULL THEN 1 END) AS odate_missing,
  COUNT(CASE WHEN length(rfa) <> 3 THEN 1 END) AS rfa_bad_length,
  COUNT(CASE WHEN rfa IS NULL THEN 1 END) AS rfa_missing,
  COUNT(CASE WHEN ends_with(zip, '-') THEN 1 END) AS zip_trailing_dash
FROM raw_members""",
    ),
    ids="P10",
)
def q_malformed_report(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return cl.malformed_report(r, {"odate": 4, "rfa": 3}, ["zip"])

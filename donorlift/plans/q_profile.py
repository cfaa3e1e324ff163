"""Profiling queries."""

from __future__ import annotations

from donorlift.operators import profile as pf
from donorlift.plans.oracle_views import with_views
from donorlift.plans.registry import register
from donorlift.sources import standin as si

LINEITEM_ALL = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_NUM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
DESCRIBE_NUM = LINEITEM_NUM
CORR_COLS = LINEITEM_NUM
PART_STR = ["p_name", "p_brand", "p_type"]
CAMPAIGNS = list(range(si.FIRST_CAMPAIGN, si.LAST_CAMPAIGN + 1))
HIST_COLS = [f"{p}_{i}" for i in CAMPAIGNS for p in ("RDATE", "RAMNT")]


def _varchar_src(table: str, cols: list[str]) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols) + f" FROM {table}"


def _double_src(table: str, cols: list[str]) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + f" FROM {table}"


_PROFILE_CTES = [
    ("src", _varchar_src("lineitem", LINEITEM_ALL)),
    ("long", "SELECT * FROM src UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(*)))"),
    ("vc", "SELECT feature, value, COUNT(*) AS cnt FROM long GROUP BY feature, value"),
    ("s1", """
SELECT feature, CAST(SUM(cnt) AS BIGINT) AS n_rows,
       CAST(SUM(CASE WHEN value IS NOT NULL THEN cnt ELSE 0 END) AS BIGINT) AS n_nonnull,
       COUNT(value) AS n_distinct, MAX(CASE WHEN value IS NOT NULL THEN cnt END) AS top1
FROM vc GROUP BY feature"""),
    ("s2", """
SELECT v.feature, COUNT(CASE WHEN v.cnt = s1.top1 THEN 1 END) AS ties,
       MAX(CASE WHEN v.cnt < s1.top1 THEN v.cnt END) AS below
FROM vc v JOIN s1 ON v.feature = s1.feature WHERE v.value IS NOT NULL GROUP BY v.feature"""),
    ("prof", """
SELECT s1.feature, n_rows, n_nonnull, n_distinct, top1,
       CASE WHEN ties >= 2 THEN top1 ELSE below END AS top2
FROM s1 LEFT JOIN s2 ON s1.feature = s2.feature"""),
]


@register(
    "column_profile",
    with_views([], """
SELECT feature, n_rows, n_nonnull, n_distinct, top1, top2,
       round(top1 / top2, 4) AS freq_ratio, round(n_distinct / n_rows, 6) AS unique_share,
       round(n_nonnull / n_rows, 6) AS nonnull_share
FROM prof""", _PROFILE_CTES),
    ids="A1 A2 A7",
)
def q_column_profile(spark, sf_dir):
    li = si.Tables(spark, sf_dir).lineitem
    return pf.column_profile(li, LINEITEM_ALL)


@register(
    "near_zero_report",
    with_views([], """
SELECT feature, n_distinct <= 1 AS zero_var,
       COALESCE(n_distinct <= 1 OR (n_distinct / n_rows < 0.1 AND top1 / top2 > 19.0), false)
         AS near_zero_var,
       n_nonnull / n_rows <= 0.1 AS sparse,
       COALESCE(n_distinct <= 1 OR (n_distinct / n_rows < 0.1 AND top1 / top2 > 19.0)
                OR n_nonnull / n_rows <= 0.1, false) AS dropped
FROM prof""", _PROFILE_CTES),
    ids="C12 U2",
)
def q_near_zero_report(spark, sf_dir):
    li = si.Tables(spark, sf_dir).lineitem
    return pf.near_zero_report(pf.column_profile(li, LINEITEM_ALL))


def _wide_sql() -> str:
    parts = []
    for i in CAMPAIGNS:
        parts.append(f"MAX(CASE WHEN i = {i} THEN rdate END) AS RDATE_{i}")
        parts.append(f"MAX(CASE WHEN i = {i} THEN ramnt END) AS RAMNT_{i}")
    return "SELECT member_id, " + ", ".join(parts) + " FROM history GROUP BY member_id"


WIDE_SQL = _wide_sql()


@register(
    "missing_report",
    with_views(["history"], """
SELECT feature, n_missing, round(n_missing / n, 4) AS missing_share,
       CAST(ROW_NUMBER() OVER (ORDER BY n_missing DESC, feature ASC) AS INTEGER) AS rank
FROM (
  SELECT feature, CAST(SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
         COUNT(*) AS n
  FROM (SELECT * FROM (SELECT """ + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in HIST_COLS)
        + """ FROM wide) UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(*))))
  GROUP BY feature)""", [("wide", WIDE_SQL)]),
    ids="A2 E10",
)
def q_missing_report(spark, sf_dir):
    w = si.history_wide(si.Tables(spark, sf_dir))
    return pf.missing_report(w, HIST_COLS)


@register(
    "skewness_report",
    with_views([], """
SELECT feature, n, skewness,
       abs(skewness) > 2 * sqrt(6.0 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))) AS significant,
       ROW_NUMBER() OVER (ORDER BY skewness DESC, feature ASC) <= 6 AS most_skewed,
       ROW_NUMBER() OVER (ORDER BY skewness ASC, feature ASC) <= 6 AS least_skewed
FROM (SELECT feature, COUNT(value) AS n, round(skewness(value), 4) AS skewness
      FROM (UNPIVOT src ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature)""",
        [("src", _double_src("lineitem", LINEITEM_NUM))]),
    ids="A9 K4",
)
def q_skewness_report(spark, sf_dir):
    li = si.Tables(spark, sf_dir).lineitem
    return pf.skewness_report(li, LINEITEM_NUM, top=6)


def _corr_sql() -> str:
    rows = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS corr FROM lineitem")
    return "\nUNION ALL\n".join(rows)


@register("correlations", _corr_sql(), ids="A10")
def q_correlations(spark, sf_dir):
    li = si.Tables(spark, sf_dir).lineitem
    return pf.correlations(li, CORR_COLS)


@register(
    "describe_numeric",
    with_views([], """
SELECT feature, COUNT(value) AS count, round(avg(value), 4) AS mean,
       round(stddev_samp(value), 4) AS std, MIN(value) AS min, MAX(value) AS max,
       round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
       round(quantile_cont(value, 0.75), 4) AS q75
FROM (UNPIVOT src ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature""",
        [("src", _double_src("lineitem", DESCRIBE_NUM))]),
    ids="A6 A3",
)
def q_describe_numeric(spark, sf_dir):
    li = si.Tables(spark, sf_dir).lineitem
    return pf.describe_numeric(li, DESCRIBE_NUM)


@register(
    "describe_strings",
    with_views([], """
SELECT s.feature, s.count, s.distinct, t.top, s.freq
FROM (SELECT feature, CAST(SUM(cnt) AS BIGINT) AS count, COUNT(*) AS distinct, MAX(cnt) AS freq
      FROM vc GROUP BY feature) s
JOIN (SELECT v.feature, MIN(v.value) AS top FROM vc v
      JOIN (SELECT feature, MAX(cnt) AS m FROM vc GROUP BY feature) x
        ON v.feature = x.feature AND v.cnt = x.m GROUP BY v.feature) t
  ON s.feature = t.feature""", [
        ("src", _varchar_src("part", PART_STR)),
        ("vc", "SELECT feature, value, COUNT(*) AS cnt FROM (UNPIVOT src ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature, value"),
    ]),
    ids="A6 A4",
)
def q_describe_strings(spark, sf_dir):
    p = si.Tables(spark, sf_dir).part
    return pf.describe_strings(p, PART_STR)

"""Encoding and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorlift.functions import codes as fx
from donorlift.operators import encode as en
from donorlift.operators import features as fe
from donorlift.operators.clean import fit_levels
from donorlift.plans.oracle_views import month_idx, with_views
from donorlift.plans.registry import register
from donorlift.session import ensure_checkpoint_dir
from donorlift.sources import standin as si

CAMPAIGNS = list(range(si.FIRST_CAMPAIGN, si.LAST_CAMPAIGN + 1))
MTD_COLS = [f"MTD_{i}" for i in CAMPAIGNS]
# Stand-in for the military states of the ZIP fall-back rule
STANDIN_MILITARY_REGIONS = ["MIDDLE EAST"]


def _t(spark, sf_dir):
    return si.Tables(spark, sf_dir)


@register(
    "binary_encode",
    """
SELECT p_partkey, p_brand,
  CAST((code >> 4) & 1 AS INTEGER) AS p_brand_0, CAST((code >> 3) & 1 AS INTEGER) AS p_brand_1,
  CAST((code >> 2) & 1 AS INTEGER) AS p_brand_2, CAST((code >> 1) & 1 AS INTEGER) AS p_brand_3,
  CAST(code & 1 AS INTEGER) AS p_brand_4
FROM (SELECT p_partkey, p_brand, CAST(DENSE_RANK() OVER (ORDER BY p_brand) AS INTEGER) AS code FROM part)""",
    ids="E6 E8",
)
def q_binary_encode(spark, sf_dir):
    p = _t(spark, sf_dir).part.select("p_partkey", "p_brand")
    levels = fit_levels(p, "p_brand")
    n = levels.count()
    return en.binary_encode(p, "p_brand", levels, n)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register(
    "one_hot",
    "SELECT c_custkey, c_mktsegment, "
    + ", ".join(
        f"CAST(COALESCE(c_mktsegment = '{s}', false) AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS
    )
    + ", CAST(c_mktsegment IS NULL AS INTEGER) AS c_mktsegment_nan FROM customer",
    ids="E7 E8 I3",
)
def q_one_hot(spark, sf_dir):
    c = _t(spark, sf_dir).customer.select("c_custkey", "c_mktsegment")
    levels = en.fit_one_hot(c, "c_mktsegment", en.ONE_HOT_MAX_LEVELS)
    return en.one_hot(c, "c_mktsegment", levels)


def _levels_sql(c: str) -> str:
    return f"(SELECT {c} AS v, ROW_NUMBER() OVER (ORDER BY {c}) AS code FROM (SELECT DISTINCT {c} FROM part WHERE {c} IS NOT NULL))"


@register(
    "encode_nominals",
    "SELECT p_partkey, "
    + ", ".join(f"CAST(COALESCE(p_type = '{t}', false) AS INTEGER) AS \"p_type_{t}\"" for t in PART_TYPES)
    + ", CAST(p_type IS NULL AS INTEGER) AS p_type_nan, "
    + ", ".join(f"CAST((COALESCE(l.code, 0) >> {4 - k}) & 1 AS INTEGER) AS p_brand_{k}" for k in range(5))
    + f" FROM part LEFT JOIN {_levels_sql('p_brand')} l ON l.v = p_brand",
    ids="E8 E6 E7",
)
def q_encode_nominals(spark, sf_dir):
    """Six types are one-hot, 25 brands get five binary digits."""
    p = _t(spark, sf_dir).part.select("p_partkey", "p_type", "p_brand")
    return en.encode_nominals(p, ["p_type", "p_brand"]).drop("p_type", "p_brand")


@register(
    "hash_encode_any",
    "SELECT p_partkey, "
    + ", ".join(f"CAST((CASE WHEN CAST(('0x' || md5(p_type))::UHUGEINT % 6 AS INTEGER) = {k} THEN 1 ELSE 0 END) AS INTEGER) AS col_{k}" for k in range(6))
    + " FROM part",
    ids="E9",
)
def q_hash_encode_any(spark, sf_dir):
    return en.hash_encode(_t(spark, sf_dir).part, ["p_type"], 6, key="p_partkey")


def _hash_sql(c: str) -> str:
    return f"((strpos('0123456789abcdef', right(md5(CAST({c} AS VARCHAR)), 1)) - 1) % 8)"


@register(
    "hash_encode",
    "SELECT p_partkey, "
    + ", ".join(
        f"CAST((CASE WHEN {_hash_sql('p_type')} = {k} THEN 1 ELSE 0 END)"
        f" + (CASE WHEN {_hash_sql('p_brand')} = {k} THEN 1 ELSE 0 END) AS INTEGER) AS col_{k}"
        for k in range(8)
    )
    + " FROM part",
    ids="E9",
)
def q_hash_encode(spark, sf_dir):
    p = _t(spark, sf_dir).part
    return en.hash_encode(p, ["p_type", "p_brand"], 8, key="p_partkey")


@register(
    "coords_lookup",
    with_views(["members"], """
SELECT c.c_custkey AS member_id, c.c_nationkey AS zip, m.region,
  CAST(CASE WHEN c.c_nationkey IS NULL THEN NULL WHEN z.k IS NOT NULL THEN z.lat
       WHEN m.region IN ('MIDDLE EAST') THEN 38.8719 ELSE 0.0 END AS DOUBLE) AS latitude,
  CAST(CASE WHEN c.c_nationkey IS NULL THEN NULL WHEN z.k IS NOT NULL THEN z.lon
       WHEN m.region IN ('MIDDLE EAST') THEN -77.0563 ELSE 0.0 END AS DOUBLE) AS longitude
FROM customer c JOIN members m ON c.c_custkey = m.member_id
LEFT JOIN (SELECT n_nationkey AS k, n_nationkey * 3.0 - 36.0 AS lat, n_regionkey * 60.0 - 120.0 + n_nationkey AS lon
           FROM nation WHERE n_nationkey % 4 <> 0) z ON c.c_nationkey = z.k"""),
    ids="E1 J3 S3",
)
def q_coords_lookup(spark, sf_dir):
    t = _t(spark, sf_dir)
    # centroid table: a fixed-size dimension (one row per nation), some keys absent
    table = t.nation.where(F.col("n_nationkey") % 4 != 0).select(
        F.col("n_nationkey").alias("key"),
        (F.col("n_nationkey") * 3.0 - 36.0).alias("lat"),
        (F.col("n_regionkey") * 60.0 - 120.0 + F.col("n_nationkey")).alias("lon"),
    )
    m = si.members(t).select("member_id", "region")
    base = t.customer.select(F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("zip")).join(
        m, "member_id"
    )
    return en.coords_lookup(base, "zip", "region", table, STANDIN_MILITARY_REGIONS)


def _mtd_wide(spark, sf_dir):
    """Months to donation per campaign, wide: a projection of the wide
    history with the learned first-send month of each campaign (E2)."""
    t = _t(spark, sf_dir)
    # every member of a campaign shares its sending month in the stand-in, so
    # the learned minimum per campaign is the campaign table's send date
    first = {r["i"]: r["send_date"] for r in si.campaigns(spark).collect()}
    w = si.history_wide(t)
    return w.select("member_id", *[
        fe.months_to_donation(F.lit(first[i]), F.lit(first[i]), F.col(f"RDATE_{i}")).alias(f"MTD_{i}")
        for i in CAMPAIGNS
    ])


_MTD_WIDE_SQL = "SELECT member_id, " + ", ".join(
    f"MAX(CASE WHEN i = {i} THEN m END) AS MTD_{i}" for i in CAMPAIGNS
) + f""" FROM (
  SELECT h.member_id, h.i,
    CASE WHEN h.rdate IS NULL THEN NULL
         WHEN {month_idx('h.rdate')} - {month_idx('f.first_send')} < 0
           THEN {month_idx('h.rdate')} - {month_idx('f.first_send')} + 12
         ELSE {month_idx('h.rdate')} - {month_idx('f.first_send')} END AS m
  FROM history h JOIN (SELECT i, MIN(send_date) AS first_send FROM history GROUP BY i) f ON h.i = f.i)
GROUP BY member_id"""


@register(
    "impute_median",
    with_views(["history"], "SELECT member_id, " + ", ".join(
        f"COALESCE(CAST(w.{c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM wide)) AS {c}" for c in MTD_COLS
    ) + " FROM wide w", [("wide", _MTD_WIDE_SQL)]),
    ids="I1 A3 E10",
)
def q_impute_median(spark, sf_dir):
    # the stage is materialised once (shared checkpoint folder); fit and
    # apply both read it instead of recomputing the history
    ensure_checkpoint_dir(spark)
    wide = _mtd_wide(spark, sf_dir).checkpoint(eager=True)
    med = en.fit_medians(wide, MTD_COLS)
    return en.impute(wide, med)


@register(
    "impute_mode",
    with_views(["raw_members"], """
SELECT member_id,
  COALESCE(r, (SELECT r FROM (SELECT r, COUNT(*) AS c FROM x WHERE r IS NOT NULL GROUP BY r)
               ORDER BY c DESC, r ASC LIMIT 1)) AS rfaR,
  COALESCE(a, (SELECT a FROM (SELECT a, COUNT(*) AS c FROM x WHERE a IS NOT NULL GROUP BY a)
               ORDER BY c DESC, a ASC LIMIT 1)) AS rfaA
FROM x""", [("x", """
SELECT member_id, CASE WHEN length(rfa) = 3 THEN substr(rfa, 1, 1) END AS r,
       CASE WHEN length(rfa) = 3 THEN substr(rfa, 3, 1) END AS a
FROM raw_members""")]),
    ids="I2 A4",
)
def q_impute_mode(spark, sf_dir):
    r = si.raw_members(_t(spark, sf_dir))
    x = r.select(
        "member_id",
        fx.byte_at(F.col("rfa"), 3, 1).alias("rfaR"),
        fx.byte_at(F.col("rfa"), 3, 3).alias("rfaA"),
    )
    modes = en.fit_modes(x, ["rfaR", "rfaA"])
    return en.impute(x, modes, as_type=None)

"""Donor-shaped views derived from the driver's star-schema tables.

The public donor file is not available, so every view here is a plain
Spark derivation of the given Parquet tables (customer, orders, nation,
region, part, lineitem, ...).  Each has a twin SQL text in
``donorlift.plans.oracle_views`` so DuckDB can recompute it independently.

Fixed values of the stand-in (they must equal the SQL twins):
  REF        2001-07-01   reference date of the campaign
  U          10880.0      unit cost per mailing, 0.68 x 16,000
  SCALE      16000.0      money scale: order totals / SCALE ~ reference gifts
  campaigns  i = 3 .. 24, send = REF - 3*(i-2) months, ends at the next send
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.functions.money import cents, from_cents

# Fixed values of the stand-in (see module docstring).
REF = _dt.date(2001, 7, 1)
REF_SQL = "2001-07-01"
UNIT_COST = 10880.0
SCALE = 16000.0
FIRST_CAMPAIGN = 3
LAST_CAMPAIGN = 24
CAMPAIGN_MONTHS = 3
DOMAIN_URBANICITY = "UCSTR"
FLAG_CODES = ["X", "1", "0", " ", None]


class Tables:
    """Lazy reader of the driver tables under one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


def _ref() -> Column:
    return F.lit(REF)


def month_index(c: Column) -> Column:
    """Months since year 0 of a date: year*12 + month - 1 (day ignored)."""
    return F.year(c) * 12 + F.month(c) - 1


def members(t: Tables) -> DataFrame:
    """customer x nation x region; nation (25 rows) and region (5 rows) are
    fixed-size dimension tables, so broadcasting them is bounded."""
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    region = t.region.select("r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return t.customer.join(
        F.broadcast(geo), t.customer.c_nationkey == geo.n_nationkey
    ).select(
        F.col("c_custkey").alias("member_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("acctbal"),
    )


def gifts(t: Tables) -> DataFrame:
    """Orders before the reference date are the giving history."""
    o = t.orders
    return o.where(o.o_orderdate < F.lit(_dt.datetime(2001, 7, 1))).select(
        F.col("o_custkey").alias("member_id"),
        F.col("o_orderkey").alias("gift_id"),
        F.col("o_orderdate").cast("date").alias("gift_date"),
        F.col("o_totalprice").alias("amount"),
    )


def member_orders(t: Tables) -> DataFrame:
    """One scan and one shuffle of orders for everything keyed by member:
    gifts before REF (count, recent count, sum) and the response after REF
    (count, sum), by conditional aggregates with map-side partial
    aggregation, then a left join to all member keys."""
    o = t.orders
    before = o.o_orderdate < F.lit(_dt.datetime(2001, 7, 1))
    back = month_index(_ref()) - month_index(o.o_orderdate.cast("date"))
    amt = cents(o.o_totalprice)
    agg = o.groupBy(o.o_custkey.alias("member_id")).agg(
        F.count_if(before & (back <= 24)).alias("_recent"),
        F.count_if(before).alias("_all"),
        F.sum(F.when(before, amt)).alias("_sum"),
        F.count_if(~before).alias("_nresp"),
        F.sum(F.when(~before, amt)).alias("_amt"),
    )
    keys = t.customer.select(F.col("c_custkey").alias("member_id"))
    return keys.join(agg, "member_id", "left")


def targets(t: Tables) -> DataFrame:
    """Response to the campaign: any order on/after REF; amount = their sum."""
    return _targets_of(member_orders(t))


def _targets_of(mo: DataFrame) -> DataFrame:
    return mo.select(
        "member_id",
        F.when(F.coalesce(F.col("_nresp"), F.lit(0)) > 0, 1).otherwise(0).cast("int").alias("target_b"),
        from_cents(F.coalesce(F.col("_amt"), F.lit(0).cast("long"))).alias("target_d"),
    )


def campaign_of(gift_date: Column) -> Column:
    """Campaign index i of a gift date: campaign i covers
    [REF - 3(i-2) months, REF - 3(i-3) months).  Null outside 3..24."""
    back = month_index(_ref()) - month_index(gift_date)  # >= 1 before REF
    i = F.ceil(back / F.lit(CAMPAIGN_MONTHS)).cast("int") + 2
    return F.when((back >= 1) & (i <= LAST_CAMPAIGN), i)


def campaign_send(i: Column) -> Column:
    return F.add_months(_ref(), -CAMPAIGN_MONTHS * (i - 2))


def campaigns(spark: SparkSession) -> DataFrame:
    """The 22 campaigns; a fixed-size parameter table (never data-grown)."""
    i = F.col("i")
    return spark.range(FIRST_CAMPAIGN, LAST_CAMPAIGN + 1).select(
        F.col("id").cast("int").alias("i")
    ).select(
        "i",
        campaign_send(i).alias("send_date"),
        F.add_months(_ref(), -CAMPAIGN_MONTHS * (i - 3)).alias("end_date"),
    )


def history_wide(t: Tables) -> DataFrame:
    """E10 wide form: one row per member with RDATE_i (first gift in
    campaign i's window) and RAMNT_i (their sum), i = 3..24.

    One aggregation of the gifts keyed by member (44 conditional
    aggregates, partial aggregation map-side), then a left join to the
    member keys: one row per member on both sides of the join."""
    g = gifts(t).withColumn("i", campaign_of(F.col("gift_date")))
    aggs = []
    for i in range(FIRST_CAMPAIGN, LAST_CAMPAIGN + 1):
        hit = F.col("i") == i
        aggs.append(F.min(F.when(hit, F.col("gift_date"))).alias(f"RDATE_{i}"))
        aggs.append(from_cents(F.sum(F.when(hit, cents(F.col("amount"))))).alias(f"RAMNT_{i}"))
    wide = g.where(F.col("i").isNotNull()).groupBy("member_id").agg(*aggs)
    keys = t.customer.select(F.col("c_custkey").alias("member_id"))
    return keys.join(wide, "member_id", "left")


def history(t: Tables) -> DataFrame:
    """Long promotion/giving history: one row per member and campaign,
    unpivoted from the wide form (a narrow step, no second shuffle)."""
    w = history_wide(t)
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"RDATE_{i}").alias("rdate"), F.col(f"RAMNT_{i}").alias("ramnt"))
        for i in range(FIRST_CAMPAIGN, LAST_CAMPAIGN + 1)
    ])
    return w.select("member_id", F.explode(cells).alias("c")).select(
        "member_id", F.col("c.i").alias("i"), campaign_send(F.col("c.i")).alias("send_date"),
        F.col("c.rdate").alias("rdate"), F.col("c.ramnt").alias("ramnt"),
    )


def first_gift(t: Tables) -> DataFrame:
    """(member_id, first_date) over all orders, for the member's origin date."""
    return t.orders.groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_date")
    )


def raw_members(t: Tables) -> DataFrame:
    """Member file with noise on purpose, keyed by k = member_id:
    odate  'yyMM' of the first order; leading '0' cut when k % 7 = 0
    zip    lpad(k*37 % 99999, 5, '0'), trailing '-' when k % 11 = 0
    flag   by k % 5: 'X', '1', '0', ' ', null
    rfa    R: 'FNALIS'[k % 6], F: k % 4 + 1, A: 'ABCDEFG'[k % 7]; cut to 2 chars when k % 13 = 0
    domain 'UCSTR'[k % 5] + (k % 4 + 1)
    """
    k = F.col("member_id")
    od = F.date_format(F.col("first_date"), "yyMM")
    odate = F.when((k % 7 == 0) & od.startswith("0"), F.substring(od, 2, 3)).otherwise(od)
    z = F.lpad(((k * 37) % 99999).cast("string"), 5, "0")
    zipc = F.when(k % 11 == 0, F.concat(z, F.lit("-"))).otherwise(z)
    flag = (
        F.when(k % 5 == 0, "X")
        .when(k % 5 == 1, "1")
        .when(k % 5 == 2, "0")
        .when(k % 5 == 3, " ")
    )
    rfa3 = F.concat(
        F.substring(F.lit("FNALIS"), (k % 6 + 1).cast("int"), 1),
        (k % 4 + 1).cast("string"),
        F.substring(F.lit("ABCDEFG"), (k % 7 + 1).cast("int"), 1),
    )
    rfa = F.when(k % 13 == 0, F.substring(rfa3, 1, 2)).otherwise(rfa3)
    domain = F.concat(
        F.substring(F.lit(DOMAIN_URBANICITY), (k % 5 + 1).cast("int"), 1),
        (k % 4 + 1).cast("string"),
    )
    base = t.customer.select(F.col("c_custkey").alias("member_id")).join(
        first_gift(t), "member_id", "left"
    )
    return base.select(
        "member_id",
        odate.alias("odate"),
        zipc.alias("zip"),
        flag.alias("flag"),
        rfa.alias("rfa"),
        domain.alias("domain"),
    )


def scored(t: Tables) -> DataFrame:
    """Rule score per member, no model needed:
    p = gifts in the last 24 months / (all gifts + 1), d_hat = mean gift.
    Scores and targets come from the same single aggregation of orders."""
    mo = member_orders(t)
    return mo.select(
        "member_id",
        (F.coalesce(F.col("_recent"), F.lit(0)) / (F.coalesce(F.col("_all"), F.lit(0)) + 1)).alias("p"),
        (from_cents(F.col("_sum")) / F.when(F.col("_all") > 0, F.col("_all"))).alias("d_hat"),
        F.when(F.coalesce(F.col("_nresp"), F.lit(0)) > 0, 1).otherwise(0).cast("int").alias("target_b"),
        from_cents(F.coalesce(F.col("_amt"), F.lit(0).cast("long"))).alias("target_d"),
    )

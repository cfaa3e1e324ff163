"""Giving history, promotion, time, RFA and segment queries
(A11-A16, A22, A23, E2-E5, E11-E13, W7-W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorlift.functions import codes as fx
from donorlift.functions.money import cents, from_cents, mean_from_cents, sql_cents, sql_mean_from_cents
from donorlift.operators import features as fe
from donorlift.operators import segments as sg
from donorlift.plans.oracle_views import REF_MONTH, month_idx, with_views
from donorlift.plans.q_clean import sql_fix_date, sql_parse_yymm
from donorlift.plans.registry import register
from donorlift.sources import standin as si
from donorlift.streaming import gifts as st

REF = si.REF


def _t(spark, sf_dir):
    return si.Tables(spark, sf_dir)


def _gift_first(g):
    return g.groupBy("member_id").agg(F.min("gift_date").alias("first_date"))


# ---- SQL building blocks (independent of the Spark code) --------------------
G_SQL = f"""
SELECT member_id, gift_id, gift_date, amount, {REF_MONTH} - {month_idx('gift_date')} AS back,
       CAST(ceil(({REF_MONTH} - {month_idx('gift_date')}) / 3) AS INTEGER) + 2 AS ci
FROM gifts"""
GS_SQL = f"""
SELECT member_id,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS ramntall, COUNT(*) AS ngiftall,
  COUNT(CASE WHEN ci <= 24 AND ci % 3 = 0 THEN 1 END) AS cardgift,
  MAX(CASE WHEN rmin = 1 THEN amount END) AS minramnt, MAX(CASE WHEN rmin = 1 THEN gift_date END) AS minrdate,
  MAX(CASE WHEN rmax = 1 THEN amount END) AS maxramnt, MAX(CASE WHEN rmax = 1 THEN gift_date END) AS maxrdate,
  MAX(CASE WHEN rlast = 1 THEN amount END) AS lastgift, MAX(CASE WHEN rlast = 1 THEN gift_date END) AS lastdate,
  MAX(CASE WHEN rfirst = 1 THEN gift_date END) AS fistdate, MAX(CASE WHEN rfirst = 2 THEN gift_date END) AS nextdate,
  {sql_mean_from_cents('SUM(' + sql_cents('amount') + ')', 'COUNT(*)')} AS avggift
FROM (SELECT *,
        ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY amount, gift_date, gift_id) AS rmin,
        ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY amount DESC, gift_date, gift_id) AS rmax,
        ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY gift_date DESC, gift_id DESC) AS rlast,
        ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY gift_date, gift_id) AS rfirst
      FROM g)
GROUP BY member_id"""
GIVING_CTES = [("g", G_SQL), ("gs", GS_SQL)]
RFM_SQL = f"""
SELECT member_id, CAST({REF_MONTH} - {month_idx('MAX(gift_date)')} AS INTEGER) AS recency,
       COUNT(*) AS frequency, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS monetary
FROM gifts GROUP BY member_id"""


def _band_sql(x: str) -> str:
    edges = [(32000, "A"), (48000, "B"), (80000, "C"), (160000, "D"), (240000, "E"), (400000, "F")]
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN '{c}'" for e, c in edges) + " ELSE 'G' END"


RFA_SQL = f"""
SELECT a.member_id, a.recency,
  CAST(LEAST(GREATEST(CASE a.recency WHEN 'L' THEN a.n24 WHEN 'I' THEN a.n36 ELSE a.n12 END, 1), 4)
       AS INTEGER) AS frequency,
  {_band_sql('l.amount')} AS amount,
  a.star, CAST(a.last_back AS INTEGER) AS months_since_last
FROM (SELECT *,
        CASE WHEN star THEN 'S'
             WHEN first_back <= 6 AND n = 1 THEN 'F'
             WHEN first_back <= 12 THEN 'N'
             WHEN last_back <= 12 THEN 'A'
             WHEN last_back <= 24 THEN 'L' ELSE 'I' END AS recency
      FROM (SELECT x.*, s.member_id IS NOT NULL AS star
            FROM (SELECT member_id, MIN(back) AS last_back, MAX(back) AS first_back, COUNT(*) AS n,
                         COUNT(CASE WHEN back <= 12 THEN 1 END) AS n12,
                         COUNT(CASE WHEN back BETWEEN 13 AND 24 THEN 1 END) AS n24,
                         COUNT(CASE WHEN back BETWEEN 25 AND 36 THEN 1 END) AS n36
                  FROM g GROUP BY member_id) x
            LEFT JOIN stars s ON x.member_id = s.member_id)) a
JOIN (SELECT member_id, amount FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY gift_date DESC, gift_id DESC) AS rn
        FROM g) WHERE rn = 1) l ON a.member_id = l.member_id"""
STARS_SQL = """
SELECT DISTINCT member_id FROM (
  SELECT member_id, SUM(gave) OVER (PARTITION BY member_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT member_id, i, CASE WHEN rdate IS NOT NULL THEN 1 ELSE 0 END AS gave
        FROM history WHERE i % 3 = 0))
WHERE run = 3"""
RFA_CTES = [("g", G_SQL), ("stars", STARS_SQL), ("rfa", RFA_SQL)]


@register(
    "giving_summary",
    with_views(["gifts"], f"""
SELECT member_id, ramntall, ngiftall, cardgift, minramnt, minrdate, maxramnt, maxrdate,
       lastgift, lastdate, fistdate, nextdate,
       CAST({month_idx('nextdate')} - {month_idx('fistdate')} AS INTEGER) AS timelag, avggift
FROM gs""", GIVING_CTES),
    ids="A22 W8",
)
def q_giving_summary(spark, sf_dir):
    return sg.giving_summary(si.gifts(_t(spark, sf_dir)), REF)


@register(
    "time_lag",
    with_views(["gifts"], f"""
SELECT member_id, fistdate, nextdate,
       CAST({month_idx('nextdate')} - {month_idx('fistdate')} AS INTEGER) AS timelag
FROM gs WHERE nextdate IS NOT NULL""", GIVING_CTES),
    ids="W8",
)
def q_time_lag(spark, sf_dir):
    gs = sg.giving_summary(si.gifts(_t(spark, sf_dir)), REF)
    return gs.where(F.col("nextdate").isNotNull()).select("member_id", "fistdate", "nextdate", "timelag")


PROMOTION_SQL = """
SELECT h.member_id, COUNT(*) AS numprom, COUNT(CASE WHEN h.i % 3 = 0 THEN 1 END) AS cardprom,
  COUNT(CASE WHEN h.send_date >= DATE '2000-07-01' THEN 1 END) AS numprm12,
  COUNT(CASE WHEN h.i % 3 = 0 AND h.send_date >= DATE '2000-07-01' THEN 1 END) AS cardpm12,
  COUNT(CASE WHEN h.rdate IS NOT NULL THEN 1 END) AS n_responses,
  COUNT(CASE WHEN h.i % 3 = 0 AND h.rdate IS NOT NULL THEN 1 END) AS card_responses
FROM history h
JOIN (SELECT member_id, MIN(gift_date) AS first_date FROM gifts GROUP BY member_id) f
  ON h.member_id = f.member_id
WHERE h.send_date >= CAST(date_trunc('month', f.first_date) AS DATE)
GROUP BY h.member_id"""


@register(
    "promotion_summary",
    with_views(["history", "gifts"], PROMOTION_SQL),
    ids="A23",
)
def q_promotion_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sg.promotion_summary(si.history(t), _gift_first(si.gifts(t)), REF)


@register(
    "months_to_donation",
    with_views(["history"], f"""
SELECT h.member_id, h.i,
  CAST(CASE WHEN h.rdate IS NULL THEN NULL
       WHEN {month_idx('h.rdate')} - {month_idx('f.first_send')} < 0
         THEN {month_idx('h.rdate')} - {month_idx('f.first_send')} + 12
       ELSE {month_idx('h.rdate')} - {month_idx('f.first_send')} END AS INTEGER) AS months_to_donation
FROM history h JOIN (SELECT i, MIN(send_date) AS first_send FROM history GROUP BY i) f ON h.i = f.i"""),
    ids="E2 A5",
)
def q_months_to_donation(spark, sf_dir):
    h = si.history(_t(spark, sf_dir))
    first = fe.first_send_lookup(h)  # one value per campaign, learned once
    return h.select(
        "member_id", "i",
        fe.months_to_donation(F.col("send_date"), first, F.col("rdate")).alias("months_to_donation"),
    )


@register(
    "time_deltas",
    with_views(["gifts"], f"""
SELECT member_id,
  CAST({REF_MONTH} - {month_idx('lastdate')} AS INTEGER) AS lastdate_delta_months,
  CAST({REF_MONTH} - {month_idx('minrdate')} AS INTEGER) AS minrdate_delta_months,
  CAST({REF_MONTH} - {month_idx('maxrdate')} AS INTEGER) AS maxrdate_delta_months,
  CAST({REF_MONTH} - {month_idx('fistdate')} AS INTEGER) AS fistdate_delta_months
FROM gs""", GIVING_CTES),
    ids="E3",
)
def q_time_deltas(spark, sf_dir):
    gs = sg.giving_summary(si.gifts(_t(spark, sf_dir)), REF)
    return gs.select(
        "member_id",
        *[fe.delta_months(REF, F.col(c)).alias(f"{c}_delta_months") for c in ("lastdate", "minrdate", "maxrdate", "fistdate")],
    )


@register(
    "membership_years",
    with_views(["raw_members"], f"""
SELECT member_id, odate, CAST(trunc(({REF_MONTH} - {month_idx('odate')}) / 12) AS INTEGER) + 1 AS membership_years
FROM (SELECT member_id, {sql_parse_yymm(sql_fix_date('odate'), 2001)} AS odate FROM raw_members)"""),
    ids="E4 E5",
)
def q_membership_years(spark, sf_dir):
    r = si.raw_members(_t(spark, sf_dir))
    od = fx.parse_yymm(fx.fix_short_date(F.col("odate")), REF.year)
    return r.select("member_id", od.alias("odate")).select(
        "member_id", "odate", fe.membership_years(REF, F.col("odate")).alias("membership_years")
    )


@register(
    "rfa_status",
    with_views(["gifts", "history"], """
SELECT member_id, recency, frequency, amount, recency || CAST(frequency AS VARCHAR) || amount AS rfa,
       star, months_since_last
FROM rfa""", RFA_CTES),
    ids="E11 E12",
)
def q_rfa_status(spark, sf_dir):
    return sg.rfa_status(si.gifts(_t(spark, sf_dir)), REF, si.SCALE)


_RFA_HISTORY_CTES = [
    ("c", "SELECT i, CAST(DATE '2001-07-01' - to_months(3 * (i - 2)) AS DATE) AS sent FROM (SELECT CAST(UNNEST(range(3, 25)) AS INTEGER) AS i)"),
    ("g", f"""
SELECT member_id, c.i, gift_id, gift_date, amount, {month_idx('c.sent')} - {month_idx('gift_date')} AS back,
       CAST(ceil(({REF_MONTH} - {month_idx('gift_date')}) / 3) AS INTEGER) + 2 AS ci
FROM gifts JOIN c ON gift_date < c.sent"""),
    ("stars", """
SELECT DISTINCT a.member_id, a.i FROM (SELECT DISTINCT member_id, i, ci FROM g WHERE ci <= 24 AND ci % 3 = 0) a
JOIN g b ON b.member_id = a.member_id AND b.i = a.i AND b.ci = a.ci + 3 AND b.ci <= 24
JOIN g d ON d.member_id = a.member_id AND d.i = a.i AND d.ci = a.ci + 6 AND d.ci <= 24"""),
    ("n", """
SELECT member_id, i, MIN(back) AS last_back, MAX(back) AS first_back, COUNT(*) AS n, COUNT(CASE WHEN back <= 12 THEN 1 END) AS n12,
  COUNT(CASE WHEN back BETWEEN 13 AND 24 THEN 1 END) AS n24, COUNT(CASE WHEN back BETWEEN 25 AND 36 THEN 1 END) AS n36,
  arg_max(amount, (gift_date, gift_id)) AS last_amount
FROM g GROUP BY member_id, i"""),
    ("r", """
SELECT n.*, s.member_id IS NOT NULL AS star,
  CASE WHEN s.member_id IS NOT NULL THEN 'S' WHEN first_back <= 6 AND n = 1 THEN 'F' WHEN first_back <= 12 THEN 'N'
       WHEN last_back <= 12 THEN 'A' WHEN last_back <= 24 THEN 'L' ELSE 'I' END AS recency
FROM n LEFT JOIN stars s USING (member_id, i)"""),
]


_RFA_HISTORY_SQL = with_views(["gifts"], f"""
SELECT member_id, i, recency, frequency, amount, recency || CAST(frequency AS VARCHAR) || amount AS rfa, star, months_since_last
FROM (SELECT member_id, i, recency, star, CAST(last_back AS INTEGER) AS months_since_last, {_band_sql('last_amount')} AS amount,
        CAST(LEAST(GREATEST(CASE recency WHEN 'L' THEN n24 WHEN 'I' THEN n36 ELSE n12 END, 1), 4) AS INTEGER) AS frequency FROM r)""",
        _RFA_HISTORY_CTES)


@register("rfa_history", _RFA_HISTORY_SQL, ids="E10 E11")
def q_rfa_history(spark, sf_dir):
    return sg.rfa_history(si.gifts(_t(spark, sf_dir)), si.campaigns(spark), REF, si.SCALE)


@register("stream_rfa_status", _RFA_HISTORY_SQL, ids="T3 E11")
def q_stream_rfa_status(spark, sf_dir):
    """The same status from the stream of orders, by timers at the dates."""
    dates = [(r["i"], r["send_date"]) for r in si.campaigns(spark).collect()]  # 22 rows
    return st.rfa_status_stream(spark, sf_dir, dates, REF, si.SCALE)


@register(
    "star_donors",
    with_views(["gifts", "history"], """
SELECT d.member_id, s.member_id IS NOT NULL AS star
FROM (SELECT DISTINCT member_id FROM gifts) d LEFT JOIN stars s ON d.member_id = s.member_id""",
        [("stars", STARS_SQL)]),
    ids="W9",
)
def q_star_donors(spark, sf_dir):
    return sg.rfa_status(si.gifts(_t(spark, sf_dir)), REF, si.SCALE).select("member_id", "star")


@register(
    "lapsed_members",
    with_views(["gifts"], f"""
SELECT member_id, last_gift_date, CAST(months_since AS INTEGER) AS months_since FROM (
  SELECT member_id, MAX(gift_date) AS last_gift_date,
         {REF_MONTH} - {month_idx('MAX(gift_date)')} AS months_since
  FROM gifts GROUP BY member_id)
WHERE months_since BETWEEN 13 AND 24"""),
    ids="E13",
)
def q_lapsed_members(spark, sf_dir):
    return sg.lapsed(si.gifts(_t(spark, sf_dir)), REF)


@register(
    "rfm_cells",
    with_views(["gifts"], """
SELECT member_id, recency, frequency, monetary, r_tile, f_tile, m_tile,
       CAST(r_tile AS VARCHAR) || CAST(f_tile AS VARCHAR) || CAST(m_tile AS VARCHAR) AS cell
FROM (SELECT *, CAST(NTILE(5) OVER (ORDER BY recency ASC, member_id) AS INTEGER) AS r_tile,
             CAST(NTILE(5) OVER (ORDER BY frequency DESC, member_id) AS INTEGER) AS f_tile,
             CAST(NTILE(5) OVER (ORDER BY monetary DESC, member_id) AS INTEGER) AS m_tile
      FROM rfm)""", [("rfm", RFM_SQL)]),
    ids="W7",
)
def q_rfm_cells(spark, sf_dir):
    return sg.rfm_cells(sg.rfm_base(si.gifts(_t(spark, sf_dir)), REF))


@register(
    "rfm_alltime",
    with_views(["gifts", "targets"], f"""
SELECT t.target_b, COUNT(*) AS n_members, round(avg(r.recency), 4) AS avg_recency,
       round(avg(r.frequency / (({REF_MONTH} - {month_idx('f.first_date')}) / 12.0)), 4) AS avg_gifts_per_year,
       round(avg(r.monetary / (({REF_MONTH} - {month_idx('f.first_date')}) / 12.0)), 2) AS avg_amount_per_year
FROM rfm r JOIN (SELECT member_id, MIN(gift_date) AS first_date FROM gifts GROUP BY member_id) f
  ON r.member_id = f.member_id
JOIN targets t ON r.member_id = t.member_id
GROUP BY t.target_b""", [("rfm", RFM_SQL)]),
    ids="A14",
)
def q_rfm_alltime(spark, sf_dir):
    t = _t(spark, sf_dir)
    g = si.gifts(t)
    return sg.rfm_alltime(sg.rfm_base(g, REF), _gift_first(g), si.targets(t), REF)


@register(
    "amount_by_region",
    with_views(["gifts", "members"], """
SELECT m.nation, COUNT(*) AS n_gifts,
       CAST(SUM(CAST(g.amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
       """ + sql_mean_from_cents("SUM(" + sql_cents("g.amount") + ")", "COUNT(*)") + """ AS avg_amount
FROM gifts g JOIN members m ON g.member_id = m.member_id GROUP BY m.nation"""),
    ids="A11",
)
def q_amount_by_region(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = si.gifts(t).join(si.members(t), "member_id")
    return j.groupBy("nation").agg(
        F.count(F.lit(1)).alias("n_gifts"),
        from_cents(F.sum(cents(F.col("amount")))).alias("total_amount"),
        F.sum(cents(F.col("amount"))).alias("_c"),
    ).withColumn("avg_amount", mean_from_cents("_c", "n_gifts")).drop("_c")


@register(
    "giving_by_segment",
    with_views(["gifts", "members"], """
SELECT m.segment, COUNT(*) AS n_members,
       """ + sql_mean_from_cents("SUM(" + sql_cents("r.monetary") + ")", "COUNT(*)") + """ AS avg_lifetime_amount
FROM rfm r JOIN members m ON r.member_id = m.member_id GROUP BY m.segment""", [("rfm", RFM_SQL)]),
    ids="A12",
)
def q_giving_by_segment(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = sg.rfm_base(si.gifts(t), REF).join(si.members(t), "member_id")
    return j.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum(cents(F.col("monetary"))).alias("_c")
    ).withColumn("avg_lifetime_amount", mean_from_cents("_c", "n_members")).drop("_c")


@register(
    "amount_by_segment_quartiles",
    with_views(["gifts", "members"], """
SELECT m.region, m.segment, round(quantile_cont(g.amount, 0.25), 4) AS q25,
       round(quantile_cont(g.amount, 0.5), 4) AS q50, round(quantile_cont(g.amount, 0.75), 4) AS q75
FROM gifts g JOIN members m ON g.member_id = m.member_id GROUP BY m.region, m.segment"""),
    ids="A13",
)
def q_amount_by_segment_quartiles(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = si.gifts(t).join(si.members(t), "member_id").select("region", "segment", "amount", "gift_id")
    return sg.group_quartiles(j, ["region", "segment"], "amount")


@register(
    "amount_by_recency",
    with_views(["gifts", "targets"], """
SELECT r.recency, COUNT(*) AS n_members, CAST(SUM(r.frequency) AS BIGINT) AS n_gifts,
       """ + sql_mean_from_cents("SUM(" + sql_cents("t.target_d") + ")", "COUNT(*)") + """ AS avg_response_amount,
       MAX(t.target_d) AS max_response_amount
FROM rfm r JOIN targets t ON r.member_id = t.member_id GROUP BY r.recency""", [("rfm", RFM_SQL)]),
    ids="A15",
)
def q_amount_by_recency(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = sg.rfm_base(si.gifts(t), REF).join(si.targets(t), "member_id")
    return j.groupBy("recency").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.sum("frequency").alias("n_gifts"),
        F.sum(cents(F.col("target_d"))).alias("_c"),
        F.max("target_d").alias("max_response_amount"),
    ).withColumn("avg_response_amount", mean_from_cents("_c", "n_members")).drop("_c")


@register(
    "amount_by_frequency",
    with_views(["gifts", "history", "targets"], """
SELECT r.frequency, COUNT(*) AS n_members, round(avg(t.target_b), 4) AS response_rate,
       """ + sql_mean_from_cents("SUM(CASE WHEN t.target_b = 1 THEN " + sql_cents("t.target_d") + " END)", "COUNT(CASE WHEN t.target_b = 1 THEN 1 END)") + """ AS avg_response_amount
FROM rfa r JOIN targets t ON r.member_id = t.member_id GROUP BY r.frequency""", RFA_CTES),
    ids="A16",
)
def q_amount_by_frequency(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = sg.rfa_status(si.gifts(t), REF, si.SCALE).join(si.targets(t), "member_id")
    return j.groupBy("frequency").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.round(F.avg("target_b"), 4).alias("response_rate"),
        F.sum(F.when(F.col("target_b") == 1, cents(F.col("target_d")))).alias("_c"),
        F.count_if(F.col("target_b") == 1).alias("_r"),
    ).withColumn("avg_response_amount", mean_from_cents("_c", "_r")).drop("_c", "_r")

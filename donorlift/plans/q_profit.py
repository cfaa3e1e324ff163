"""Profit queries on the rule-scored members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.operators import profit as pr
from donorlift.plans.oracle_views import with_views
from donorlift.plans.registry import register
from donorlift.sources import standin as si

N = pr.DEFAULT_GRID
U = si.UNIT_COST


def scored_with_crit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = si.Tables(spark, sf_dir)
    return si.scored(t).withColumn(
        "crit", pr.critical_alpha_amount(F.col("p"), F.col("d_hat"), U)
    )


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.profit_curve(scored_with_crit(spark, sf_dir), "crit", "target_d", U, N)


def kstar(spark: SparkSession, sf_dir: str) -> int:
    return pr.fit_alpha_star(curve(spark, sf_dir))


# --- oracle text: brute force, every grid alpha against every member -------
_CRIT = """
SELECT member_id, p, d_hat, target_b, target_d,
       CASE WHEN p > 0 AND d_hat > 0 THEN CAST(10880.0 AS DOUBLE) / (p * d_hat) END AS c
FROM scored"""
_GRID = "SELECT range AS k FROM range(0, 10000)"
_CURVE = """
SELECT g.k, g.k / 9999 AS alpha, COUNT(s.c) AS n_mailed,
       CAST(COALESCE(SUM(CAST(s.target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2))), 0)
            AS DOUBLE) AS profit
FROM grid g LEFT JOIN crit s ON g.k / 9999 > s.c
GROUP BY g.k"""
_BEST = "SELECT k, alpha, n_mailed, profit FROM curve ORDER BY profit DESC, k ASC LIMIT 1"
_CTES = [("crit", _CRIT), ("grid", _GRID), ("curve", _CURVE), ("best", _BEST)]
_MAILED = """
SELECT s.*, CASE WHEN s.c IS NOT NULL AND b.k / 9999 > s.c THEN 1 ELSE 0 END AS mailed,
       CAST(s.target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)) AS net, b.k AS kstar
FROM crit s, best b"""


@register(
    "profit_curve",
    with_views(["scored"], "SELECT k, alpha, n_mailed, profit FROM curve", _CTES[:3]),
    ids="G4 W5 G3 A19",
)
def q_profit_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@register("alpha_star", with_views(["scored"], "SELECT * FROM best", _CTES), ids="G5 K6")
def q_alpha_star(spark, sf_dir):
    return pr.alpha_star(curve(spark, sf_dir))


@register("alpha_star_exact", with_views(["scored"], """
SELECT b.c AS above, (SELECT min(c) FROM crit WHERE c > b.c) AS upto, (b.c + least((SELECT min(c) FROM crit WHERE c > b.c), 1.0::DOUBLE)) / 2 AS alpha, n_mailed, CAST(profit AS DOUBLE) AS profit
FROM (SELECT c, CAST(SUM(COUNT(*)) OVER w AS BIGINT) AS n_mailed, SUM(SUM(CAST(target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)))) OVER w AS profit
  FROM crit WHERE c < 1 GROUP BY c WINDOW w AS (ORDER BY c) ORDER BY profit DESC, c LIMIT 1) b""", _CTES[:1]), ids="G5")
def q_alpha_star_exact(spark, sf_dir):
    return pr.exact_alpha_star(scored_with_crit(spark, sf_dir), "crit", "target_d", U)


@register(
    "curve_flat_point",
    with_views(
        ["scored"],
        """
SELECT k, alpha, profit FROM (
  SELECT k, alpha, profit,
         MAX(profit) OVER w - MIN(profit) OVER w AS spread, COUNT(*) OVER w AS seen
  FROM curve WINDOW w AS (ORDER BY k ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
WHERE seen = 200 AND spread = 0 ORDER BY k LIMIT 1""",
        _CTES[:3],
    ),
    ids="W6",
)
def q_curve_flat_point(spark, sf_dir):
    return pr.early_stop_point(curve(spark, sf_dir), 200)


@register(
    "net_profit",
    with_views(
        ["scored"],
        """
SELECT member_id, mailed,
       CAST(CASE WHEN mailed = 1 THEN net ELSE CAST(0 AS DECIMAL(18,2)) END AS DOUBLE) AS profit
FROM mailed""",
        _CTES + [("mailed", _MAILED)],
    ),
    ids="G2 G6 A19 P8",
)
def q_net_profit(spark, sf_dir):
    s = scored_with_crit(spark, sf_dir)
    return pr.net_profit(s, "member_id", "crit", "target_d", U, kstar(spark, sf_dir), N)


@register(
    "max_profit",
    with_views(
        ["scored"],
        """
SELECT CAST(SUM(CASE WHEN target_d > 0
                     THEN CAST(target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)) END)
            AS DOUBLE) AS max_profit,
       COUNT(CASE WHEN target_d > 0 THEN 1 END) AS n_responders
FROM scored""",
    ),
    ids="A20 P7",
)
def q_max_profit(spark, sf_dir):
    return pr.max_profit(scored_with_crit(spark, sf_dir), "target_d", U)


@register(
    "mailing_summary",
    with_views(
        ["scored"],
        """
SELECT MAX(kstar) AS k, MAX(kstar) / 9999 AS alpha,
       COUNT(CASE WHEN mailed = 1 THEN 1 END) AS n_mailed,
       CAST(SUM(CASE WHEN mailed = 1 THEN net END) AS DOUBLE) AS profit,
       CAST(MIN(CASE WHEN mailed = 1 THEN net END) AS DOUBLE) AS min_profit,
       round(CAST(SUM(CASE WHEN mailed = 1 THEN net END) AS DOUBLE)
             / COUNT(CASE WHEN mailed = 1 THEN 1 END), 4) AS mean_profit,
       round(stddev_samp(CASE WHEN mailed = 1 THEN CAST(net AS DOUBLE) END), 2) AS std_profit,
       CAST(MAX(CASE WHEN mailed = 1 THEN net END) AS DOUBLE) AS max_member_profit,
       CAST(SUM(CASE WHEN target_d > 0 THEN net END) AS DOUBLE) AS max_profit,
       round(CAST(SUM(CASE WHEN mailed = 1 THEN net END) AS DOUBLE)
             / CAST(SUM(CASE WHEN target_d > 0 THEN net END) AS DOUBLE) * 100, 4) AS pct_of_max,
       round(SUM(CASE WHEN mailed = 1 THEN d_hat - 10880.0 END), 2) AS predicted_profit
FROM mailed""",
        _CTES + [("mailed", _MAILED)],
    ),
    ids="G9 G7 A21",
)
def q_mailing_summary(spark, sf_dir):
    s = scored_with_crit(spark, sf_dir)
    return pr.mailing_summary(s, "crit", "target_d", "d_hat", U, None, N)


@register(
    "predicted_amounts",
    with_views(
        ["scored"],
        """
SELECT round(MIN(d_hat), 2) AS min_amount, round(quantile_cont(d_hat, 0.5), 2) AS median_amount,
       round(MAX(d_hat), 2) AS max_amount
FROM mailed WHERE mailed = 1""",
        _CTES + [("mailed", _MAILED)],
    ),
    ids="G10",
)
def q_predicted_amounts(spark, sf_dir):
    s = scored_with_crit(spark, sf_dir)
    return pr.predicted_amounts(s, "crit", "d_hat", kstar(spark, sf_dir), N)


@register(
    "cup_measure",
    with_views(
        ["scored"],
        """
SELECT COUNT(CASE WHEN p * d_hat > 10880.0 THEN 1 END) AS n_mailed,
       CAST(SUM(CASE WHEN p * d_hat > 10880.0
                THEN CAST(target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)) END)
            AS DOUBLE) AS net,
       round(CAST(SUM(CASE WHEN p * d_hat > 10880.0
                THEN CAST(target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)) END)
            AS DOUBLE), -1) AS cup_measure
FROM scored""",
    ),
    ids="G8",
)
def q_cup_measure(spark, sf_dir):
    s = scored_with_crit(spark, sf_dir).withColumn("pred_amount", F.col("p") * F.col("d_hat"))
    return pr.cup_measure(s, "pred_amount", "target_d", U)


@register(
    "curve_compare",
    with_views(
        ["scored"],
        """
SELECT k, alpha, kind, profit FROM (
  SELECT r.k, r.alpha, r.profit AS realised, p.profit AS predicted
  FROM curve r JOIN pcurve p ON r.k = p.k)
UNPIVOT (profit FOR kind IN (realised, predicted))""",
        _CTES[:3] + [("pcurve", """
SELECT g.k, round(COALESCE(SUM(s.d_hat - 10880.0), 0), 2) AS profit
FROM grid g LEFT JOIN crit s ON g.k / 9999 > s.c GROUP BY g.k""")],
    ),
    ids="J5 U4 G7",
)
def q_curve_compare(spark, sf_dir):
    """The realised curve next to the curve predicted without true amounts
    (every mailed member assumed to give its predicted amount), joined on
    the integer grid index (never on the double alpha), then melted."""
    s = scored_with_crit(spark, sf_dir)
    real = pr.profit_curve(s, "crit", "target_d", U, N).select("k", "alpha", F.col("profit").alias("realised"))
    pred = pr.predicted_curve(s, "crit", "d_hat", U, N).select("k", F.col("profit").alias("predicted"))
    both = real.join(pred, "k")
    return both.unpivot(["k", "alpha"], ["realised", "predicted"], "kind", "profit")

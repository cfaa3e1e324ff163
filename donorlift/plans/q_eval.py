"""Split, weight, resampling, transform, evaluation and reshaping queries
(R1-R6, R8-R11, J1, J4, U1, U3, U4, E10, A18, V4-V10, W2-W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from donorlift.operators import evaluate as ev
from donorlift.operators import sampling as sm
from donorlift.plans.oracle_views import with_views
from donorlift.plans.registry import register
from donorlift.sources import standin as si

SEED = 42
CAMPAIGNS = list(range(si.FIRST_CAMPAIGN, si.LAST_CAMPAIGN + 1))
THRESHOLD = 0.5
U = si.UNIT_COST


def _t(spark, sf_dir):
    return si.Tables(spark, sf_dir)


# ---- splits ---------------------------------------------------------------------
_POS_SQL = """
SELECT member_id, target_b,
  ROW_NUMBER() OVER (PARTITION BY target_b ORDER BY md5(CAST(member_id AS VARCHAR) || '42'), member_id) AS pos,
  COUNT(*) OVER (PARTITION BY target_b) AS n
FROM targets"""
_SPLIT_SQL = "SELECT member_id, target_b, CASE WHEN pos <= (n + 4) // 5 THEN 'test' ELSE 'train' END AS split FROM pos"


def _split(spark, sf_dir):
    tg = si.targets(_t(spark, sf_dir)).select("member_id", "target_b")
    return sm.stratified_split(tg, "member_id", "target_b", 5, SEED)


@register("stratified_split", with_views(["targets"], "SELECT * FROM split", [("pos", _POS_SQL), ("split", _SPLIT_SQL)]), ids="R1 R2")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@register(
    "kfold",
    with_views(["targets"], "SELECT member_id, target_b, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM pos", [("pos", _POS_SQL)]),
    ids="R3",
)
def q_kfold(spark, sf_dir):
    tg = si.targets(_t(spark, sf_dir)).select("member_id", "target_b")
    return sm.stratified_folds(tg, "member_id", "target_b", 5, SEED)


@register(
    "split_disjoint",
    with_views(["targets"], """
SELECT (SELECT COUNT(*) FROM split WHERE split = 'train') AS n_train,
       (SELECT COUNT(*) FROM split WHERE split = 'test') AS n_test,
       (SELECT COUNT(*) FROM (SELECT member_id FROM split WHERE split = 'train'
                              INTERSECT SELECT member_id FROM split WHERE split = 'test')) AS n_overlap,
       (SELECT COUNT(*) FROM (SELECT member_id FROM split WHERE split = 'train'
                              UNION SELECT member_id FROM split WHERE split = 'test')) AS n_union""",
        [("pos", _POS_SQL), ("split", _SPLIT_SQL)]),
    ids="J4 U1",
)
def q_split_disjoint(spark, sf_dir):
    return sm.split_check(_split(spark, sf_dir), "member_id")


@register(
    "class_weights",
    with_views(["targets"], """
SELECT target_b, n, round(SUM(n) OVER () / (2 * n), 6) AS weight,
       round(SUM(CASE WHEN target_b = 0 THEN n END) OVER () / SUM(CASE WHEN target_b = 1 THEN n END) OVER (), 6)
         AS neg_pos_ratio
FROM (SELECT target_b, COUNT(*) AS n FROM targets GROUP BY target_b)"""),
    ids="R4",
)
def q_class_weights(spark, sf_dir):
    return sm.class_weights(si.targets(_t(spark, sf_dir)), "target_b")


@register(
    "sample_weights",
    with_views(["targets"], """
SELECT member_id, target_d,
       round((target_d - (SELECT MIN(target_d) FROM targets))
             / ((SELECT MAX(target_d) FROM targets) - (SELECT MIN(target_d) FROM targets)), 6) AS weight
FROM targets"""),
    ids="R5",
)
def q_sample_weights(spark, sf_dir):
    tg = si.targets(_t(spark, sf_dir))
    lo, hi = sm.fit_min_max(tg, "target_d")
    return tg.select("member_id", "target_d", F.round(sm.min_max_weights(tg, "target_d", lo, hi), 6).alias("weight"))


@register(
    "oversample",
    with_views(["targets"], """
SELECT member_id, target_b, CAST(1 AS INTEGER) AS copy FROM targets WHERE target_b = 0
UNION ALL
SELECT member_id, target_b, CAST(UNNEST(range(1, (c.n0 // c.n1) + (CASE WHEN pos <= c.n0 % c.n1 THEN 1 ELSE 0 END) + 1)) AS INTEGER) AS copy
FROM pos, c WHERE target_b = 1""", [("pos", _POS_SQL), ("c", """
SELECT COUNT(CASE WHEN target_b = 1 THEN 1 END) AS n1, COUNT(CASE WHEN target_b = 0 THEN 1 END) AS n0
FROM targets""")]),
    ids="R6",
)
def q_oversample(spark, sf_dir):
    tg = si.targets(_t(spark, sf_dir)).select("member_id", "target_b")
    return sm.oversample(tg, "member_id", "target_b", 1, SEED)


@register(
    "plain_split",
    with_views(["targets"], """
SELECT member_id, CASE WHEN pos <= (n + 4) // 5 THEN 'test' ELSE 'train' END AS split
FROM (SELECT member_id, ROW_NUMBER() OVER (ORDER BY md5(CAST(member_id AS VARCHAR) || '42'), member_id) AS pos, COUNT(*) OVER () AS n FROM targets)"""),
    ids="R2",
)
def q_plain_split(spark, sf_dir):
    return sm.plain_split(si.targets(_t(spark, sf_dir)).select("member_id"), "member_id", 5, 42)


@register(
    "undersample",
    with_views(["targets"], "SELECT member_id, target_b FROM pos WHERE target_b = 1 OR pos <= (SELECT COUNT(*) FROM targets WHERE target_b = 1)", [("pos", _POS_SQL)]),
    ids="R6",
)
def q_undersample(spark, sf_dir):
    return sm.undersample(si.targets(_t(spark, sf_dir)).select("member_id", "target_b"), "member_id", "target_b", 1, SEED)


# ---- power transforms -------------------------------------------------------------
def _power_sql(src: str, psi: str, jac: str) -> str:
    def stage(grid: str) -> str:
        return f"""
SELECT lam, (lam - 1) * j - n / 2.0 * ln(q / n - (s / n) * (s / n)) AS ll FROM (
  SELECT g.lam, SUM({psi}) AS s, SUM(({psi}) * ({psi})) AS q, COUNT(*) AS n, SUM({jac}) AS j
  FROM ({src}) d, ({grid}) g GROUP BY g.lam)"""
    coarse = "SELECT CAST(k AS DOUBLE) / 100 AS lam FROM range(-200, 201) t(k)"
    fine = "SELECT c.lam + CAST(k AS DOUBLE) / 10000 AS lam FROM range(-100, 101) t(k), best1 c"
    return f"""
WITH st1 AS ({stage(coarse)}),
best1 AS (SELECT lam FROM st1 ORDER BY ll DESC, lam ASC LIMIT 1),
st2 AS ({stage(fine)}),
best2 AS (SELECT lam FROM st2 ORDER BY ll DESC, lam ASC LIMIT 1)
SELECT round(best1.lam, 4) AS lambda_coarse, round(best2.lam, 4) AS lambda FROM best1, best2"""


_BC_PSI = "CASE WHEN g.lam = 0 THEN ln(d.x) ELSE (pow(d.x, g.lam) - 1) / g.lam END"
_YJ_PSI = """CASE WHEN d.x >= 0 THEN (CASE WHEN g.lam = 0 THEN ln(d.x + 1) ELSE (pow(d.x + 1, g.lam) - 1) / g.lam END)
 ELSE (CASE WHEN g.lam = 2 THEN -ln(1 - d.x) ELSE -(pow(1 - d.x, 2 - g.lam) - 1) / (2 - g.lam) END) END"""


@register(
    "boxcox_lambda",
    _power_sql(f"SELECT o_totalprice / {si.SCALE} AS x FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01 00:00:00'",
               _BC_PSI, "ln(d.x)"),
    ids="R9",
)
def q_boxcox_lambda(spark, sf_dir):
    g = si.gifts(_t(spark, sf_dir)).select((F.col("amount") / si.SCALE).alias("x"))
    c, lam = sm.fit_power_lambda(g, "x", "box-cox")
    return spark.createDataFrame([(round(c, 4), round(lam, 4))], "lambda_coarse double, lambda double")


@register(
    "yeo_johnson_lambda",
    _power_sql("SELECT c_acctbal / 1000.0 AS x FROM customer", _YJ_PSI, "sign(d.x) * ln(abs(d.x) + 1)"),
    ids="R8",
)
def q_yeo_johnson_lambda(spark, sf_dir):
    c = _t(spark, sf_dir).customer.select((F.col("c_acctbal") / 1000.0).alias("x"))
    lc, lam = sm.fit_power_lambda(c, "x", "yeo-johnson")
    return spark.createDataFrame([(round(lc, 4), round(lam, 4))], "lambda_coarse double, lambda double")


@register(
    "log_scale",
    """
SELECT c_custkey, round(sign(c_acctbal) * ln(abs(c_acctbal) + 1)
       / (SELECT MAX(abs(sign(c_acctbal) * ln(abs(c_acctbal) + 1))) FROM customer), 6) AS acctbal_scaled
FROM customer""",
    ids="R10",
)
def q_log_scale(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    e = sm.signed_log(F.col("c_acctbal"))
    m = sm.fit_max_abs(c, e)
    return c.select("c_custkey", F.round(e / F.lit(m or 1.0), 6).alias("acctbal_scaled"))


@register(
    "standardise",
    """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
       / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS acctbal_z
FROM customer""",
    ids="R11",
)
def q_standardise(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    m, s = sm.fit_moments(c, F.col("c_acctbal"))
    return c.select("c_custkey", F.round((F.col("c_acctbal") - F.lit(m)) / F.lit(s or 1.0), 6).alias("acctbal_z"))


# ---- evaluation on the rule score ----------------------------------------------------
def _scored(spark, sf_dir):
    s = si.scored(_t(spark, sf_dir))
    return s.withColumn("pred", ev.rethreshold(F.col("p"), THRESHOLD))


_PRED = ("pred", "SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored")
_CNT = ("cnt", """
SELECT COUNT(CASE WHEN target_b = 1 AND pred = 1 THEN 1 END) AS tp,
       COUNT(CASE WHEN target_b = 0 AND pred = 1 THEN 1 END) AS fp,
       COUNT(CASE WHEN target_b = 0 AND pred = 0 THEN 1 END) AS tn,
       COUNT(CASE WHEN target_b = 1 AND pred = 0 THEN 1 END) AS fn
FROM pred""")
_CURVE = ("curve", """
SELECT threshold, pos, neg,
  SUM(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  SUM(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
FROM (SELECT p AS threshold, SUM(target_b) AS pos, SUM(1 - target_b) AS neg FROM scored GROUP BY p)""")


def _r(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) END, 4)"


@register(
    "confusion",
    with_views(["scored"], """
SELECT target_b, pred, COUNT(*) AS n,
       round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY target_b), 4) AS row_share
FROM pred GROUP BY target_b, pred""", [_PRED]),
    ids="A18 V8",
)
def q_confusion(spark, sf_dir):
    return ev.confusion(_scored(spark, sf_dir), "target_b", "pred")


@register(
    "metrics",
    with_views(["scored"], f"""
SELECT tp, fp, tn, fn, {_r('tp', 'tp + fn')} AS recall, {_r('tp', 'tp + fp')} AS precision,
  {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('tn', 'tn + fp')} AS specificity,
  {_r('tn', 'tn + fn')} AS npv, {_r('fn', 'tp + fn')} AS fnr, {_r('fp', 'fp + tn')} AS fpr,
  {_r('tp + tn', 'tp + tn + fp + fn')} AS accuracy
FROM cnt""", [_PRED, _CNT]),
    ids="V4",
)
def q_metrics(spark, sf_dir):
    return ev.metrics(_scored(spark, sf_dir), "target_b", "pred")


@register(
    "class_report",
    with_views(["scored"], f"""
SELECT CAST(0 AS INTEGER) AS class, {_r('tn', 'tn + fn')} AS precision, {_r('tn', 'tn + fp')} AS recall,
       {_r('2 * tn', '2 * tn + fp + fn')} AS f1, tn + fp AS support FROM cnt
UNION ALL
SELECT CAST(1 AS INTEGER), {_r('tp', 'tp + fp')}, {_r('tp', 'tp + fn')}, {_r('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM cnt""",
        [_PRED, _CNT]),
    ids="V6",
)
def q_class_report(spark, sf_dir):
    return ev.class_report(_scored(spark, sf_dir), "target_b", "pred")


@register(
    "roc_curve",
    with_views(["scored"], """
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM curve""", [_CURVE]),
    ids="W2",
)
def q_roc_curve(spark, sf_dir):
    return ev.roc_curve(si.scored(_t(spark, sf_dir)), "target_b", "p")


@register(
    "pr_curve",
    with_views(["scored"], """
SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM curve""", [_CURVE]),
    ids="W3",
)
def q_pr_curve(spark, sf_dir):
    return ev.pr_curve(si.scored(_t(spark, sf_dir)), "target_b", "p")


@register(
    "threshold_pick",
    with_views(["scored"], """
SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM curve
ORDER BY abs(threshold - 0.5) ASC, threshold DESC LIMIT 1""", [_CURVE]),
    ids="W4",
)
def q_threshold_pick(spark, sf_dir):
    return ev.threshold_pick(ev.pr_curve(si.scored(_t(spark, sf_dir)), "target_b", "p"), THRESHOLD)


@register(
    "log_loss",
    with_views(["scored"], """
SELECT round(-avg(target_b * ln(LEAST(GREATEST(p, 1e-15), 1 - 1e-15))
                  + (1 - target_b) * ln(1 - LEAST(GREATEST(p, 1e-15), 1 - 1e-15))), 6) AS log_loss,
       round((SELECT SUM(neg * (2 * tp - pos) / 2.0) / (MAX(P) * MAX(N)) FROM curve), 6) AS auc
FROM scored""", [_CURVE]),
    ids="V5 W2",
)
def q_log_loss(spark, sf_dir):
    s = si.scored(_t(spark, sf_dir))
    ll = ev.log_loss(s, "target_b", "p")
    a = ev.auc(s, "target_b", "p").select(F.round("auc", 6).alias("auc"))
    # two one-row aggregates side by side
    return ll.unionByName(a, allowMissingColumns=True).agg(
        F.max("log_loss").alias("log_loss"), F.max("auc").alias("auc")
    )


@register(
    "r2",
    with_views(["scored"], """
SELECT COUNT(target_d) AS n,
       round(1 - SUM((target_d - d_hat) * (target_d - d_hat))
             / (SUM(target_d * target_d) - SUM(target_d) * SUM(target_d) / COUNT(target_d)), 6) AS r2
FROM scored WHERE target_b = 1 AND d_hat IS NOT NULL"""),
    ids="V7",
)
def q_r2(spark, sf_dir):
    s = si.scored(_t(spark, sf_dir)).where((F.col("target_b") == 1) & F.col("d_hat").isNotNull())
    return ev.r2(s, "target_d", "d_hat")


@register(
    "campaign_cost",
    with_views(["scored"], """
SELECT COUNT(CASE WHEN pred = 1 THEN 1 END) AS n_mailed,
  CAST(SUM(CASE WHEN target_b = 1 AND pred = 1 THEN CAST(target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)) END) AS DOUBLE) AS tp_net,
  CAST(COUNT(CASE WHEN target_b = 0 AND pred = 1 THEN 1 END) * 10880.0 AS DOUBLE) AS fp_cost,
  CAST(SUM(CASE WHEN pred = 1 THEN CAST(target_d AS DECIMAL(18,2)) - CAST(10880.0 AS DECIMAL(18,2)) END) AS DOUBLE) AS net_profit
FROM pred""", [_PRED]),
    ids="V10",
)
def q_campaign_cost(spark, sf_dir):
    return ev.campaign_cost(_scored(spark, sf_dir), "target_b", "pred", "target_d", U)


@register(
    "recall_ranking",
    with_views(["scored"], """
SELECT rule, recall, CAST(ROW_NUMBER() OVER (ORDER BY recall DESC, rule ASC) AS INTEGER) AS rank FROM (
  SELECT 'p>=' || t AS rule,
         round(CAST(COUNT(CASE WHEN target_b = 1 AND p >= CAST(t AS DOUBLE) THEN 1 END) AS DOUBLE)
               / COUNT(CASE WHEN target_b = 1 THEN 1 END), 4) AS recall
  FROM scored, (SELECT unnest(['0.3', '0.5', '0.7']) AS t) GROUP BY t)"""),
    ids="V9",
)
def q_recall_ranking(spark, sf_dir):
    s = si.scored(_t(spark, sf_dir))
    rules = ["0.3", "0.5", "0.7"]
    pos = F.col("target_b") == 1
    agg = s.agg(
        F.count_if(pos).alias("_P"),
        *[F.count_if(pos & (F.col("p") >= float(t))).alias(f"_tp{k}") for k, t in enumerate(rules)],
    )
    long = agg.select(
        F.explode(F.array(*[
            F.struct(F.lit(f"p>={t}").alias("rule"), F.round(F.col(f"_tp{k}") / F.col("_P"), 4).alias("recall"))
            for k, t in enumerate(rules)
        ])).alias("r")
    ).select("r.*")
    from pyspark.sql import Window
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.col("recall").desc(), F.col("rule"))))


# ---- reshaping --------------------------------------------------------------------
@register(
    "melt_history",
    with_views(["history"], "SELECT member_id, variable, value FROM (SELECT member_id, " + ", ".join(
        f"MAX(CASE WHEN i = {i} THEN ramnt END) AS RAMNT_{i}" for i in CAMPAIGNS
    ) + " FROM history GROUP BY member_id) UNPIVOT INCLUDE NULLS (value FOR variable IN (" + ", ".join(
        f"RAMNT_{i}" for i in CAMPAIGNS) + "))"),
    ids="U4 E10",
)
def q_melt_history(spark, sf_dir):
    w = si.history_wide(_t(spark, sf_dir)).select("member_id", *[f"RAMNT_{i}" for i in CAMPAIGNS])
    return w.unpivot(["member_id"], [f"RAMNT_{i}" for i in CAMPAIGNS], "variable", "value")


@register(
    "union_sets",
    with_views(["targets"], """
SELECT s.member_id, 'learning' AS dataset, t.target_b, t.target_d
FROM split s JOIN targets t ON s.member_id = t.member_id WHERE s.split = 'train'
UNION ALL
SELECT member_id, 'validation', NULL, NULL FROM split WHERE split = 'test'""",
        [("pos", _POS_SQL), ("split", _SPLIT_SQL)]),
    ids="U3",
)
def q_union_sets(spark, sf_dir):
    tg = si.targets(_t(spark, sf_dir))
    sp = sm.stratified_split(tg, "member_id", "target_b", 5, SEED)
    learn = sp.where(F.col("split") == "train").select("member_id", F.lit("learning").alias("dataset"), "target_b", "target_d")
    valid = sp.where(F.col("split") == "test").select("member_id", F.lit("validation").alias("dataset"))
    return learn.unionByName(valid, allowMissingColumns=True)


@register(
    "attach_targets",
    with_views(["members", "targets"], """
SELECT m.member_id, m.segment, m.nation, m.acctbal, t.target_b, t.target_d
FROM members m JOIN targets t ON m.member_id = t.member_id"""),
    ids="J1 S2 P6",
)
def q_attach_targets(spark, sf_dir):
    t = _t(spark, sf_dir)
    return si.members(t).join(si.targets(t), "member_id", "inner").select(
        "member_id", "segment", "nation", "acctbal", "target_b", "target_d"
    )

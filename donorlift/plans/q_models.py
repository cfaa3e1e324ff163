"""Model, selection, search and persistence queries (rows-only checks)
and the streaming re-aims (T2-T5 with batch-equal SQL twins)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from donorlift.operators import encode as en
from donorlift.operators import features as fe
from donorlift.operators import models as md
from donorlift.operators import profit as pr
from donorlift.operators import sampling as sm
from donorlift.operators import segments as sg
from donorlift.operators.ordering import not_broadcast
from donorlift.plans.oracle_views import REF_MONTH, month_idx, with_views
from donorlift.plans.q_encode import _MTD_WIDE_SQL, MTD_COLS, _mtd_wide
from donorlift.plans.q_giving import GIVING_CTES, PROMOTION_SQL
from donorlift.plans.registry import register
from donorlift.session import ensure_checkpoint_dir, shuffled_by_rows
from donorlift.sources import standin as si
from donorlift.sources.files import StageStore
from donorlift.streaming import gifts as st

REF = si.REF
#: Orders of one task of the model table, about.
TASK_ORDERS = 100_000


def _build_features(spark, sf_dir):
    t = si.Tables(spark, sf_dir)
    g = si.gifts(t)
    first = g.groupBy("member_id").agg(F.min("gift_date").alias("first_date"))
    members = si.members(t)
    df, _ = fe.member_features(
        members, sg.giving_summary(g, REF), sg.promotion_summary(si.history(t), first, REF),
        si.targets(t), REF, si.SCALE, en.fit_one_hot(members, "segment"),
    )
    return md.with_class_weight(df, "target_b")


def _files_of(spark, sf_dir, *names) -> str:
    """A digest of the tables' files: path, size and time of each."""
    at = "hex(sum(xxhash64(file_path, file_size, file_modification_time) & 281474976710655))"
    tables = [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").select("_metadata.*").select("file_path", "file_size", "file_modification_time") for n in names]
    files = tables[0]
    for f in tables[1:]:
        files = files.unionByName(f)
    return files.distinct().selectExpr(f"{at} AS digest").first().digest


def feature_frame(spark, sf_dir) -> md.FeatureFrame:
    """The model table.  Every learner reads it many times (trees, folds,
    rounds), and many queries use it: it is a stored stage (S6), built once per
    application and state of the tables' files."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/donorlift-{spark.sparkContext.applicationId}"
    store = StageStore(spark, root)
    name = f"features-{_files_of(spark, sf_dir, 'customer', 'orders', 'nation', 'region')}"
    # a task sorts and joins all that its members did: the number of tasks grows with the orders
    with shuffled_by_rows(spark, si.Tables(spark, sf_dir).orders.count(), TASK_ORDERS):
        df = store.provide(name, [name], {name: lambda _: _build_features(spark, sf_dir)})
    names = [c for c in df.columns if c not in ("member_id", "target_b", "target_d", "w")]
    return md.assemble(df, names, "member_id")


SEGMENT_NAMES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NUMBERS = ["acctbal", "n_gifts", "total_amount", "mean_gift", "last_gift", "months_since_last", "timelag", "n_promotions", "n_responses"]
FEATURES = [*NUMBERS, *[f"seg_{s}" for s in SEGMENT_NAMES]]
# the model table in SQL, written from the definitions of ``member_features``
_FEATURE_CTES = [*GIVING_CTES, ("promo", PROMOTION_SQL), ("feat", f"""
SELECT m.member_id, target_b, target_d, acctbal / 1000.0::DOUBLE AS acctbal, COALESCE(CAST(ngiftall AS DOUBLE), 0) AS n_gifts,
  COALESCE(ramntall / 16000.0::DOUBLE, 0) AS total_amount, COALESCE(avggift / 16000.0::DOUBLE, 0) AS mean_gift,
  COALESCE(lastgift / 16000.0::DOUBLE, 0) AS last_gift, COALESCE(CAST({REF_MONTH} - {month_idx('lastdate')} AS DOUBLE), 99) AS months_since_last,
  COALESCE(CAST({month_idx('nextdate')} - {month_idx('fistdate')} AS DOUBLE), 0) AS timelag,
  COALESCE(CAST(numprom AS DOUBLE), 0) AS n_promotions, COALESCE(CAST(n_responses AS DOUBLE), 0) AS n_responses,
  """ + ", ".join(f"CAST(COALESCE(segment = '{s}', false) AS INTEGER)::DOUBLE AS seg_{s}" for s in SEGMENT_NAMES) + """
FROM members m JOIN targets USING (member_id) LEFT JOIN gs USING (member_id) LEFT JOIN promo USING (member_id)""")]
_FEATURE_VIEWS = ["members", "targets", "gifts", "history"]


@register("member_features", with_views(_FEATURE_VIEWS, "SELECT member_id, target_b, target_d, " + ", ".join(FEATURES) + " FROM feat", _FEATURE_CTES), ids="X3 E7 A22 A23")
def q_member_features(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    return ff.df.select("member_id", "target_b", "target_d", *ff.names)


@register("fit_ols_one", with_views(_FEATURE_VIEWS, """
SELECT round(regr_slope(target_d / 16000.0, total_amount), 6) AS slope, round(regr_intercept(target_d / 16000.0, total_amount), 6) AS intercept
FROM feat WHERE target_b = 1""", _FEATURE_CTES), ids="M8")
def q_fit_ols_one(spark, sf_dir):
    """The elastic-net regressor without a penalty, on one column."""
    ff = feature_frame(spark, sf_dir)
    m = md.fit_enet(md.assemble(ff.df.drop("features"), ["total_amount"], "member_id"), scale=si.SCALE, reg=0.0)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))], "slope double, intercept double")


@register("fit_logit", None, ids="M3 M11")
def q_fit_logit(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    m = md.logit().fit(ff.df)
    return m.transform(ff.df).select("member_id", F.round(md.prob1(), 6).alias("p"),
                                     F.col("prediction").cast("int").alias("pred"))


@register("coef_table", None, ids="M10 P9 K2 X6")
def q_coef_table(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    names = md.feature_names(ff.df)  # from the vector's metadata
    return md.coef_table(md.logit().fit(ff.df), names, spark)


@register("fit_forest_amount", None, ids="M7 R9 G7")
def q_fit_forest_amount(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    am = md.fit_amount_forest(ff, scale=si.SCALE)
    s = am.transformed(ff.df)
    return s.select("member_id", F.round("d_t", 6).alias("d_t"),
                    F.round(am.amount(F.col("d_t")) * si.SCALE, 2).alias("amount_pred"))


@register("feature_importance", None, ids="A17 K3 M1")
def q_feature_importance(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    return md.ranked_importances(md.forest_importances(ff.df, md.forest_classifier()), ff.names, spark, top=50)


@register("fit_enet", None, ids="M8")
def q_fit_enet(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    m = md.fit_enet(ff, scale=si.SCALE)
    return m.transform(ff.df).select("member_id", F.round(F.col("prediction") * si.SCALE, 2).alias("amount_pred"))


@register("two_stage_profit", None, ids="G1 G2 G5 G6 G9 M3 M7 R9 X4")
def q_two_stage_profit(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    est = md.fit_profit_estimator(ff, si.UNIT_COST, si.SCALE, classifier=md.logit(), regressor=None)
    scored = est.score(ff)
    scored = scored.withColumn("amount_pred", est.amount.amount(F.col("d_t")) * si.SCALE)
    return pr.mailing_summary(scored, "crit", "target_d", "amount_pred", si.UNIT_COST, est.kstar)


@register("vote", None, ids="M6 M2")
def q_vote(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    return md.vote(ff.df, md.logit().fit(ff.df), md.gbt().fit(ff.df), "member_id")


@register("gbt_scores", None, ids="M2")
def q_gbt_scores(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    return md.gbt().fit(ff.df).transform(ff.df).select("member_id", F.round(md.prob1(), 6).alias("p"))


@register("mlp_scores", None, ids="M4")
def q_mlp_scores(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    m = md.mlp(len(ff.names)).fit(ff.df)
    return m.transform(ff.df).select("member_id", F.round(md.prob1(), 6).alias("p"))


@register("linear_svc_scores", None, ids="M5 R3")
def q_linear_svc_scores(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    folds = sm.stratified_folds(ff.df.select("member_id", "target_b"), "member_id", "target_b", 5, 42)
    sub = ff.df.join(not_broadcast(folds.where("fold = 4").select("member_id"), ff.df.count()), "member_id", "left_semi")
    m = md.linear_svc().fit(sub)
    return m.transform(ff.df).select("member_id", F.col("prediction").cast("int").alias("pred"))


@register("bayes_ridge", None, ids="M9")
def q_bayes_ridge(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    donors = ff.df.where("target_b = 1").withColumn("y", F.col("target_d") / si.SCALE)
    r = md.bayes_ridge(donors, ff.names, "y")
    rows = [(k, float(v)) for k, v in r["coef"].items()] + [("(intercept)", float(r["intercept"]))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@register("pca_95", None, ids="F3 W1 R11")
def q_pca_95(spark, sf_dir):
    return md.pca_variance(si.Tables(spark, sf_dir).embeddings, "embedding", 0.95)


@register("pca_check", """
SELECT MAX(len(embedding)) AS components, 1.0::DOUBLE AS total, true AS falling, true AS least_k FROM embeddings""", ids="F3 W1")
def q_pca_check(spark, sf_dir):
    """Identities of the variance table: as many components as dimensions,
    shares that fall and add up to one, and the least k that reaches 95 %."""
    v = md.pca_variance(si.Tables(spark, sf_dir).embeddings, "embedding", 0.95)
    pairs = v.alias("a").join(v.alias("b"), F.col("b.k") == F.col("a.k") + 1, "left")
    return pairs.agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("a.variance"), 6).alias("total"),
                     (F.count_if(F.col("b.variance") > F.col("a.variance") + 1e-9) == 0).alias("falling"),
                     (F.min(F.when(F.col("a.cumulative") >= 0.95 - 1e-12, F.col("a.k"))) == F.max(F.when(F.col("a.selected"), F.col("a.k")))).alias("least_k"))


@register("select_from_model", None, ids="F4 F2 F5 M1")
def q_select_from_model(spark, sf_dir):
    return md.select_from_model(feature_frame(spark, sf_dir))


@register("boruta", None, ids="F1 F5")
def q_boruta(spark, sf_dir):
    return md.boruta(feature_frame(spark, sf_dir))


@register("random_search", None, ids="V1 V2 V3")
def q_random_search(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    folds = sm.stratified_folds(ff.df.select("member_id", "target_b"), "member_id", "target_b", 10, 42)
    return md.random_search(ff, folds)


@register("impute_iterative", None, ids="I4")
def q_impute_iterative(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    wide = _mtd_wide(spark, sf_dir).checkpoint(eager=True)  # read by the medians, the counts and the first fill
    med = en.fit_medians(wide, MTD_COLS)
    return md.impute_iterative(wide, "member_id", MTD_COLS, medians=med)


@register("pipeline_roundtrip", "SELECT COUNT(*) AS n_scored, CAST(0 AS BIGINT) AS n_different, CAST(0 AS BIGINT) AS n_out_of_range FROM customer", ids="S4 S5 S6 S7 S8 X1 X2")
def q_pipeline_roundtrip(spark, sf_dir):
    """Fit a scaler + logit pipeline, store it, load it back, apply it; the
    stage table is written to and read back from the shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid

    root = f"{base}/stage-{uuid.uuid4().hex}"
    ff = feature_frame(spark, sf_dir)
    ff.df.drop("features").write.mode("overwrite").parquet(f"{root}/numeric")
    stage = spark.read.parquet(f"{root}/numeric")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=ff.names, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        md.logit(),
    ])
    model = pipe.fit(stage)
    md.save_pipeline(model, f"{root}/model")
    loaded = md.load_pipeline(f"{root}/model")
    p = md.prob1()
    both = model.transform(stage).select("member_id", p.alias("a")).join(loaded.transform(stage).select("member_id", p.alias("b")), "member_id")
    return both.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("a") != F.col("b")).alias("n_different"),
                    F.count_if(~F.col("b").between(0, 1)).alias("n_out_of_range"))


# ---- streaming --------------------------------------------------------------------
@register(
    "stream_gift_windows",
    """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       user_id, COUNT(*) AS n_gifts, round(SUM(value), 2) AS amount
FROM events WHERE event_type = 'purchase'
GROUP BY date_trunc('day', ts), user_id
HAVING date_trunc('day', ts) + INTERVAL 1 DAY
       <= (SELECT MAX(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 2 DAY""",
    ids="T2",
)
def q_stream_gift_windows(spark, sf_dir):
    return st.gift_windows(spark, sf_dir)


@register(
    "stream_gift_sliding",
    """
SELECT w AS window_start, w + INTERVAL 7 DAY AS window_end, user_id, COUNT(*) AS n_gifts, round(SUM(value), 2) AS amount
FROM (SELECT user_id, value, date_trunc('day', ts) - to_days(CAST(unnest(generate_series(0, 6)) AS INTEGER)) AS w
      FROM events WHERE event_type = 'purchase')
GROUP BY w, user_id
HAVING w + INTERVAL 7 DAY <= (SELECT MAX(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 2 DAY""",
    ids="T2",
)
def q_stream_gift_sliding(spark, sf_dir):
    return st.gift_windows(spark, sf_dir, "7 days", "2 days", "1 day")


@register(
    "stream_gift_months",
    """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, user_id, COUNT(*) AS n_gifts, round(SUM(value), 2) AS amount
FROM events WHERE event_type = 'purchase' GROUP BY ALL""",
    ids="T2",
)
def q_stream_gift_months(spark, sf_dir):
    return st.gift_months(spark, sf_dir)


@register(
    "stream_rfa",
    """
SELECT user_id, MAX(ts) AS last_gift_ts, COUNT(*) AS frequency, round(SUM(value), 2) AS amount
FROM events WHERE event_type = 'purchase' GROUP BY user_id""",
    ids="T3 A14",
)
def q_stream_rfa(spark, sf_dir):
    return st.running_rfa(spark, sf_dir)


@register(
    "stream_responses",
    """
SELECT m.event_id AS mailing_id, g.event_id AS gift_id, m.user_id, m.ts AS mailed_ts, g.ts AS gift_ts
FROM events m JOIN events g
  ON m.user_id = g.user_id AND g.ts >= m.ts AND g.ts <= m.ts + INTERVAL 1 DAY
WHERE m.event_type = 'view' AND g.event_type = 'purchase'""",
    ids="T4 E2",
)
def q_stream_responses(spark, sf_dir):
    return st.responses_to_mailings(spark, sf_dir)


@register(
    "stream_dedup",
    "SELECT event_id, min(user_id) AS user_id, min(event_type) AS event_type, min(value) AS value FROM events GROUP BY event_id",
    ids="T5",
)
def q_stream_dedup(spark, sf_dir):
    return st.dedup_gifts(spark, sf_dir)


@register("stream_score", "SELECT COUNT(*) AS n_scored, CAST(0 AS BIGINT) AS n_different FROM customer", ids="T1 S7")
def q_stream_score(spark, sf_dir):
    ff = feature_frame(spark, sf_dir)
    pipe = Pipeline(stages=[md.logit()])
    model = pipe.fit(ff.df)
    feats = ff.df.select("member_id", "features")
    streamed = st.score_stream(spark, sf_dir, model, feats, "member_id")
    batch = model.transform(ff.df).select("member_id", md.prob1().alias("b"))
    both = streamed.join(batch, "member_id", "full")
    return both.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(~F.col("p").eqNullSafe(F.col("b"))).alias("n_different"))


# ---- neighbours (R7, I5) ------------------------------------------------------------
@register("smote", None, ids="R7")
def q_smote(spark, sf_dir):
    from donorlift.operators.neighbors import borderline_smote

    ff = feature_frame(spark, sf_dir)
    return borderline_smote(ff.df.select("member_id", "target_b", *ff.names), "member_id", "target_b",
                            ff.names, ratio=0.5, m=10, k=5)


@register("smote_count", with_views(["targets"], """
SELECT CAST(CAST(floor(0.5 * COUNT(CASE WHEN target_b = 0 THEN 1 END)) AS BIGINT) - COUNT(CASE WHEN target_b = 1 THEN 1 END) AS BIGINT) AS n_rows,
  CAST(0 AS BIGINT) AS n_off_segment, CAST(0 AS BIGINT) AS n_not_minority FROM targets"""), ids="R7")
def q_smote_count(spark, sf_dir):
    """Exactly the rows that the ratio needs, each on a segment between two
    minority rows."""
    ff = feature_frame(spark, sf_dir)
    syn = q_smote(spark, sf_dir)
    rows = ff.df.select("member_id", "target_b", *ff.names)
    other = rows.select(F.col("member_id").alias("nn"), F.col("target_b").alias("nb"), *[F.col(c).alias(f"n_{c}") for c in ff.names])
    base = rows.select("member_id", F.col("target_b").alias("bb"), *[F.col(c).alias(f"b_{c}") for c in ff.names])
    n = rows.count()
    j = syn.join(not_broadcast(base, n), "member_id", "left").join(not_broadcast(other, n), "nn", "left")
    between = [F.col(c).between(F.least(f"b_{c}", f"n_{c}") - 1e-9, F.greatest(f"b_{c}", f"n_{c}") + 1e-9) for c in ff.names]
    inside = between[0]
    for b in between[1:]:
        inside = inside & b
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~inside).alias("n_off_segment"),
                 F.count_if((F.col("bb") != 1) | (F.col("nb") != 1)).alias("n_not_minority"))


_KNN_SQL = with_views(_FEATURE_VIEWS, "SELECT w.member_id, " + ", ".join(
    f"round(COALESCE(CAST(w.{c} AS DOUBLE), f.{c}), 6) AS {c}" for c in MTD_COLS) + " FROM wide w LEFT JOIN fill f ON f.q = w.member_id", [
    *_FEATURE_CTES, ("wide", _MTD_WIDE_SQL),
    ("dist", "SELECT a.member_id AS q, b.member_id AS r, " + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURES) + " AS d2 FROM feat a JOIN feat b ON a.member_id <> b.member_id"),
    ("near", "SELECT q, r FROM (SELECT q, r, ROW_NUMBER() OVER (PARTITION BY q ORDER BY d2, r) AS k FROM dist) WHERE k <= 5"),
    ("fill", "SELECT q, " + ", ".join(f"AVG(CAST(w.{c} AS DOUBLE)) AS {c}" for c in MTD_COLS) + " FROM near JOIN wide w ON w.member_id = r GROUP BY q")])


@register("impute_knn", _KNN_SQL, ids="I5")
def q_impute_knn(spark, sf_dir):
    from donorlift.operators.neighbors import knn_impute

    ff = feature_frame(spark, sf_dir)
    wide = _mtd_wide(spark, sf_dir)
    tab = ff.df.select("member_id", *ff.names).join(not_broadcast(wide, ff.df.count()), "member_id", "left")
    return knn_impute(tab, "member_id", ff.names, MTD_COLS, k=5, max_missing_share=1.0)


@register("model_registry", None, ids="S8 V9 V5")
def q_model_registry(spark, sf_dir):
    """Fit two classifiers on the learning split, score AUC on the hold-out,
    record both; a model is stored only when it improves on the best."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    import uuid

    ff = feature_frame(spark, sf_dir)
    split = sm.stratified_split(ff.df.select("member_id", "target_b"), "member_id", "target_b")
    n = ff.df.count()
    learn = ff.df.join(not_broadcast(split.where("split = 'train'").select("member_id"), n), "member_id", "left_semi")
    hold = ff.df.join(not_broadcast(split.where("split = 'test'").select("member_id"), n), "member_id", "left_semi")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    ev = BinaryClassificationEvaluator(labelCol="target_b", metricName="areaUnderROC")
    res = None
    for name, est in (("logit", md.logit()), ("gbt", md.gbt())):
        m = est.fit(learn)
        res = md.record_result(root, spark, name, str(est.extractParamMap().get(est.maxIter)), "auc",
                               ev.evaluate(m.transform(hold)), m)
    return md.best_model(res, "auc")

"""Models, feature selection, model search and the two-stage profit
estimator (M1-M11, G1, A17, F1-F5, V1-V3, I4, S7, S8).

All learners are MLlib estimators; the feature table is assembled once into
a vector column.  Only model-sized objects (coefficients, importances,
per-grid-point metrics) ever reach the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlift.operators import profit as pr
from donorlift.operators import sampling as sm
from donorlift.operators.ordering import not_broadcast
from donorlift.session import ensure_checkpoint_dir


@dataclass
class FeatureFrame:
    df: DataFrame           # key, label columns, feature columns, "features"
    names: list[str]
    key: str


def assemble(df: DataFrame, names: Sequence[str], key: str) -> FeatureFrame:
    va = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")
    return FeatureFrame(va.transform(df), list(names), key)


def with_class_weight(df: DataFrame, label: str, col: str = "w") -> DataFrame:
    """R4 'balanced': n / (2 n_c) per class, learned from one small agg."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    expr = F.lit(None).cast("double")
    for c, k in counts.items():
        expr = F.when(F.col(label) == c, F.lit(n / (2.0 * k))).otherwise(expr)
    return df.withColumn(col, expr)


def prob1(col: str = "probability"):
    """Probability of class 1, JVM-side."""
    return vector_to_array(col)[1]


# ---- classifiers (M1-M6) --------------------------------------------------------
def logit(label: str = "target_b", reg: float = 0.01, enet: float = 0.5) -> LogisticRegression:
    """M3: elastic-net logistic regression with class weights."""
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="w",
                              regParam=reg, elasticNetParam=enet, maxIter=50, standardization=True)


# Sizes of the reference's learners; a caller may pass others.
SELECTION_TREES, REGRESSION_TREES, CLASSIFIER_TREES = 500, 500, 1500


def forest_classifier(label: str = "target_b", trees: int = CLASSIFIER_TREES, depth: int = 3, seed: int = 42):
    """M1: random forest classifier with class weights."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="w",
                                  numTrees=trees, maxDepth=depth, seed=seed)


def gbt(label: str = "target_b", iters: int = 20, depth: int = 3, seed: int = 42):
    """M2: gradient-boosted trees."""
    return GBTClassifier(featuresCol="features", labelCol=label, weightCol="w",
                         maxIter=iters, maxDepth=depth, seed=seed)


def mlp(n_features: int, label: str = "target_b", seed: int = 42):
    """M4: multilayer perceptron on standardised features."""
    scaler = StandardScaler(inputCol="features", outputCol="zfeatures", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(featuresCol="zfeatures", labelCol=label,
                                         layers=[n_features, 8, 2], maxIter=100, seed=seed)
    return Pipeline(stages=[scaler, net])


def linear_svc(label: str = "target_b"):
    """M5 (re-aim of the kernel SVC): linear max-margin classifier."""
    return LinearSVC(featuresCol="features", labelCol=label, weightCol="w", regParam=0.01, maxIter=50)


def vote(df: DataFrame, a, b, key: str) -> DataFrame:
    """M6: majority vote of two fitted classifiers, both applied to one table
    without a join; a tie (1 vs 0) counts as 0."""
    outputs = ["rawPrediction", "probability", "prediction"]
    first = a.transform(df).withColumn("_pa", F.col("prediction")).drop(*outputs)
    return b.transform(first).select(key, ((F.col("_pa") + F.col("prediction")) >= 2).cast("int").alias("vote"))


def coef_table(model, names: Sequence[str], spark) -> DataFrame:
    """Non-zero coefficients, largest absolute value first."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    df = spark.createDataFrame(rows + [("(intercept)", float(model.intercept))], "feature string, coefficient double")
    return df.where("coefficient <> 0").orderBy(F.abs("coefficient").desc(), "feature")


def importance_table(model, names: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Feature importances of a forest, ordered, optionally top k."""
    return ranked_importances(model.featureImportances.toArray(), names, spark, top)


def ranked_importances(importances: Sequence[float], names: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Given importances, ordered, optionally top k."""
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, importances)], "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), "feature")
    df = df.withColumn("rank", F.row_number().over(w))
    return df.where(F.col("rank") <= top) if top else df


#: Rows above which the forest of an importance table is grown in parts; below,
#: the parts' jobs cost more than they spare.
PART_ROWS = 50_000
#: Trees of a part, at most, and parts grown at the same time.
PART_TREES, PARTS_AT_ONCE = 50, 8


def forest_importances(df: DataFrame, forest: RandomForestClassifier) -> list[float]:
    """Importances of the forest's trees on average, adding up to one.

    A forest's pass holds the statistics of all its trees' nodes in every task,
    and a count per tree with every row; with hundreds of trees these leave the
    processor's caches, and the rows the executors' memory.  The trees of a forest
    do not depend on each other: on a large table they are grown as forests of at
    most PART_TREES, each with draws of its own, some at a time, so that the cores
    stay busy when a table has few or uneven tasks."""
    import numpy as np

    trees, seed = forest.getNumTrees(), forest.getSeed()
    parts = -(-trees // PART_TREES) if df.count() > PART_ROWS else 1

    def grow(k: int):
        some = trees * (k + 1) // parts - trees * k // parts
        part = forest.copy({forest.numTrees: some, forest.seed: seed + 1_000_003 * k})
        # a tree's importances add up to one, or to zero without a split
        return np.sum([t.featureImportances.toArray() for t in part.fit(df).trees], axis=0)

    with ThreadPool(min(parts, PARTS_AT_ONCE)) as pool:
        total = np.sum(pool.map(grow, range(parts), chunksize=1), axis=0)
    return (total / (total.sum() or 1.0)).tolist()


# ---- regressors (M7-M9) ----------------------------------------------------------
@dataclass
class AmountModel:
    lam: float
    mean: float
    std: float
    model: object

    def transformed(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumnRenamed("prediction", "d_t")

    def amount(self, d_t):
        return sm.inverse_box_cox(d_t, self.lam, self.mean, self.std)

    def unit_cost_t(self, u: float) -> float:
        t = math.log(u) if self.lam == 0 else (u ** self.lam - 1) / self.lam
        return (t - self.mean) / self.std


def fit_amount_forest(ff: FeatureFrame, amount: str = "target_d", label: str = "target_b",
                      scale: float = 1.0, trees: int = REGRESSION_TREES, depth: int = 6, seed: int = 42,
                      regressor=None) -> AmountModel:
    """M7 + R9: Box-Cox (lambda by likelihood), standardise, then a regressor
    on donors (a random forest unless another MLlib regressor is given, X4)."""
    donors = ff.df.where(F.col(label) == 1).withColumn("_y", F.col(amount) / F.lit(scale))
    _, lam = sm.fit_power_lambda(donors, "_y", "box-cox")
    t = sm.power_transform(F.col("_y"), lam, "box-cox")
    mean, std = sm.fit_moments(donors, t)
    donors = donors.withColumn("_yt", (t - F.lit(mean)) / F.lit(std))
    if regressor is None:
        regressor = RandomForestRegressor(featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    reg = regressor.copy().setLabelCol("_yt").setFeaturesCol("features")
    return AmountModel(lam, mean, std, reg.fit(donors))


def fit_enet(ff: FeatureFrame, amount: str = "target_d", label: str = "target_b", scale: float = 1.0, reg: float = 0.01):
    """M8: elastic-net linear regression on donors."""
    donors = ff.df.where(F.col(label) == 1).withColumn("_y", F.col(amount) / F.lit(scale))
    lr = LinearRegression(featuresCol="features", labelCol="_y", regParam=reg, elasticNetParam=0.5, maxIter=50)
    return lr.fit(donors)


def bayes_ridge(df: DataFrame, names: Sequence[str], y: str, iters: int = 300, tol: float = 1e-6) -> dict:
    """M9: Bayesian ridge regression.  The centred products of columns and
    target are one distributed sum of matrices; the evidence iteration
    (MacKay updates) runs on that small matrix on the driver."""
    import numpy as np

    from donorlift.operators.gram import scatter

    p = len(names)
    got = scatter(df, [*names, y])
    n, mx, my = got.n, got.mean[:p], float(got.mean[p])
    xx_c, xy_c, yy_c = got.products[:p, :p], got.products[:p, p], float(got.products[p, p])
    alpha, lam = 1.0 / max(yy_c / n, 1e-12), 1.0
    eig, vec = np.linalg.eigh(xx_c)
    eig = np.clip(eig, 0, None)
    coef = np.zeros(p)
    for _ in range(iters):
        a = lam / alpha
        coef_new = vec @ ((vec.T @ xy_c) / (eig + a))
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        rss = yy_c - 2 * coef_new @ xy_c + coef_new @ xx_c @ coef_new
        lam = gamma / max(float(coef_new @ coef_new), 1e-12)
        alpha = (n - gamma) / max(float(rss), 1e-12)
        if np.max(np.abs(coef_new - coef)) < tol:
            coef = coef_new
            break
        coef = coef_new
    intercept = my - float(mx @ coef)
    return {"coef": dict(zip(names, coef.tolist())), "intercept": intercept, "alpha": alpha, "lambda": lam}


# ---- the two-stage estimator (G1) -------------------------------------------------
@dataclass
class ProfitEstimator:
    classifier: object
    amount: AmountModel
    u_t: float
    kstar: int
    n_grid: int

    def score(self, ff: FeatureFrame) -> DataFrame:
        s = self.classifier.transform(ff.df).withColumn("p", prob1()).drop("rawPrediction", "probability", "prediction")
        s = self.amount.transformed(s)
        return s.withColumn("crit", pr.critical_alpha(F.col("p"), F.col("d_t"), self.u_t))


def fit_profit_estimator(ff: FeatureFrame, unit_cost: float, scale: float, n_grid: int = pr.DEFAULT_GRID,
                         label: str = "target_b", amount: str = "target_d",
                         classifier=None, regressor=None) -> ProfitEstimator:
    """G1: classifier (M3 unless given), Box-Cox + regressor on donors (R9,
    M7 unless given; X4: both are pluggable MLlib estimators, the classifier
    may also be already fitted), then alpha* from the one-pass profit curve
    of the learning data (G4, G5).  Q13: the indicator compares exp of
    *standardised* Box-Cox values."""
    if classifier is None:
        clf = logit(label).fit(ff.df)
    elif isinstance(classifier, Model):
        clf = classifier  # already fitted: used as is
    else:
        clf = classifier.fit(ff.df)
    am = fit_amount_forest(ff, amount, label, scale, regressor=regressor)
    u_t = am.unit_cost_t(unit_cost / scale)
    est = ProfitEstimator(clf, am, u_t, 0, n_grid)
    scored = est.score(ff)
    curve = pr.profit_curve(scored, "crit", amount, unit_cost, n_grid)
    est.kstar = pr.fit_alpha_star(curve)
    return est


# ---- selection and reduction (F1-F5) ------------------------------------------------
def pca_variance(df: DataFrame, array_col: str, share: float = 0.95) -> DataFrame:
    """F3 + W1: standardise, PCA, cumulative explained variance, and the
    smallest k reaching ``share`` (Spark's PCA takes k, the share picks it)."""
    v = df.select(array_to_vector(F.col(array_col)).alias("v"))
    dim = len(df.select(array_col).first()[0])
    sc = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(v)
    z = sc.transform(v)
    model = PCA(k=dim, inputCol="z", outputCol="pc").fit(z)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    spark = df.sparkSession
    t = spark.createDataFrame([(i + 1, e) for i, e in enumerate(ev)], "k int, variance double")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cumulative", F.sum("variance").over(w))
    kmin = t.where(F.col("cumulative") >= share - 1e-12).agg(F.min("k")).first()[0]
    return t.withColumn("selected", F.col("k") <= F.lit(kmin))


def select_from_model(ff: FeatureFrame, label: str = "target_b", trees: int = SELECTION_TREES) -> DataFrame:
    """keep features whose forest importance is at least the mean."""
    imp = ranked_importances(forest_importances(ff.df, forest_classifier(label, trees=trees, depth=6)), ff.names, ff.df.sparkSession)
    mean = 1.0 / len(ff.names)  # importances sum to one
    return imp.withColumn("selected", F.col("importance") >= F.lit(mean))


#: Rounds of a Boruta selection with the same columns; as many of them as the
#: executors' memory holds are fitted at the same time.
ROUNDS_AT_ONCE = 8


def fits_at_once(spark, fit_bytes: int, most: int) -> int:
    """Fits whose cached rows lie in the executors' storage memory together: 1 to ``most``."""
    sc = spark.sparkContext
    driver = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId().hostPort()
    status = sc._jsc.sc().getExecutorMemoryStatus()  # host and port: (bytes, bytes left)
    room, at = {}, status.iterator()
    while at.hasNext():
        one = at.next()
        room[one._1()] = one._2()._1()
    others = sum(v for k, v in room.items() if k != driver) or sum(room.values())
    return max(1, min(most, others // max(fit_bytes, 1)))


def _binom_sf(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


def auto_trees(n_columns: int, depth: int) -> int:
    """Trees of a Boruta round for so many columns and their shadows: enough
    that each is tried some hundred times."""
    return max(10, int(100 * math.sqrt(2 * n_columns) / depth))


def _passed(p_values: dict[str, float], alpha: float, rounds: int) -> set[str]:
    """Columns whose p-values hold among the columns (Benjamini and Hochberg)
    and over the rounds made so far (Bonferroni)."""
    order = sorted(p_values, key=p_values.get)
    last = max((i + 1 for i, c in enumerate(order) if p_values[c] <= alpha * (i + 1) / len(order)), default=0)
    return {c for c in order[:last] if p_values[c] <= alpha / rounds}


def shadowed(df: DataFrame, key: str, label: str, names: Sequence[str], seed: int) -> DataFrame:
    """(label, w, x): each row's ``names`` and, after them, shadows of these,
    each shadow column permuted on its own among the rows of a batch.  Rows
    must lie in random order; then a shadow has its column's values and nothing
    to do with the label, and nothing is joined or shuffled."""
    import numpy as np
    import pyarrow as pa

    p, kind = len(names), df.schema[label].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            both = np.hstack([x, np.column_stack([rng.permutation(x[:, i]) for i in range(p)])])
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, 2 * p), pa.int32()), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), held], [label, "w", "x"])

    rows = df.select(label, "w", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, f"{label} {kind}, w double, x array<double>").select(label, "w", array_to_vector("x").alias("features"))


def boruta(ff: FeatureFrame, label: str = "target_b", max_rounds: int = 120, trees: int | None = None,
           alpha: float = 0.05, seed: int = 42, perc: float = 100.0, depth: int = 6) -> DataFrame:
    """all-relevant selection.  The rows are put in random order once; in
    each round every open or confirmed column gets a shadow with its values
    permuted, a forest is fitted (``trees``, by default from the number of
    columns and the depth) and a column scores a hit when its importance is
    above the ``perc`` percentile of the shadows' (100: the greatest).
    Binomial tests on the hits, corrected for the number of columns and rounds,
    decide confirmed or rejected; rejected columns leave, and the rounds end when
    every column is decided or at ``max_rounds``, which leaves the rest
    tentative.  ``rank``: 1 confirmed, 2 tentative, then rejected ones, the
    last rejected first (F5)."""
    import numpy as np

    spark = ff.df.sparkSession
    ensure_checkpoint_dir(spark)
    key, names = ff.key, list(ff.names)
    mixed = ff.df.select(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))).alias("_h"), label, "w", *names)
    base = mixed.repartition("_h").sortWithinPartitions("_h").checkpoint(eager=True)
    n = base.count()
    hits = dict.fromkeys(names, 0)
    rounds = dict.fromkeys(names, 0)
    decision = dict.fromkeys(names, "tentative")
    left_at: dict[str, int] = {}

    def forest(r: int, alive: list[str]) -> list[float]:
        size = trees or auto_trees(len(alive), depth)
        # a fit reads its rows several times: the shadows are made once, on disk, which leaves the memory to the fits
        tab = shadowed(base, key, label, alive, seed + r).persist(StorageLevel.DISK_ONLY)
        try:
            m = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="w", numTrees=size, maxDepth=depth, seed=seed + r).fit(tab)
        finally:
            tab.unpersist()
        return m.featureImportances.toArray()

    def forests(some: Sequence[int], alive: list[str]):
        """(round, importances) in order, as many rounds at a time as the memory holds."""
        row_bytes = 100 + 4 * (2 * len(alive) + (trees or auto_trees(len(alive), depth)))  # bins, and a count per tree
        at_once = fits_at_once(spark, n * row_bytes, ROUNDS_AT_ONCE)
        for at in range(0, len(some), at_once):
            part = some[at : at + at_once]
            with ThreadPool(len(part)) as pool:
                found = pool.map(lambda r: forest(r, alive), part, chunksize=1)
            yield from zip(part, found, strict=True)

    made = 0
    while made < max_rounds and n >= 2:
        alive = [c for c in names if decision[c] != "rejected"]
        if all(decision[c] != "tentative" for c in alive):
            break
        # rounds do not depend on each other as long as the columns stay: some
        # forests are fitted at a time, and their hits are counted in order
        for r, imp in forests(range(made, min(made + ROUNDS_AT_ONCE, max_rounds)), alive):
            made = r + 1
            bar = float(np.percentile(imp[len(alive):], perc))
            open_ = [c for c in alive if decision[c] == "tentative"]
            for c in open_:
                rounds[c] += 1
                hits[c] += int(imp[alive.index(c)] > bar)
            more = _passed({c: _binom_sf(hits[c], rounds[c]) for c in open_}, alpha, made)
            less = _passed({c: 1 - _binom_sf(hits[c] + 1, rounds[c]) for c in open_}, alpha, made)
            for c in open_:
                if c in more:
                    decision[c] = "confirmed"
                elif c in less:
                    decision[c], left_at[c] = "rejected", r
            if all(decision[c] != "tentative" for c in alive):
                break
    last = sorted({left_at[c] for c in left_at}, reverse=True)
    rank = {c: {"confirmed": 1, "tentative": 2}.get(decision[c]) or 3 + last.index(left_at[c]) for c in names}
    return spark.createDataFrame([(c, hits[c], rounds[c], decision[c], rank[c]) for c in names],
                                 "feature string, hits int, rounds int, decision string, rank int")


# ---- model search (V1-V3) -----------------------------------------------------------
def random_search(ff: FeatureFrame, folds: DataFrame, label: str = "target_b", n_sets: int = 10,
                  n_folds: int = 10, seed: int = 42, parallelism: int = 8) -> DataFrame:
    """V1-V3: random parameter sets (seeded draws, V2) for the elastic-net
    logit, scored by k-fold cross-validation on given folds (R3); result
    table best first."""
    rnd = random.Random(seed)
    lr = logit(label)
    sets = [(round(10 ** rnd.uniform(-3, -1), 5), rnd.choice([0.0, 0.5, 1.0])) for _ in range(n_sets)]
    grid = []
    for reg, enet in sets:
        grid += ParamGridBuilder().baseOn({lr.regParam: reg, lr.elasticNetParam: enet}).build()
    data = ff.df.join(not_broadcast(folds.select(ff.key, "fold"), ff.df.count()), ff.key).checkpoint(eager=True)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid,
                        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
                        foldCol="fold", numFolds=n_folds, parallelism=parallelism, seed=seed)
    m = cv.fit(data)
    spark = ff.df.sparkSession
    rows = [(float(reg), float(enet), float(s)) for (reg, enet), s in zip(sets, m.avgMetrics)]
    df = spark.createDataFrame(rows, "reg_param double, elastic_net double, mean_auc double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_auc").desc(), "reg_param")))


# ---- iterative imputation (I4) ------------------------------------------------------
def impute_iterative(df: DataFrame, key: str, cols: Sequence[str], rounds: int = 5,
                     medians: dict | None = None) -> DataFrame:
    """I4: chained regression imputation.  Start from median fills; in each
    round every incomplete column (fewest missing first) is regressed on the
    others over the rows where it is known, and its missing cells are replaced
    by the prediction.

    One step is one pass: each batch repeats the round's earlier steps on its
    rows and adds its part of the column's normal equations (columns squared
    numbers), which Spark sums; the solved coefficients are the next step.  The
    table is checkpointed after each round."""
    import numpy as np
    import pyarrow as pa

    ensure_checkpoint_dir(df.sparkSession)
    cols, p = list(cols), len(cols)
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    order = [cols.index(c) for c in sorted(cols, key=lambda c: (miss[c], c)) if miss[c] > 0]
    fills = medians or {}
    cur = df.select(key, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c, 0.0)))) for c in cols]).alias("x"),
                    F.array(*[F.col(c).isNull() for c in cols]).alias("m")).checkpoint(eager=True)

    def replayed(b: pa.RecordBatch, steps: list) -> tuple:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p).copy()
        m = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        for c, w in steps:  # w[c] is the intercept's place
            z = x[m[:, c]]
            z[:, c] = 1.0
            x[m[:, c], c] = z @ w
        return x, m

    def equations(steps: list, c: int):
        def run(batches):
            total = np.zeros((p, p + 1))
            for b in batches:
                x, m = replayed(b, steps)
                z = x[~m[:, c]]
                y = z[:, c].copy()
                z[:, c] = 1.0
                total += np.column_stack([z.T @ z, z.T @ y])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

        rows = cur.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(p * (p + 1))
        for r in rows:
            flat[r.i] = r.v
        a = flat.reshape(p, p + 1)
        return np.linalg.lstsq(a[:, :p], a[:, p], rcond=1e-12)[0]

    for _ in range(rounds):
        steps: list = []
        for c in order:
            steps.append((c, equations(list(steps), c)))

        def settle(batches, steps=steps):
            for b in batches:
                x, _ = replayed(b, steps)
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, p), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), held, b.column(2)], b.schema.names)

        cur = cur.mapInArrow(settle, cur.schema).checkpoint(eager=True)
    return cur.select(key, *[F.round(F.get("x", F.lit(i)), 6).alias(c) for i, c in enumerate(cols)])


# ---- persistence (S7, S8) -----------------------------------------------------------
def save_pipeline(model: PipelineModel, path: str) -> None:
    """Fitted transformations are stored once and loaded unchanged."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Feature names of an assembled vector, from its ML attribute
    metadata (VectorAssembler writes one attribute per slot)."""
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = [a for group in attrs.values() for a in group]
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]


def record_result(store_root: str, spark, model_name: str, params: str, metric: str, score: float,
                  model=None, greater_is_better: bool = True) -> DataFrame:
    """Append (model, params, metric, score, path, greater_is_better) to
    the results table; the fitted model is written only when it beats the best
    stored score of that model and metric.  Returns the results table."""
    import uuid

    from donorlift.sources.files import StageStore

    root = store_root.rstrip("/")
    table = f"{root}/results"
    best = None
    if StageStore(spark, root).exists("results"):
        mine = spark.read.parquet(table).where((F.col("metric") == metric) & (F.col("model") == model_name))
        best = mine.agg((F.max if greater_is_better else F.min)("score")).first()[0]
    path = None
    if model is not None and (best is None or (score > best if greater_is_better else score < best)):
        path = f"{root}/models/{model_name}-{uuid.uuid4().hex}"
        model.write().overwrite().save(path)
    row = spark.createDataFrame([(model_name, params, metric, float(score), path, greater_is_better)],
                                "model string, params string, metric string, score double, path string, greater_is_better boolean")
    row.write.mode("append").parquet(table)
    return spark.read.parquet(table)


def best_model(results: DataFrame, metric: str) -> DataFrame:
    """The best stored model over all models for a metric."""
    r = results.where((F.col("metric") == metric) & F.col("path").isNotNull())
    order = F.when(F.col("greater_is_better"), F.col("score")).otherwise(-F.col("score"))
    return r.agg(F.max_by("model", order).alias("model"), F.max_by("path", order).alias("path"),
                 F.max_by("score", order).alias("score"))

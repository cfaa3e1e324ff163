"""Splits, folds, weights, resampling and power transforms.

Splits are deterministic: rows are ordered inside each class by an md5
hash of (key, seed) and cut by exact positions, computed with the
distributed position helper (the majority class never sits in one task).
Power-transform parameters are found with one pass per grid: every Arrow
batch adds its rows to the sums of all grid points (numpy over a batch x
grid matrix) and Spark sums the per-batch partial rows per grid point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlift.operators.ordering import with_positions


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def stratified_positions(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Exact position of every row inside its class in hash order."""
    h = df.withColumn("_h", hash_order(key, seed))
    return with_positions(h, [("_h", True), (key, True)], group_cols=[label]).drop("_h")


def stratified_split(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Per class, the first ceil(n/k) rows in hash order are 'test'
    (a 1/k hold-out), the rest 'train'."""
    p = stratified_positions(df, key, label, seed)
    n_test = F.expr(f"(_n + {k - 1}) div {k}")
    return p.withColumn("split", F.when(F.col("_pos") <= n_test, "test").otherwise("train")).drop("_pos", "_n")


def plain_split(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """R2: the first ceil(n/k) of all rows in hash order are 'test'."""
    return stratified_split(df.withColumn("_all", F.lit(0)), key, "_all", k, seed).drop("_all")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (position - 1) mod k inside each class."""
    p = stratified_positions(df, key, label, seed)
    return p.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_pos", "_n")


def split_check(split: DataFrame, key: str) -> DataFrame:
    """Sizes of both parts, their overlap (left semi) and union."""
    train = split.where(F.col("split") == "train").select(key)
    test = split.where(F.col("split") == "test").select(key)
    overlap = train.join(test, key, "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))
    union = train.union(test).distinct().agg(F.count(F.lit(1)).alias("n_union"))
    sizes = split.agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    # three one-row aggregates side by side
    return sizes.unionByName(overlap, allowMissingColumns=True).unionByName(
        union, allowMissingColumns=True
    ).agg(*[F.max(c).alias(c) for c in ("n_train", "n_test", "n_overlap", "n_union")])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class size, 'balanced' weight n / (2 n_c), and the
    negative-to-positive ratio.  The window spans the class table only."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    total = F.sum("n").over(w)
    neg = F.sum(F.when(F.col(label) == 0, F.col("n"))).over(w)
    pos = F.sum(F.when(F.col(label) == 1, F.col("n"))).over(w)
    return c.select(
        label,
        "n",
        F.round(total / (2 * F.col("n")), 6).alias("weight"),
        F.round(neg / pos, 6).alias("neg_pos_ratio"),
    )


def fit_min_max(df: DataFrame, col: str) -> tuple[float, float]:
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return float(r["lo"]), float(r["hi"])


def min_max_weights(df: DataFrame, col: str, lo: float, hi: float) -> Column:
    """Sample weight from an amount rescaled to [0, 1] (learned range)."""
    return (F.col(col) - F.lit(lo)) / F.lit((hi - lo) or 1.0)  # a constant column gives zeros


def oversample(df: DataFrame, key: str, label: str, minority: int = 1, seed: int = 42) -> DataFrame:
    """R6, deterministic: every minority row is repeated r = n_major div
    n_minor times, and the first (n_major mod n_minor) minority rows in hash
    order once more, so both classes end up the same size."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_min = counts.get(minority, 0)
    n_maj = sum(v for k, v in counts.items() if k != minority)
    if n_min == 0:
        return df.withColumn("copy", F.lit(1))
    r, extra = divmod(n_maj, n_min)
    mino = stratified_positions(df.where(F.col(label) == minority), key, label, seed)
    copies = F.lit(r) + F.when(F.col("_pos") <= extra, 1).otherwise(0)
    mino = mino.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_pos", "_n")
    majo = df.where(F.col(label) != minority).withColumn("copy", F.lit(1))
    return majo.unionByName(mino)


def undersample(df: DataFrame, key: str, label: str, minority: int = 1, seed: int = 42) -> DataFrame:
    """Every minority row, and of each other class as many rows, the
    first ones in hash order."""
    n_min = df.where(F.col(label) == minority).count()
    p = stratified_positions(df, key, label, seed)
    return p.where((F.col(label) == minority) | (F.col("_pos") <= n_min)).drop("_pos", "_n")


# ---- power transforms ----------------------------------------------------------

def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _loglik(df: DataFrame, col: str, lambdas: Sequence[float], method: str) -> list[tuple[float, float]]:
    """One pass: each Arrow batch yields, per lambda, the sum and sum of
    squares of the transformed values (numpy over a batch x grid matrix),
    plus n and the Jacobian sum; Spark adds the partial rows per lambda.
    Only the grid-sized totals reach the driver."""
    import numpy as np
    import pandas as pd

    lams = [float(v) for v in lambdas]
    # sums are taken around the transform of a central value: the variance
    # then does not cancel, however many rows there are
    centre = df.agg(F.avg(F.col(col).cast("double")).alias("m")).first()["m"]

    # Everything the Python workers run is defined in this closure, so it is
    # shipped by value (the workers need not import this package).
    def transform(x):
        lam = np.asarray(lams, dtype="float64")[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            if method == "box-cox":
                lx = np.log(x)[None, :]
                return np.where(lam == 0, lx, (np.power(x[None, :], lam) - 1) / np.where(lam == 0, 1.0, lam))
            pos = x >= 0
            xp = np.where(pos, x, 0.0)[None, :]
            xn = np.where(pos, 0.0, -x)[None, :]
            tp = np.where(lam == 0, np.log1p(xp), (np.power(xp + 1, lam) - 1) / np.where(lam == 0, 1.0, lam))
            l2 = 2 - lam
            tn = np.where(l2 == 0, -np.log1p(xn), -(np.power(xn + 1, l2) - 1) / np.where(l2 == 0, 1.0, l2))
            return np.where(pos[None, :], tp, tn)

    def partial(batches):
        shift = transform(np.array([centre], dtype="float64"))
        for pdf in batches:
            x = pdf[col].to_numpy(dtype="float64")
            x = x[~np.isnan(x)]
            if x.size == 0:
                continue
            t = transform(x) - shift
            jac = np.log(x).sum() if method == "box-cox" else (np.sign(x) * np.log1p(np.abs(x))).sum()
            yield pd.DataFrame({
                "i": np.arange(len(lams), dtype="int32"),
                "s": t.sum(axis=1),
                "q": (t * t).sum(axis=1),
                "n": np.full(len(lams), x.size, dtype="int64"),
                "j": np.full(len(lams), jac),
            })

    if centre is None:
        return [(lam, -math.inf) for lam in lams]
    parts = df.select(F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull()).mapInPandas(
        partial, "i int, s double, q double, n long, j double"
    )
    tot = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"),
                                 F.sum("j").alias("j")).collect()
    out = []
    for r in sorted(tot, key=lambda r: r["i"]):
        lam = lams[r["i"]]
        n, s, q, j = r["n"], r["s"], r["q"], r["j"]
        var = q / n - (s / n) ** 2
        ll = (lam - 1) * j - n / 2 * math.log(var) if var > 0 else -math.inf
        out.append((lam, ll))
    return out


def coarse_grid() -> list[float]:
    return [k / 100.0 for k in range(-200, 201)]


def fine_grid(center: float) -> list[float]:
    return [center + j / 10000.0 for j in range(-100, 101)]


def fit_power_lambda(df: DataFrame, col: str, method: str = "box-cox") -> tuple[float, float]:
    """Lambda of greatest likelihood, first on a 0.01 grid over
    [-2, 2], then on a 0.0001 grid around the best point.  Two passes."""
    ll = _loglik(df, col, coarse_grid(), method)
    c = max(ll, key=lambda t: (t[1], -t[0]))[0]
    ll2 = _loglik(df, col, fine_grid(c), method)
    best = max(ll2, key=lambda t: (t[1], -t[0]))[0]
    return c, best


#: Grids of lambda for many columns: all of [-5, 5], then around the best of each column.
POWER_STEPS = ((50, 0.1), (10, 0.01), (10, 0.001))


def fit_power_lambdas(df: DataFrame, cols: Sequence[str], method: str = "yeo-johnson") -> dict[str, float]:
    """Lambda of greatest likelihood (to 0.001) of every column.  A step of
    the search is one pass over the table: every batch adds each column's sums
    for its own grid of lambdas; missing values do not take part.  A column
    without two different values keeps lambda 1 (no transform)."""
    import numpy as np

    from donorlift.operators.gram import centres, summed

    p, centre = len(cols), centres(df, cols)

    def transform(x, lam):
        with np.errstate(all="ignore"):
            if method == "box-cox":
                return np.where(lam == 0, np.log(x), (np.power(x, lam) - 1) / np.where(lam == 0, 1.0, lam))
            up, down, mu = np.where(x >= 0, x, 0.0), np.where(x >= 0, 0.0, -x), 2 - lam
            a = np.where(lam == 0, np.log1p(up), (np.power(up + 1, lam) - 1) / np.where(lam == 0, 1.0, lam))
            b = np.where(mu == 0, -np.log1p(down), -(np.power(down + 1, mu) - 1) / np.where(mu == 0, 1.0, mu))
            return np.where(x >= 0, a, b)

    def pass_over(grids):  # p x g
        def make(x):
            out = np.zeros((p, 3 + 2 * grids.shape[1]))
            for c in range(p):
                v = x[:, c][~np.isnan(x[:, c])]
                if not len(v):
                    continue
                with np.errstate(all="ignore"):
                    jac = np.log(v).sum() if method == "box-cox" else (np.sign(v) * np.log1p(np.abs(v))).sum()
                t = transform(v[:, None], grids[c][None, :]) - transform(centre[c], grids[c])[None, :]
                out[c] = [len(v), jac, ((v - centre[c]) ** 2).sum(), *t.sum(0), *(t * t).sum(0)]
            return out

        return summed(df, cols, make)

    best = np.zeros(p)
    for k, (reach, width) in enumerate(POWER_STEPS):
        grids = np.round(best[:, None] + width * np.arange(-reach, reach + 1)[None, :], 4)
        got = pass_over(grids)
        if got is None:
            return dict.fromkeys(cols, 1.0)
        g = grids.shape[1]
        with np.errstate(all="ignore"):
            n, jac, s, q = got[:, :1], got[:, 1:2], got[:, 3 : 3 + g], got[:, 3 + g :]
            var = q / n - (s / n) ** 2
            like = np.where(var > 0, (grids - 1) * jac - n / 2 * np.log(var), -np.inf)
        like = np.where(np.isnan(like), -np.inf, like)
        best = np.array([grids[c, int(np.argmax(like[c]))] for c in range(p)])  # first of equals: the least
        if k == 0:
            flat = (n[:, 0] < 2) | (got[:, 2] <= n[:, 0] * (1e-14 * centre) ** 2)
    return {c: 1.0 if flat[i] else float(best[i]) for i, c in enumerate(cols)}


def power_transform(x: Column, lam: float, method: str, mean: float | None = None, std: float | None = None) -> Column:
    t = box_cox(x, lam) if method == "box-cox" else yeo_johnson(x, lam)
    if mean is not None and std:
        t = (t - F.lit(mean)) / F.lit(std)
    return t


def inverse_box_cox(y: Column, lam: float, mean: float | None = None, std: float | None = None) -> Column:
    """R9 inverse (standardised values back to amounts)."""
    if mean is not None and std:
        y = y * F.lit(std) + F.lit(mean)
    return F.exp(y) if lam == 0 else F.pow(y * F.lit(lam) + 1, F.lit(1.0 / lam))


def fit_moments(df: DataFrame, expr: Column) -> tuple[float, float]:
    """Mean and population standard deviation of an expression (one pass)."""
    r = df.agg(F.avg(expr).alias("m"), F.stddev_pop(expr).alias("s")).first()
    return float(r["m"]), float(r["s"])


def signed_log(x: Column) -> Column:
    """sign(x) * ln(|x| + 1)."""
    return F.signum(x) * F.log1p(F.abs(x))


def fit_max_abs(df: DataFrame, expr: Column) -> float:
    return float(df.agg(F.max(F.abs(expr)).alias("m")).first()["m"])

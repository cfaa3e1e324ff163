"""Sums of matrices over all rows, and what follows from them: scatter
matrices, pairwise correlations (A10), regularisation paths (M3, M8).

A task adds up its part of a matrix batch by batch (numpy) and gives it out by
rows of the matrix, symmetric ones from the diagonal on; the parts meet by row
number, added up as they come.  A plan has one expression per column, not one
per pair of columns, and the driver gets one matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, names: Sequence[str], make: Callable, others: Sequence[str] = (), upper: bool = False):
    """Sum over all batches of ``make(x, *others)``, a matrix: x holds the
    columns ``names`` as doubles, missing ones as NaN, ``others`` follow as
    arrays.  With ``upper`` the matrix is symmetric.  None for no rows."""
    import numpy as np
    import pandas as pd

    n, m = len(names), len(others)
    picked = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(others)])

    def part(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n)]) if n else np.zeros((b.num_rows, 0))
            got = make(x.astype(float), *[b.column(n + i).to_numpy(zero_copy_only=False) for i in range(m)])
            total = got if total is None else total + got
        if total is not None:
            yield from rows(dict(enumerate(total[i, i:] if upper else total[i] for i in range(len(total)))))

    def rows(held):
        import pyarrow as pa

        at = pa.array(list(held), pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array([np.ascontiguousarray(v).tobytes() for v in held.values()], pa.binary())], ["i", "v"])

    def merge(batches):
        held: dict = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(v.as_buffer(), float)
                held[i] = held[i] + v if i in held else v.copy()
        if held:
            yield from rows(held)

    got = picked.mapInArrow(part, "i int, v binary").repartition("i").mapInArrow(merge, "i int, v binary").collect()  # one matrix
    if not got:
        return None
    lines = {r.i: np.frombuffer(bytes(r.v), float) for r in got}
    if not upper:
        return np.array([lines[i] for i in range(len(lines))])
    out = np.zeros((len(lines), len(lines)))
    for i, v in lines.items():
        out[i, i:] = out[i:, i] = v
    return out


def centres(df: DataFrame, names: Sequence[str]):
    """Means of the known values, to take sums around."""
    import numpy as np

    def make(x):
        known = ~np.isnan(x)
        return np.array([known.sum(0), np.where(known, x, 0).sum(0)], float)

    got = summed(df, names, make)
    return np.zeros(len(names)) if got is None else got[1] / np.maximum(got[0], 1)


@dataclass
class Scatter:
    """n, means and centred sums of products (p x p) of rows without gaps."""

    n: float
    mean: object
    products: object


def scatter(df: DataFrame, names: Sequence[str]) -> Scatter:
    """Scatter of ``names`` over the rows where all of them are known."""
    import numpy as np

    around = centres(df, names)

    def make(x):
        z = x[~np.isnan(x).any(1)] - around
        z = np.column_stack([np.ones(len(z)), z])
        return z.T @ z

    got = summed(df, names, make, upper=True)
    if got is None or got[0, 0] == 0:
        return Scatter(0, around, np.zeros((len(names), len(names))))
    n, s = got[0, 0], got[0, 1:]
    return Scatter(n, around + s / n, got[1:, 1:] - np.outer(s, s) / n)


def correlation_matrix(df: DataFrame, names: Sequence[str]):
    """(rows, correlation) of every pair of columns over the rows where both
    are known; NaN for a constant column or fewer than two rows."""
    import numpy as np

    p, around = len(names), centres(df, names)

    def make(x):
        known = ~np.isnan(x)
        z, m = np.where(known, x - around, 0.0), known.astype(float)
        return np.hstack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])

    got = summed(df, names, make)
    if got is None:
        return np.zeros((p, p)), np.full((p, p), np.nan)
    n, s, q, c = (got[:, k * p : (k + 1) * p] for k in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        var = q - s * s / n
        var = np.where(var <= n * (1e-14 * around[:, None]) ** 2, 0.0, var)  # rounding of a constant
        return n, np.where(n > 1, (c - s * s.T / n) / np.sqrt(var * var.T), np.nan)


# ---- regularisation paths (M3, M8) -------------------------------------------------
def soft(v, t):
    import numpy as np

    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def descend(a, b, l1: float, l2: float, start, free: int = 0, tol: float = 1e-12, rounds: int = 10_000):
    """Coordinate descent for min w'aw/2 - b'w + l1 |w| + l2 w'w/2, without a
    penalty on the first ``free`` coordinates."""
    import numpy as np

    w = np.array(start, float)
    grad = b - a @ w
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if a[j, j] <= 0:
                continue
            held = grad[j] + a[j, j] * w[j]
            new = held / a[j, j] if j < free else float(soft(held, l1)) / (a[j, j] + l2)
            step = new - w[j]
            if step:
                grad = grad - a[:, j] * step
                w[j] = new
                most = max(most, abs(step) * a[j, j])
        if most <= tol * scale:
            break
    return w


def fold_products(df: DataFrame, names: Sequence[str], fold: str, n_folds: int):
    """Products of (1, columns around their means) of each fold, from one pass
    after that for the means: (means, n_folds x (p + 1) x (p + 1))."""
    import numpy as np

    p, around = len(names) + 1, centres(df, names)

    def make(x, f):
        out = np.zeros((n_folds, p, p))
        ok = ~np.isnan(x).any(1)
        z = np.column_stack([np.ones(len(x)), x - around])
        for k in range(n_folds):
            mine = z[ok & (f == k)]
            out[k] = mine.T @ mine
        return out.reshape(n_folds * p, p)

    got = summed(df, names, make, [fold])
    return around, np.zeros((n_folds, p, p)) if got is None else got.reshape(n_folds, p, p)


def _linear(g, lambdas: Sequence[float], alpha: float):
    """Elastic-net coefficients for every lambda from the products of (1, x, y)
    around a point, warm-started from the greatest lambda on.  As in MLlib's normal solver,
    columns and target are standardised (n), the loss is half the mean square."""
    import numpy as np

    n, s = g[0, 0], g[0, 1:]
    c = g[1:, 1:] - np.outer(s, s) / n
    std = np.sqrt(np.diag(c) / n)
    std = np.where(std > 0, std, np.inf)  # constant columns stay out
    r = c / np.outer(std, std) / n
    a, b, ys = r[:-1, :-1], r[:-1, -1], std[-1]
    if not np.isfinite(ys):  # constant target
        return [(np.zeros(len(b)), s / n) for _ in lambdas]
    out, w = {}, np.zeros(len(b))
    for lam in sorted(lambdas, reverse=True):
        w = descend(a, b, lam / ys * alpha, lam / ys * (1 - alpha), w)
        out[lam] = w * ys / std[:-1], s / n
    return [out[lam] for lam in lambdas]


def linear_path(df: DataFrame, names: Sequence[str], y: str, fold: str, n_folds: int, lambdas: Sequence[float], alpha: float = 0.5) -> tuple[list[dict], dict]:
    """M8: the path by cross-validation from one pass: fitted coefficients and
    the mean squared error of the fold left out both follow from the folds'
    products.  Rows (lambda, fold, rows, mse, nonzero), and the model of least
    mean error (the greatest such lambda), fitted on all rows."""
    import numpy as np

    around, parts = fold_products(df, [*names, y], fold, n_folds)
    whole, rows = parts.sum(0), []
    for f in range(n_folds):
        test = parts[f]
        for lam, (w, mean) in zip(lambdas, _linear(whole - test, lambdas, alpha), strict=True):
            # error = u'(1, x, y) with u = (intercept, coefficients, -1) around the means
            u = np.concatenate([[mean[-1] - w @ mean[:-1]], w, [-1.0]])
            n = test[0, 0]
            rows.append({"lambda": lam, "fold": f, "rows": int(n), "mse": float(u @ test @ u / n) if n else None, "nonzero": int((w != 0).sum())})
    means = {lam: np.mean([r["mse"] for r in rows if r["lambda"] == lam and r["mse"] is not None]) for lam in lambdas}
    best = max(lam for lam in lambdas if means[lam] <= min(means.values()) * (1 + 1e-12))
    w, mean = _linear(whole, [best], alpha)[0]
    intercept = around[-1] + mean[-1] - float(w @ (around[:-1] + mean[:-1]))
    return rows, {"lambda": best, "coef": dict(zip(names, w.tolist(), strict=True)), "intercept": float(intercept)}


def logit_path(df: DataFrame, names: Sequence[str], label: str, fold: str, n_folds: int, lambdas: Sequence[float], alpha: float = 0.5, balanced: bool = True,
               threshold: float = 0.5, passes: int = 30, tol: float = 1e-8) -> tuple[list[dict], dict]:
    """M3: the path by cross-validation on recall.  The models of all folds and
    lambdas, and those of all rows, take their Newton steps together: one pass
    adds up the weighted products of every model, the driver solves the small
    penalised problems, until no coefficient moves.  Columns are standardised
    (n - 1) on the rows of each model, classes weighted to balance, the loss
    is the weighted mean, as in MLlib.  Rows (lambda, fold, rows, recall,
    log_loss, nonzero), and the model of greatest mean recall (the greatest such
    lambda), fitted on all rows."""
    import numpy as np

    p, lambdas = len(names), list(lambdas)
    around, parts = fold_products(df, [*names, label], fold, n_folds)
    models = [(f, lam) for f in [*range(n_folds), None] for lam in lambdas]
    kind = {}
    for f in [*range(n_folds), None]:
        g = parts.sum(0) - (parts[f] if f is not None else 0)
        n, s = g[0, 0], g[0, 1:]
        var = np.diag(g)[1:-1] - s[:-1] ** 2 / n
        std = np.sqrt(np.where(var > 1e-24 * n * (1 + around[:-1] ** 2), var, np.inf) / (n - 1))
        share = float(s[-1] / n + around[-1])  # of class 1
        weight = (0.5 / (1 - share), 0.5 / share) if balanced and 0 < share < 1 else (1.0, 1.0)
        kind[f] = (around[:-1] + s[:-1] / n, std, weight, share)
    beta = {m: np.zeros(p + 1) for m in models}
    for m in models:
        share = kind[m[0]][3]
        if not balanced and 0 < share < 1:
            beta[m][0] = np.log(share / (1 - share))

    def standard(x, f):
        mean, std, weight, _ = kind[f]
        return np.column_stack([np.ones(len(x)), (x - mean) / std]), weight

    def step(open_, beta):
        def make(x, y, fold_):
            out = np.zeros((len(open_), p + 1, p + 3))
            ok = ~np.isnan(x).any(1)
            x, y, fold_ = x[ok], y[ok].astype(float), fold_[ok]
            by_fold = {}
            for k, (f, lam) in enumerate(open_):
                if f not in by_fold:
                    mine = fold_ != f if f is not None else np.ones(len(x), bool)
                    z, weight = standard(x[mine], f)
                    by_fold[f] = z, y[mine], np.where(y[mine] == 1, weight[1], weight[0])
                z, t, w = by_fold[f]
                q = 1 / (1 + np.exp(-np.clip(z @ beta[f, lam], -500, 500)))
                h = np.maximum(w * q * (1 - q), 1e-12 * w)
                out[k, :, : p + 1] = (z * h[:, None]).T @ z
                out[k, :, p + 1] = z.T @ (w * (t - q))
                out[k, 0, p + 2] = w.sum()
            return out.reshape(len(open_) * (p + 1), p + 3)

        got = summed(df, names, make, [label, fold])
        return None if got is None else got.reshape(len(open_), p + 1, p + 3)

    open_ = list(models)
    for _ in range(passes):
        got = step(open_, beta)
        if got is None:
            break
        still = []
        for k, m in enumerate(open_):
            total = got[k, 0, p + 2]
            if total <= 0:
                continue
            a, b = got[k, :, : p + 1] / total, got[k, :, p + 1] / total
            new = descend(a, b + a @ beta[m], m[1] * alpha, m[1] * (1 - alpha), beta[m], free=1)
            if np.abs(new - beta[m]).max() > tol:
                still.append(m)
            beta[m] = new
        open_ = still
        if not open_:
            break

    held = [(f, lam) for f, lam in models if f is not None]

    def scores(x, y, fold_):
        out = np.zeros((len(held), 4))
        ok = ~np.isnan(x).any(1)
        x, y, fold_ = x[ok], y[ok].astype(float), fold_[ok]
        for k, (f, lam) in enumerate(held):
            mine = fold_ == f
            z, _ = standard(x[mine], f)
            q, t = 1 / (1 + np.exp(-np.clip(z @ beta[f, lam], -500, 500))), y[mine]
            clipped = np.clip(q, 1e-15, 1 - 1e-15)
            out[k] = len(t), t.sum(), ((q >= threshold) & (t == 1)).sum(), -(t * np.log(clipped) + (1 - t) * np.log(1 - clipped)).sum()
        return out

    found = summed(df, names, scores, [label, fold])
    rows = []
    for k, (f, lam) in enumerate(held):
        n, pos, tp, loss = found[k] if found is not None else (0, 0, 0, 0)
        rows.append({"lambda": lam, "fold": f, "rows": int(n), "recall": float(tp / pos) if pos else None, "log_loss": float(loss / n) if n else None, "nonzero": int((beta[f, lam][1:] != 0).sum())})
    means = {lam: np.mean([r["recall"] for r in rows if r["lambda"] == lam and r["recall"] is not None] or [0.0]) for lam in lambdas}
    best = max(lam for lam in lambdas if means[lam] >= max(means.values()) - 1e-12)
    mean, std, _, _ = kind[None]
    w = beta[None, best][1:] / std
    return rows, {"lambda": best, "coef": dict(zip(names, w.tolist(), strict=True)), "intercept": float(beta[None, best][0] - w @ mean)}


def lambda_grid(greatest: float, n: int = 20, ratio: float = 1e-3) -> list[float]:
    """``n`` values from the greatest down to its ``ratio``, equally spaced in logarithm."""
    return [greatest * ratio ** (k / max(1, n - 1)) for k in range(n)]

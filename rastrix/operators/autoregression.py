"""Spatial lag and spatial error models by maximum likelihood, from a few sums, with standard errors and tests.

For a given coefficient the residual sum of squares is a quadratic of the moments of y, X, Wy and WX, which one aggregate
gives. The log-determinant of I - rho W is exact for up to DENSE rows: the driver takes the eigenvalues of the weights (DENSE * DENSE numbers
at most). Beyond it comes from a Chebyshev expansion of ORDER terms whose traces are estimated with PROBES random vectors of signs, one
join of the sparse weights with an array a row for each term: no matrix of n x n is formed, and the estimate's standard error is
that of a mean of PROBES. Weights (i, j, w) must be row-standardised, with no row its own neighbour.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored

#: Rows up to which eigenvalues are taken; terms of the expansion, and vectors of signs.
DENSE, ORDER, PROBES = 2000, 40, 48


class LogDeterminant:
    """ln |I - rho W|: from eigenvalues, or from means of z T_k(W) z over vectors z of signs, with their standard errors."""

    def __init__(self, weights: DataFrame, n: int, dense: int = DENSE, order: int = ORDER, probes: int = PROBES):
        w = weights.select("i", "j", F.col("w").cast("double").alias("w"))
        self.values = self.means = None
        if n <= dense:
            ids = sorted(r[0] for r in w.select(F.explode(F.array("i", "j"))).distinct().collect())  # dense rows at most
            place = {k: p for p, k in enumerate(ids)}
            full = np.zeros((max(n, len(ids)),) * 2)
            for i, j, v in w.collect():
                full[place[i], place[j]] += v
            self.values = np.linalg.eigvals(full)
            return
        ids = w.select(F.explode(F.array("i", "j")).alias("id")).distinct()
        sign = F.transform(F.sequence(F.lit(1), F.lit(probes)), lambda k: F.when(F.xxhash64("id", k) % 2 == 0, 1.0).otherwise(-1.0))
        now = stored(ids.select("id", sign.alias("z"), sign.alias("v"), F.array().cast("array<double>").alias("u")), "probes")
        means = [np.full(probes, float(n))]
        each = range(probes)
        for k in range(1, order + 1):
            # merged, so that no table passes through the driver however small its file is
            spread = w.join(now.select(F.col("id").alias("j"), "v").hint("merge"), "j")
            sums = spread.groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.get("v", F.lit(p))).alias(f"x{p}") for p in each])
            sums = sums.select("id", F.array(*[f"x{p}" for p in each]).alias("wv"))
            joined = now.join(sums.hint("merge"), "id", "left").select("id", "z", "u", "v", F.coalesce("wv", F.array_repeat(F.lit(0.0), probes)).alias("wv"))
            # T_{k+1} = 2 W T_k - T_{k-1}
            after = F.col("wv") if k == 1 else F.zip_with("wv", "u", lambda a, b: 2 * a - b)
            now = stored(joined.select("id", "z", after.alias("v"), F.col("v").alias("u")), "probes")
            row = now.agg(*[F.sum(F.get("z", F.lit(p)) * F.get("v", F.lit(p))) for p in each]).first()
            means.append(np.array(row, dtype=float))
        self.means = np.array(means)

    def at(self, rho: np.ndarray) -> np.ndarray:
        if self.values is not None:
            return np.array([np.log(np.abs(1 - r * self.values)).sum() for r in rho])
        return self._expanded(rho).mean(axis=1)

    def error(self, rho: np.ndarray) -> np.ndarray:
        """The standard error of at()."""
        return np.zeros(len(rho)) if self.values is not None else self._expanded(rho).std(axis=1, ddof=1) / np.sqrt(self.means.shape[1])

    def _expanded(self, rho: np.ndarray) -> np.ndarray:
        q = 4 * len(self.means)
        theta = np.pi * (np.arange(q) + 0.5) / q
        log = np.log(1 - rho[:, None] * np.cos(theta))
        c = np.stack([2 / q * (log * np.cos(k * theta)).sum(axis=1) for k in range(len(self.means))], axis=1)
        c[:, 0] /= 2
        return c @ self.means


def _moments(rows: DataFrame, weights: DataFrame, y: str, columns: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of 1, x, y and their lags: rows 0 to k are the design, k + 1 is y, and the second half is the same lagged."""
    names = ["_one", *columns, y]
    base = rows.select("id", F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in [*columns, y]])
    lag = weights.join(base.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_w_{c}") for c in names])
    one = base.join(lag, "id", "left").fillna(0.0, [f"_w_{c}" for c in names])
    every = [*names, *[f"_w_{c}" for c in names]]
    k = len(every)
    row = one.agg(*[F.sum(F.col(every[a]) * F.col(every[b])).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)], F.count("*").alias("n")).first()
    return np.array([[row[f"m{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)]), row["n"]


def _fit(rows, weights, y, columns, error: bool, **how) -> DataFrame:
    weights = stored(weights.select("i", "j", F.col("w").cast("double").alias("w")), "weights")  # read in each of ORDER steps
    m, n = _moments(rows, weights, y, columns)
    k, half = len(columns) + 1, len(columns) + 2
    determinant = LogDeterminant(weights, n, **how)

    def products(r: float) -> np.ndarray:
        """Sums of products of the design and y, less r times their lags (of y only, in the lag model)."""
        take = np.zeros((half, 2 * half))
        take[:, :half] = np.eye(half)
        take[range(0 if error else k, half), range(half + (0 if error else k), 2 * half)] = -r
        return take @ m @ take.T

    def squares(r: float, beta: np.ndarray) -> float:
        s = products(r)
        return max(s[k, k] - 2 * beta @ s[:k, k] + beta @ s[:k, :k] @ beta, 1e-300)

    def best_beta(r: float) -> np.ndarray:
        s = products(r)
        return np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)[0]

    def likelihood(r: float, beta: np.ndarray, variance: float, log: float) -> float:
        return log - n / 2 * np.log(2 * np.pi * variance) - squares(r, beta) / (2 * variance)

    def profile(grid: np.ndarray) -> np.ndarray:
        rss = np.array([squares(r, best_beta(r)) for r in grid])
        return determinant.at(grid) - n / 2 * (np.log(2 * np.pi * rss / max(1, n)) + 1)

    low, high = -0.999, 0.999
    while high - low > 1e-9:  # finer and finer grids around the best point
        grid = np.linspace(low, high, 41)
        best = int(profile(grid).argmax())
        low, high = grid[max(0, best - 1)], grid[min(40, best + 1)]
    r = (low + high) / 2
    beta = best_beta(r)
    variance = squares(r, beta) / max(1, n)
    logs = {d: float(determinant.at(np.array([r + d * 1e-4]))[0]) for d in (-1, 0, 1)}
    likely = likelihood(r, beta, variance, logs[0])
    # the curvature of the likelihood in all its parameters gives their errors
    steps = np.array([*np.maximum(1e-4 * np.abs(beta), 1e-6), 1e-4, 1e-4 * variance])
    at = lambda d: likelihood(r + d[k] * 1e-4, beta + d[:k] * steps[:k], variance + d[k + 1] * steps[k + 1], logs[int(d[k])])
    unit = np.eye(k + 2)
    mixed = lambda a, b: at(unit[a]) - 2 * likely + at(-unit[a]) if a == b else (at(unit[a] + unit[b]) - at(unit[a] - unit[b]) - at(unit[b] - unit[a]) + at(-unit[a] - unit[b])) / 4
    scaled = np.array([[mixed(a, b) for b in range(k + 2)] for a in range(k + 2)])
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-scaled)), 0)) * steps
    plain = squares(0.0, best_beta(0.0))
    ratio = 2 * (likely + n / 2 * (np.log(2 * np.pi * plain / max(1, n)) + 1))
    name, tail = "lambda" if error else "rho", float(determinant.error(np.array([r]))[0])
    terms = [*zip(["intercept", *columns], beta, errors[:k]), (name, r, errors[k])]
    z = lambda v, e: v / e if e > 0 else None
    found = [(t, float(v), float(e), z(float(v), float(e)), erfc(abs(v / e) / sqrt(2)) if e > 0 else None, float(likely), float(variance), float(ratio), erfc(sqrt(max(0.0, ratio) / 2)), tail) for t, v, e in terms]
    return rows.sparkSession.createDataFrame(found, "term string, coefficient double, error double, z double, p double, log_likelihood double, variance double, likelihood_ratio double, ratio_p double, determinant_error double")


def lag_model(rows: DataFrame, weights: DataFrame, y: str, columns: list[str], **how) -> DataFrame:
    """Of y = rho W y + X b + e for rows (id, y, columns): each term's coefficient, standard error, z and p; the log-likelihood and variance; the likelihood-ratio test against rho = 0; the log-determinant's standard error."""
    return _fit(rows, weights, y, columns, False, **how)


def error_model(rows: DataFrame, weights: DataFrame, y: str, columns: list[str], **how) -> DataFrame:
    """The same of y = X b + u, u = lambda W u + e."""
    return _fit(rows, weights, y, columns, True, **how)


def durbin_model(values: DataFrame, weights: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """The spatial lag model with the neighbours' weighted means of the columns (as w_<column>) beside the columns themselves."""
    weights = stored(weights.select("i", "j", "w"), "weights")
    means = weights.join(values.select(F.col("id").alias("j"), *columns), "j").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"w_{c}") for c in columns])
    lagged = values.join(means, "id", "left").fillna(0.0, [f"w_{c}" for c in columns])
    return lag_model(lagged, weights, y, [*columns, *[f"w_{c}" for c in columns]])

"""Permutations, autoregressions with errors and tests, detectors' p-values, multiscale regressions and spline surfaces, against dense versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix.functions.special import beta_share, f_tail
from rastrix.operators import autoregression, multiscale, permutation, regression, spatial, splines, statistics


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations_are_bijections(spark, n):
    rows = spark.range(n).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(6)))).select("t", "id", permutation.moved(F.col("id"), permutation.keys(F.col("t")), F.lit(n).cast("long")).alias("to")).collect()
    orders = [[r["to"] for r in sorted(rows, key=lambda r: r["id"]) if r["t"] == t] for t in range(1, 7)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 7 or len({tuple(o) for o in orders}) == 6


def test_permutations_are_spread_evenly(spark):
    n, times = 10, 2000
    seen = np.zeros((n, n))
    for r in spark.range(n).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times)))).groupBy("id", permutation.moved(F.col("id"), permutation.keys(F.col("t")), F.lit(n).cast("long")).alias("to")).count().collect():
        seen[r["id"], r["to"]] = r["count"]
    assert ((seen - times / n) ** 2 / (times / n)).sum() < 150  # 81 degrees of freedom


def ring_weights(spark, n):
    near = [(k, j % n) for k in range(n) for j in (k - 2, k - 1, k + 1, k + 2)]
    w = np.zeros((n, n))
    for i, j in near:
        w[i, j] = 0.25
    return spatial.styled(spark.createDataFrame(near, "i long, j long"), "W"), w


def test_moran_permuted_tells_pattern_from_noise(spark):
    n = 60
    weights, w = ring_weights(spark, n)
    smooth = np.sin(np.arange(n) * 2 * np.pi / n)
    noise = np.random.default_rng(3).normal(size=n)
    for v, low in ((smooth, True), (noise, False)):
        r = permutation.moran_permuted(spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "id long, v double"), weights, 99).first()
        z = v - v.mean()
        assert r["observed"] == pytest.approx((w * np.outer(z, z)).sum() / w.sum() / z.var())
        assert abs(r["mean"] + 1 / (n - 1)) < 0.05 and (r["p"] == 0.01) == low


@pytest.mark.parametrize("error", [False, True])
def test_autoregression_equals_the_dense_fit(spark, error):
    n, rng = 90, np.random.default_rng(7)
    weights, w = ring_weights(spark, n)
    x, e = rng.normal(size=n), rng.normal(size=n) * 0.5
    y = np.linalg.solve(np.eye(n) - 0.5 * w, e if error else 1 + 2 * x + e) + ((1 + 2 * x) if error else 0)
    X = np.stack([np.ones(n), x], axis=1)

    def fit(r):
        f = np.eye(n) - r * w
        a, b = (f @ X if error else X), f @ y
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        s2 = ((b - a @ beta) ** 2).mean()
        return np.linalg.slogdet(f)[1] - n / 2 * (np.log(2 * np.pi * s2) + 1), beta, s2

    low, high = -0.99, 0.99
    while high - low > 1e-7:
        grid = np.linspace(low, high, 21)
        k = int(np.argmax([fit(r)[0] for r in grid]))
        low, high = grid[max(0, k - 1)], grid[min(20, k + 1)]
    likely, beta, s2 = fit(low)
    rows = spark.createDataFrame([(k, float(x[k]), float(y[k])) for k in range(n)], "id long, x double, y double")
    model = autoregression.error_model if error else autoregression.lag_model
    found = {r["term"]: r for r in model(rows, weights, "y", ["x"]).collect()}
    name = "lambda" if error else "rho"
    assert found[name]["coefficient"] == pytest.approx(low, abs=1e-4) and found["x"]["coefficient"] == pytest.approx(beta[1], abs=1e-4)
    assert found["x"]["log_likelihood"] == pytest.approx(likely, abs=1e-4) and found["x"]["variance"] == pytest.approx(s2, abs=1e-4)
    ratio = 2 * (likely - fit(0.0)[0])
    assert found["x"]["likelihood_ratio"] == pytest.approx(ratio, abs=1e-3) and found["x"]["ratio_p"] == pytest.approx(math.erfc(math.sqrt(ratio / 2)), rel=1e-2)

    def full(p):
        f = np.eye(n) - p[2] * w
        res = f @ (y - X @ p[:2]) if error else f @ y - X @ p[:2]
        return np.linalg.slogdet(f)[1] - n / 2 * np.log(2 * np.pi * p[3]) - (res**2).sum() / (2 * p[3])

    at, step = np.array([*beta, low, s2]), np.array([1e-4] * 4)
    hess = np.array([[(full(at + step * (np.eye(4)[a] + np.eye(4)[b])) - full(at + step * (np.eye(4)[a] - np.eye(4)[b])) - full(at - step * (np.eye(4)[a] - np.eye(4)[b])) + full(at - step * (np.eye(4)[a] + np.eye(4)[b]))) / 4e-8 for b in range(4)] for a in range(4)])
    errors = np.sqrt(np.diag(np.linalg.inv(-hess)))
    assert [found[t]["error"] for t in ("intercept", "x", name)] == pytest.approx(errors[:3].tolist(), rel=0.02)


def test_log_determinant_by_probes(spark):
    n = 80
    weights, w = ring_weights(spark, n)
    rho = np.array([-0.6, 0.3, 0.8])
    exact = [np.linalg.slogdet(np.eye(n) - r * w)[1] for r in rho]
    assert autoregression.LogDeterminant(weights, n).at(rho) == pytest.approx(exact, abs=1e-9)
    rough = autoregression.LogDeterminant(weights, n, dense=0, order=8, probes=40)
    assert (np.abs(rough.at(rho) - exact) < 4 * rough.error(rho) + 0.3).all()


def test_tails():
    assert beta_share(0.3, 1, 1) == pytest.approx(0.3) and beta_share(0.5, 4, 4) == pytest.approx(0.5) and beta_share(0.2, 2, 3) == pytest.approx(0.1808)
    assert f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5)
    rng = np.random.default_rng(0)
    drawn = (rng.noncentral_chisquare(3, 5.0, 400_000) / 3) / (rng.chisquare(12, 400_000) / 12)
    assert f_tail(4.0, 3, 12, 5.0) == pytest.approx((drawn >= 4).mean(), abs=4e-3)


def test_factor_test(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 4, 200)
    y = g * 1.5 + rng.normal(size=200)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, y)], "g int, y double")
    r = statistics.factor_test(rows, "y", ["g"]).first()
    means, sizes = np.array([y[g == k].mean() for k in range(4)]), np.array([(g == k).sum() for k in range(4)])
    q = 1 - sum(n * y[g == k].var() for k, n in enumerate(sizes)) / (200 * y.var())
    shift = ((means**2).sum() - (np.sqrt(sizes) @ means) ** 2 / 200) / y.var(ddof=1)
    assert (r["q"], r["f"]) == (pytest.approx(q), pytest.approx(196 / 3 * q / (1 - q))) and r["p"] == pytest.approx(f_tail(r["f"], 3, 196, shift))


def test_multiscale_equals_dense_backfitting(spark):
    rng = np.random.default_rng(5)
    p = rng.random((60, 2)) * 10
    x = rng.normal(size=60)
    y = p[:, 0] + x * np.sin(p[:, 1] / 3) + 0.1 * rng.normal(size=60)
    rows = spark.createDataFrame([(k, *map(float, p[k]), float(x[k]), float(y[k])) for k in range(60)], "id long, x double, y double, a double, v double")
    widths, rounds = [3.5, 6.0, 20.0], 3
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    kernel = lambda b: np.where(d < b, (1 - (d / b) ** 2) ** 2, 0)
    X = np.stack([np.ones(60), x], axis=1)
    b = np.tile(np.linalg.lstsq(X, y, rcond=None)[0], (60, 1))
    chosen = [None, None]
    for _ in range(rounds):
        for k in range(2):
            part = y - (X * b).sum(axis=1) + X[:, k] * b[:, k]
            scores = []
            for width in widths:
                w = kernel(width) * (1 - np.eye(60))
                scores.append(((part - X[:, k] * (w @ (X[:, k] * part)) / (w @ X[:, k] ** 2)) ** 2).sum())
            chosen[k] = widths[int(np.argmin(scores))]
            w = kernel(chosen[k])
            b[:, k] = (w @ (X[:, k] * part)) / (w @ X[:, k] ** 2)
    found, got = multiscale.multiscale_regression(rows, "v", ["a"], widths, rounds=rounds)
    assert list(got.values()) == chosen
    assert np.allclose(np.array([r["beta"] for r in sorted(found.collect(), key=lambda r: r["id"])]), b, atol=1e-8)


def test_splines_by_loops(spark):
    rng = np.random.default_rng(9)
    pts = [(k, float(a), float(b), float(np.sin(a) + b * b / 9)) for k, (a, b) in enumerate(rng.random((70, 2)) * 5)]
    cells = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.random((30, 2)) * 6 - 0.5)]
    x, y, left = (np.array([p[c] for p in pts]) for c in (1, 2, 3))
    low, high = np.array([x.min(), y.min()]), np.array([x.max(), y.max()])
    basis = lambda t: np.array([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6

    def around(a, b, n):
        u = np.clip((np.array([a, b]) - low) / (high - low) * n, 0, n)
        i = np.minimum(np.floor(u), n - 1).astype(int)
        return i, np.outer(basis(u[0] - i[0]), basis(u[1] - i[1]))

    value, missed = np.zeros(30), []
    for level in range(3):
        n = 2 << level
        top, bottom = np.zeros((n + 3, n + 3)), np.zeros((n + 3, n + 3))
        for a, b, z in zip(x, y, left):
            i, w = around(a, b, n)
            top[i[0] : i[0] + 4, i[1] : i[1] + 4] += w**3 * z / (w**2).sum()
            bottom[i[0] : i[0] + 4, i[1] : i[1] + 4] += w**2
        phi = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
        at = lambda a, b: (lambda i, w: (w * phi[i[0] : i[0] + 4, i[1] : i[1] + 4]).sum())(*around(a, b, n))  # noqa: B023, E731
        left = left - np.array([at(a, b) for a, b in zip(x, y)])
        value += np.array([at(a, b) for _, a, b in cells])
        missed.append((left**2).mean())
    points, places = spark.createDataFrame(pts, "id long, x double, y double, v double"), spark.createDataFrame(cells, "id long, x double, y double")
    got = {r["id"]: r["v"] for r in splines.spline_surface(points, places, 3, 2).collect()}
    assert [got[k] for k in range(30)] == pytest.approx(value.tolist())
    found = splines.spline_lattices(points, 3, 2)[2]
    assert found == pytest.approx(missed) and found == sorted(found, reverse=True)
    assert {r["v"] for r in splines.spline_surface(points.limit(0), places).collect()} == {None}


def test_auto_fit_chooses_columns_and_width(spark):
    rng = np.random.default_rng(6)
    p, a, b = rng.random((90, 2)) * 10, rng.normal(size=90), rng.normal(size=90)
    y = 1 + a * (1 + p[:, 0] / 3) + 0.2 * rng.normal(size=90)
    rows = spark.createDataFrame([(k, *map(float, p[k]), float(a[k]), float(b[k]), float(y[k])) for k in range(90)], "id long, x double, y double, a double, b double, v double")
    fit, columns, width = regression.auto_fit(rows, "v", ["b", "a"], 3.0, 14.0, rounds=5)
    assert columns == ["a"] and 3.0 < width < 14.0
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    X = np.stack([np.ones(90), a], axis=1)

    def dense(bw):
        w = np.where(d < bw, (1 - (d / bw) ** 2) ** 2, 0)
        betas = np.array([np.linalg.solve((X * w[i][:, None]).T @ X, (X * w[i][:, None]).T @ y) for i in range(90)])
        hat = sum(X[i] @ np.linalg.solve((X * w[i][:, None]).T @ X, X[i]) for i in range(90))
        rss = ((y - (X * betas).sum(axis=1)) ** 2).sum()
        return 90 * np.log(rss / 90) + 90 * np.log(2 * np.pi) + 90 * (90 + hat) / (88 - hat), betas

    assert np.allclose([r["beta"] for r in sorted(fit.collect(), key=lambda r: r["id"])], dense(width)[1])
    assert dense(width)[0] <= min(dense(w)[0] for w in (4.0, 8.0, 13.0)) + 1e-6


def test_space_time_prediction(spark):
    rng = np.random.default_rng(7)
    p, t, x = rng.random((50, 2)) * 6, rng.integers(0, 5, 50), rng.normal(size=50)
    y = 2 + x + 0.1 * t
    rows = spark.createDataFrame([(k, *map(float, p[k]), int(t[k]), float(x[k]), float(y[k])) for k in range(50)], "id long, x double, y double, t int, a double, v double")
    places = spark.createDataFrame([(k, float(k), 3.0, 4, 0.5) for k in range(5)], "id long, x double, y double, t int, a double")
    got = {r["id"]: r["yhat"] for r in regression.space_time_prediction(rows, places, "v", ["a"], "t", 6.0, 0.6).collect()}
    for k in range(5):
        s, ago = np.hypot(p[:, 0] - k, p[:, 1] - 3), 4.0 - t
        d = 0.6 * s + 0.4 * ago + 2 * np.sqrt(0.24 * s * ago)
        w = np.where((ago >= 0) & (d <= 6), (1 - (d / 6) ** 2) ** 2, 0)
        X = np.stack([np.ones(50), x], axis=1)
        assert got[k] == pytest.approx(np.linalg.solve((X * w[:, None]).T @ X, (X * w[:, None]).T @ y) @ [1, 0.5])


@pytest.mark.parametrize("n", [2, 97, 1000])
def test_permutation_of_batches(spark, n):
    """The same as by columns, of keys far beyond the number of rows too; local permutations evaluated it by columns, row by row and twice."""
    rows = spark.range(n).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("name", F.col("t") * 123456789)
    got = rows.select(permutation.moved_by(n)(F.col("name"), F.col("id")).alias("a"), permutation.moved(F.col("id"), permutation.keys(F.col("name")), F.lit(n).cast("long")).alias("b")).collect()
    assert len(got) == 5 * n and all(r["a"] == r["b"] for r in got)


def test_weights_are_worked_out_once_and_not_broadcast(spark, monkeypatch):
    """Weights were worked out again in each step of the expansion, and small tables went to all tasks by way of the driver."""
    tables = []

    def kept(df, label):
        tables.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, label)

    stored = autoregression.stored
    monkeypatch.setattr(autoregression, "stored", kept)
    n = 40
    weights = spark.createDataFrame([(k, (k + d) % n, 0.5) for k in range(n) for d in (1, -1)], "i long, j long, w double")
    rows = spark.createDataFrame([(k, float(k * 7 % 11), float(k * 5 % 13)) for k in range(n)], "id long, x double, y double")
    autoregression.lag_model(rows, weights, "y", ["x"], dense=0, order=3, probes=4).collect()
    assert [label for label, _ in tables] == ["weights", "probes", "probes", "probes", "probes"]
    assert not any("BroadcastHashJoin" in plan for _, plan in tables)

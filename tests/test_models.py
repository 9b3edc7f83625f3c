"""Models that SQL can't express, against dense versions on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix.operators import autoregression, composite, interpolation, regression, spatial, statistics, terrain

POINTS = "id long, x double, y double, v double"


@pytest.fixture(scope="module")
def scattered():
    rng = np.random.default_rng(5)
    return [(k, float(x), float(y), float(2 + 0.1 * x - 0.05 * y + rng.normal())) for k, (x, y) in enumerate(rng.uniform(0, 50, (60, 2)))]


@pytest.fixture(scope="module")
def points(spark, scattered):
    return spark.createDataFrame(scattered, POINTS).cache()


def test_kriging_and_plates_pass_through_the_points(points, scattered):
    truth = {r[0]: r[3] for r in scattered}
    for found in (interpolation.kriging(points, points, 12, "Exp", 0.0, 2.0, 20.0), interpolation.thin_plate(points, points, 12)):
        assert {r["id"]: r["v"] for r in found.collect()} == pytest.approx(truth, abs=1e-6)


def test_kriging_of_all_points_equals_the_dense_system(points, scattered, spark):
    p = np.array(scattered)
    x, y, v = p[:, 1], p[:, 2], p[:, 3]
    gamma = lambda d: interpolation.semivariance(d, "Sph", 0.3, 2.0, 25.0)
    a = np.ones((61, 61))
    a[60, 60] = 0
    a[:60, :60] = gamma(np.hypot(x[:, None] - x, y[:, None] - y))
    cells = [(100, 10.0, 12.0), (101, 70.0, -3.0)]
    truth = {i: np.linalg.solve(a, np.append(gamma(np.hypot(x - cx, y - cy)), 1))[:60] @ v for i, cx, cy in cells}
    found = interpolation.kriging(points, spark.createDataFrame(cells, "id long, x double, y double"), 60, "Sph", 0.3, 2.0, 25.0)
    assert {r["id"]: r["v"] for r in found.collect()} == pytest.approx(truth, abs=1e-6)


def test_one_point_or_none(spark):
    cells = spark.createDataFrame([(1, 3.0, 4.0)], "id long, x double, y double")
    one = spark.createDataFrame([(7, 0.0, 0.0, 5.0)], POINTS)
    assert interpolation.thin_plate(one, cells).first()["v"] == pytest.approx(5.0) == interpolation.kriging(one, cells).first()["v"]
    assert interpolation.kriging(one.limit(0), cells).count() == 0 and interpolation.variogram(one, 5.0).count() == 0


def test_autoregressions_equal_the_dense_likelihood(spark):
    rng, n = np.random.default_rng(3), 144
    cells = [(k, k % 12, k // 12) for k in range(n)]
    near = [(i, j) for i, x, y in cells for j, u, v in cells if abs(x - u) + abs(y - v) == 1]
    w = np.zeros((n, n))
    for i, j in near:
        w[i, j] = 1
    w /= w.sum(axis=1, keepdims=True)
    x, e = rng.normal(size=n), rng.normal(size=n) * 0.5
    weights = spatial.styled(spark.createDataFrame(near, "i long, j long"), "W").cache()
    for error in (False, True):
        y = np.linalg.solve(np.eye(n) - 0.5 * w, e if error else 1 + 2 * x + e) + ((1 + 2 * x) if error else 0)
        X = np.stack([np.ones(n), x], axis=1)

        def likelihood(r):
            f = np.eye(n) - r * w
            b = np.linalg.lstsq(f @ X if error else X, f @ y, rcond=None)[0]
            rss = ((f @ y - (f @ X if error else X) @ b) ** 2).sum()
            return np.linalg.slogdet(f)[1] - n / 2 * np.log(rss), b

        grid = np.arange(-0.9, 0.95, 0.01)
        best = max(grid, key=lambda r: likelihood(r)[0])
        rows = spark.createDataFrame([(k, float(x[k]), float(y[k])) for k in range(n)], "id long, x double, y double")
        found = {r["term"]: r["coefficient"] for r in (autoregression.error_model if error else autoregression.lag_model)(rows, weights, "y", ["x"]).collect()}
        assert found["lambda" if error else "rho"] == pytest.approx(best, abs=0.03)
        assert found["x"] == pytest.approx(likelihood(best)[1][1], abs=0.03)


def test_space_time_regression_equals_brute_force(points, scattered):
    timed = points.withColumn("t", F.col("id") % 6)
    found = {r["id"]: r["beta"] for r in regression.space_time_regression(timed, "v", ["x"], "t", 15.0, 0.6).collect()}
    p = np.array(scattered)
    for i in range(60):
        s, ago = np.hypot(p[:, 1] - p[i, 1], p[:, 2] - p[i, 2]), (i % 6) - p[:, 0] % 6
        d = 0.6 * s + 0.4 * np.maximum(ago, 0) + 2 * np.sqrt(0.24 * s * np.maximum(ago, 0))
        w = np.where((ago >= 0) & (d <= 15), (1 - (d / 15) ** 2) ** 2, 0)
        if (w > 0).sum() > 4:
            X = np.stack([np.ones(60), p[:, 1]], axis=1)
            assert found[i] == pytest.approx(np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * p[:, 3])), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("family", ["poisson", "logistic"])
def test_local_generalised_models_settle_where_the_score_is_zero(points, scattered, family):
    p = np.array(scattered)
    n = (p[:, 0] * 7 % 5) if family == "poisson" else (p[:, 0] * 7 % 5 > 2).astype(float)
    data = points.withColumn("n", F.col("id") * 7 % 5 if family == "poisson" else (F.col("id") * 7 % 5 > 2).cast("int"))
    for r in regression.weighted_generalised(data, "n", ["x"], 60.0, family, rounds=10).collect():
        d = np.hypot(p[:, 1] - p[r["id"], 1], p[:, 2] - p[r["id"], 2])
        w = np.where(d <= 60, (1 - (d / 60) ** 2) ** 2, 0)
        eta = r["beta"][0] + r["beta"][1] * p[:, 1]
        mean = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        assert abs((w * (n - mean)).sum()) < 1e-3 and abs((w * (n - mean) * p[:, 1]).sum()) < 1e-2


def test_quadratic_discriminant(spark):
    rows = [(k, float(k % 10), 0.0, "a" if k < 50 else "b", (k % 10) * 0.1 if k < 50 else 10 + (k % 10) * 1.0) for k in range(100)]
    pts = spark.createDataFrame(rows, "id long, x double, y double, g string, v double")
    found = regression.weighted_discriminant(pts, "g", ["v"], 20.0, quadratic=True).collect()
    assert all(r["predicted"] == ("a" if r["id"] < 50 else "b") for r in found) and all(0 <= r["entropy"] <= 1 for r in found)


def test_medians_of_scenes(spark):
    cells = [("a", t, 0, 0, v) for t, v in enumerate((0.0, 4.0, 4.0, 9.0))] + [("b", t, 0, 0, v) for t, v in enumerate((0.0, 4.0, 5.0, 9.0))] + [("a", 9, 0, 0, 50.0), ("b", 9, 0, 0, None)]
    cube = spark.createDataFrame(cells, "band string, instant int, px int, py int, value double")
    assert tuple(composite.medoid(cube, ["a", "b"]).first()) == (0, 0, 1, 4.0, 4.0)
    v = np.array([[0, 0], [4, 4], [4, 5], [9, 9]], float)
    r = composite.geometric_median(cube, ["a", "b"]).first()
    total = lambda p: np.linalg.norm(v - p, axis=1).sum()
    at = np.array([r["a"], r["b"]])
    assert all(total(at) <= total(at + np.array(step)) + 1e-6 for step in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))
    assert composite.masked(cube, spark.createDataFrame([(0, 0, 0, 7), (0, 0, 0, 7)], "instant int, px int, py int, code int"), [7]).where("value is null").count() == 3


def test_flat_ground_has_no_aspect(spark):
    cells = spark.createDataFrame([("a", x, y, 0.0) for x in range(3) for y in range(3)], "band string, px int, py int, value double")
    assert terrain.aspect(cells).where("value is not null").count() == 0
    assert terrain.hillshade(cells).agg(F.min("value")).first()[0] == pytest.approx(1 + 254 * np.sin(np.radians(45)))
    assert statistics.grid(cells.select(F.col("px").alias("x"), F.col("py").alias("y")), 2, 2).count() == 4

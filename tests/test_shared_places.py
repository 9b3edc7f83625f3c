"""Rows that share places, which are folded or meet once: against brute force over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix import queries
from rastrix.operators import interpolation, multiscale, overlay, permutation, regression, spatial, statistics
from rastrix.sources import fixtures as fx

WIDTH = 2.5


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return [(k, float(rng.integers(0, 6)), float(rng.integers(0, 5)), float(np.round(rng.normal() * 10, 2)), float(np.round(rng.random(), 3)), int(rng.integers(0, 3)), int(rng.integers(0, 6))) for k in range(120)]


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, v double, a double, n int, t int").repartition(3)


def around(rows, p, width=WIDTH):
    """Rows within the width of a place, with bisquare weights over 0."""
    found = [(q, math.hypot(p[1] - q[1], p[2] - q[2])) for q in rows]
    return [(q, (1 - (d / width) ** 2) ** 2) for q, d in found if d < width]


def test_pairs(points, rows, monkeypatch):
    truth = {(p[0], q[0]): (round(math.hypot(p[1] - q[1], p[2] - q[2]), 9), q[3]) for p in rows for q in rows if math.hypot(p[1] - q[1], p[2] - q[2]) <= 2}
    for block, pairs, least in ((256, 1 << 20, 256), (2, 20, 3)):  # cells cut into keys and places into blocks
        monkeypatch.setattr(spatial, "BLOCK_ROWS", block)
        monkeypatch.setattr(spatial, "KEY_PAIRS", pairs)
        monkeypatch.setattr(spatial, "KEY_ROWS", least)
        monkeypatch.setattr(spatial, "TASK_PAIRS", pairs * 8)
        found = spatial.within_distance(points, points, 2.0).collect()
        assert len(found) == len(truth) and {(r["i"], r["j"]): (round(r["d"], 9), r["vj"]) for r in found} == truth


def test_weights_are_rounded_once_a_pair_of_places(spark, sf_dir):
    """The query's weights are rounded below the explosion into pairs of rows, whose number grows with the square of the rows of a place."""
    df = queries.QUERIES["kernel_weights_gaussian"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and plan.index("Generate explode(_left") < plan.index("round(")
    truth = {(r["i"], r["j"]): round(r["w"], 6) for r in spatial.kernel_weights(fx.suppliers(spark, sf_dir), 10.0, "gaussian").collect()}
    assert {(r["i"], r["j"]): r["w"] for r in df.collect()} == truth


def test_width_zero_has_no_weight(points, rows):
    """Six rows and more share a place, so the sixth nearest is no way off; a division by zero stopped the job."""
    found = spatial.adaptive_weights(points, 3, "bisquare").collect()
    shared = {p[0] for p in rows if sum(p[1:3] == q[1:3] for q in rows) >= 3}
    assert shared and {r["i"] for r in found if math.isnan(r["w"])} == shared


def test_local_models(points, rows):
    fit = {r["id"]: r for r in regression.weighted_regression(points, "v", ["a"], WIDTH).collect()}
    mean = {r["id"]: r for r in regression.weighted_average(points, "v", WIDTH).collect()}
    corr = {r["id"]: r for r in regression.weighted_correlation(points, "a", "v", WIDTH).collect()}
    mids = {r["id"]: r for r in regression.weighted_quantiles(points, "v", WIDTH).collect()}
    pois = {r["id"]: r for r in regression.weighted_generalised(points, "n", ["a"], WIDTH).collect()}
    assert all(len(t) == len(rows) for t in (fit, mean, corr, mids, pois))
    for p in rows:
        near = around(rows, p)
        w, v, a, n = (np.array(c, float) for c in ([w for _, w in near], *[[q[k] for q, _ in near] for k in (3, 4, 5)]))
        x = np.stack([np.ones(len(w)), a], axis=1)
        assert fit[p[0]]["beta"] == pytest.approx(np.linalg.solve((x.T * w) @ x, (x.T * w) @ v), rel=1e-8)
        assert mean[p[0]]["mean"] == pytest.approx((w * v).sum() / w.sum()) and mean[p[0]]["variance"] == pytest.approx((w * v * v).sum() / w.sum() - ((w * v).sum() / w.sum()) ** 2)
        assert corr[p[0]]["covariance"] == pytest.approx(np.cov(a, v, aweights=w)[0, 1])
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(w[order])
        assert [mids[p[0]][f"q{q}"] for q in (25, 50, 75)] == [v[order][int(np.argmax(upto >= w.sum() * q / 100 - 1e-9))] for q in (25, 50, 75)]
        mu = n + 0.1
        eta = np.log(mu)
        for _ in range(6):
            beta = np.linalg.solve((x.T * (w * mu)) @ x, (x.T * (w * mu)) @ (eta + (n - mu) / mu))
            eta = np.clip(x @ beta, -30, 30)
            mu = np.exp(eta)
        assert pois[p[0]]["beta"] == pytest.approx(beta, rel=1e-4, abs=1e-5)


def test_left_out(points, rows):
    cv = regression.bandwidth_scores(points, "v", ["a"], [WIDTH]).first()["cv"]
    truth = 0.0
    for p in rows:
        near = [(q, w) for q, w in around(rows, p) if q[0] != p[0]]
        w, v, a = (np.array(c) for c in ([w for _, w in near], [q[3] for q, _ in near], [q[4] for q, _ in near]))
        x = np.stack([np.ones(len(w)), a], axis=1)
        truth += (p[3] - np.array([1.0, p[4]]) @ np.linalg.solve((x.T * w) @ x, (x.T * w) @ v)) ** 2
    assert cv == pytest.approx(truth, rel=1e-9)


def test_space_and_time(points, rows):
    found = {r["id"]: r["yhat"] for r in regression.space_time_regression(points, "v", [], "t", WIDTH, 0.5).collect()}
    for p in rows:
        s = w = 0.0
        for q in rows:
            d, ago = math.hypot(p[1] - q[1], p[2] - q[2]), p[6] - q[6]
            if ago >= 0 and (far := 0.5 * d + 0.5 * ago + 2 * math.sqrt(0.25 * d * ago)) < WIDTH:
                s, w = s + (1 - (far / WIDTH) ** 2) ** 2 * q[3], w + (1 - (far / WIDTH) ** 2) ** 2
        assert found[p[0]] == pytest.approx(s / w)


def test_counts_of_pairs(points, rows):
    pairs = [(math.hypot(p[1] - q[1], p[2] - q[2]), (p[3] - q[3]) ** 2) for p in rows for q in rows if p[0] < q[0]]
    for r in interpolation.variogram(points, 3.0, 3).collect():
        own = [(d, s) for d, s in pairs if d <= 3 and min(int(d), 2) == r["bin"]]
        assert r["n"] == len(own) and r["d"] == pytest.approx(sum(d for d, _ in own) / len(own)) and r["gamma"] == pytest.approx(sum(s for _, s in own) / len(own) / 2)
    for r in statistics.ripley(points, 4).collect():
        assert r["l"] == pytest.approx(math.sqrt(20 * 2 * sum(d < r["d"] - 1e-9 for d, _ in pairs) / (math.pi * 120 * 119)))


def test_backfitting(points, rows):
    """One round for the intercept only, by its own sums: each row is left out of its own error."""
    found, widths = multiscale.multiscale_regression(points, "v", [], [1.5, 2.5], rounds=1)
    mean = sum(p[3] for p in rows) / len(rows)
    missed = {}
    for width in (1.5, 2.5):
        missed[width] = sum((p[3] - sum(w * q[3] for q, w in around(rows, p, width) if q[0] != p[0]) / sum(w for q, w in around(rows, p, width) if q[0] != p[0])) ** 2 for p in rows)
    best = min(missed, key=missed.get)
    assert widths["intercept"] == best and math.isfinite(mean)
    for r in found.collect():
        near = around(rows, rows[r["id"]], best)
        assert r["yhat"] == pytest.approx(sum(w * q[3] for q, w in near) / sum(w for _, w in near))


def test_equal_rings(spark):
    square = lambda x: [{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))]
    polygons = spark.createDataFrame([(k, square(float(3 * (k % 2) + k // 6))) for k in range(12)], "id long, ring array<struct<x:double,y:double>>")
    left = {k: 3 * (k % 2) + k // 6 for k in range(12)}
    found = overlay.polygon_join(polygons, polygons, 4.0).collect()
    assert sorted((r["i"], r["j"]) for r in found) == sorted((i, j) for i in left for j in left if abs(left[i] - left[j]) <= 2)


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_far_times_do_not_meet(spark, monkeypatch, share):
    """400 times at one place, each farther back than the width but for the own one and the next two: 400 * 400 pairs were formed before."""
    formed = []

    def joined(*given):
        formed.append(spatial.meeting(*given))
        return formed[-1]

    monkeypatch.setattr(regression, "meeting", joined, raising=False)
    times = spark.createDataFrame([(k, 1.0, 1.0, float(k % 7), 3 * k) for k in range(400)], "id long, x double, y double, v double, t int")
    found = {r["id"]: r["yhat"] for r in regression.space_time_regression(times, "v", [], "t", 4.0, share).collect()}
    weight = [(1 - ((1 - share) * 3 * back / 4) ** 2) ** 2 for back in range(400 if share == 1 else 3)]
    for k in range(400):
        w = weight[: k + 1]
        assert found[k] == pytest.approx(sum(w[b] * ((k - b) % 7) for b in range(len(w))) / sum(w))
    assert formed[0].count() <= (400 * 400 if share == 1 else 400 * 4)


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_discriminant_forms_no_pairs(spark, monkeypatch, most):
    """No pair of places is a row, in whole cells and in cells cut into parts; places' rows were copied to each part of a cell before, which filled the disk."""
    monkeypatch.setattr(spatial, "GROUP_ROWS", most)
    monkeypatch.setattr(spatial, "near_places", None)
    monkeypatch.setattr(regression, "near_places", None)
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random((500, 2)) * 8, rng.random((100, 2)) * 30])
    v, g = rng.normal(size=600) + p[:, 0], np.where(np.arange(600) < 3, 2, rng.integers(0, 2, 600))
    points = spark.createDataFrame([(k, float(p[k, 0]), float(p[k, 1]), float(v[k]), int(g[k])) for k in range(600)], "id long, x double, y double, v double, g int")
    found = {r["id"]: r for r in regression.weighted_discriminant(points, "g", ["v"], 5.0).collect()}
    assert len(found) == 600
    for k in range(600):
        w = (1 - np.minimum(((p - p[k]) ** 2).sum(axis=1) / 25, 1)) ** 2
        kinds = [c for c in range(3) if w[g == c].sum() > 0]
        s, m, q = (np.array([(w * v**a)[g == c].sum() for c in kinds]) for a in (0, 1, 2))
        m, q, share = m / s, q / s, s / s.sum()
        spread = (share * (q - m * m)).sum() + 1e-6 * max(1, (share * q).sum())
        score = np.log(share) - (v[k] - m) ** 2 / spread / 2
        e = np.exp(score - score.max())
        assert found[k]["predicted"] == kinds[int(score.argmax())] and found[k]["share"] == pytest.approx(e.max() / e.sum(), rel=1e-7)


def test_backfitting_goes_on_until_it_stands(spark):
    """Four rounds, as many as the query had, leave coefficients far from where plain rounds end."""
    rng = np.random.default_rng(3)
    p = rng.integers(0, 6, (80, 2)).astype(float)
    a, v = p[:, 0] + rng.random(80), rng.normal(size=80) + p[:, 0] * np.sin(p[:, 1] / 3)
    points = spark.createDataFrame([(k, float(p[k, 0]), float(p[k, 1]), float(a[k]), float(v[k])) for k in range(80)], "id long, x double, y double, a double, v double")
    found, _ = multiscale.multiscale_regression(points, "v", ["a"], [5.0])
    w = np.maximum(1 - ((p[:, None] - p[None]) ** 2).sum(axis=2) / 25, 0) ** 2
    x, b, after = np.stack([np.ones(80), a], axis=1), np.tile(np.linalg.lstsq(np.stack([np.ones(80), a], axis=1), v, rcond=None)[0], (80, 1)), []
    for done in range(5000):
        for k in range(2):
            b[:, k] = (w @ (x[:, k] * (v - x[:, 1 - k] * b[:, 1 - k]))) / (w @ x[:, k] ** 2)
        after += [b.copy()] * (done in (3, 4998))
    assert np.abs(b - after[1]).max() < 1e-9 and np.abs(b - after[0]).max() > 1e-2
    assert np.allclose(np.array([r["beta"] for r in sorted(found.collect(), key=lambda r: r["id"])]), b, atol=1e-4)


def test_envelope_draws_patterns_in_tasks(spark, points, rows, monkeypatch):
    """Patterns are drawn slice by slice where their pairs are counted; each pair was a row before."""
    monkeypatch.setattr(permutation, "SLICE", 37)
    monkeypatch.setattr(permutation, "within_distance", None, raising=False)
    found = sorted(permutation.ripley_envelope(points, 4, 3).collect(), key=lambda r: r["d"])
    x, y = (np.array([p[c] for p in rows]) for c in (1, 2))
    wide, high = np.ptp(x), np.ptp(y)
    step = max(wide, high) / 16

    def upto(x, y):
        d = np.hypot(x[:, None] - x, y[:, None] - y)[~np.eye(len(x), dtype=bool)]
        return [math.sqrt(wide * high * (np.floor(d / step) < k).sum() / (math.pi * 120 * 119)) for k in range(1, 5)]

    k = np.arange(120)
    mixed = lambda x, key: (((x + key) % permutation.PRIME) ** 2 % permutation.PRIME + key) % permutation.PRIME * permutation.FACTOR % permutation.PRIME
    drawn = np.array([upto(*(mixed(mixed(k, 2 * t + c), c + 11) / permutation.PRIME * side for c, side in ((0, wide), (1, high)))) for t in (1, 2, 3)])
    assert [r["l"] for r in found] == pytest.approx(upto(x, y))
    assert [r["low"] for r in found] == pytest.approx(drawn.min(axis=0)) and [r["high"] for r in found] == pytest.approx(drawn.max(axis=0))

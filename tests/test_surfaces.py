"""Triangles around places by their definition, and rasters on other grids."""

import numpy as np
import pytest

from rastrix.operators import triangulation, warp


def test_triangles_hold_no_other_point(spark):
    rng = np.random.default_rng(11)
    pts = np.concatenate([rng.random((200, 2)) * 100, rng.normal(size=(300, 2)) * 0.5 + 40])  # a third of the area's points in one place
    places = np.concatenate([rng.random((70, 2)) * 110 - 5, rng.normal(size=(20, 2)) * 0.5 + 40])
    value = lambda p: 3 * p[0] - 2 * p[1] + 7
    table = spark.createDataFrame([(k, float(x), float(y), float(value((x, y)))) for k, (x, y) in enumerate(pts)], "id long, x double, y double, v double")
    cells = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "id long, x double, y double")
    found = {r["id"]: r["tri"] for r in triangulation.triangles_around(table, cells).collect()}
    assert found.keys() == set(range(90))
    for k, q in enumerate(places):
        turn = np.sort(np.arctan2(*(pts - q).T[::-1]))
        gap = max(np.diff(turn).max(), turn[0] + 2 * np.pi - turn[-1])
        if found[k] is None:  # outside of the hull: all points on one side of a line through the place
            assert gap >= np.pi - 1e-9
            continue
        assert gap < np.pi + 1e-9
        a, b, c = (np.array([p["x"], p["y"]]) for p in found[k])
        cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
        signs = [np.sign(cross(v - u, q - u)) for u, v in ((a, b), (b, c), (c, a))]
        assert abs(sum(signs)) == 3
        m = np.array([[*(2 * (b - a))], [*(2 * (c - a))]])
        middle = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        assert (np.hypot(*(pts - middle).T) >= np.hypot(*(a - middle)) * (1 - 1e-9)).all()
    got = {r["id"]: r["v"] for r in triangulation.tin(table, cells).collect()}
    assert all(got[k] is None if found[k] is None else got[k] == pytest.approx(value(q), abs=1e-6) for k, q in enumerate(places))


def test_triangles_of_few_points(spark):
    two = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 1.0, 1.0, 2.0), (3, 1.0, 1.0, 9.0)], "id long, x double, y double, v double")
    places = spark.createDataFrame([(7, 0.2, 0.1)], "id long, x double, y double")
    for t in (two, two.limit(0)):
        assert [tuple(r) for r in triangulation.tin(t, places).collect()] == [(7, None)]


def test_warp_by_loops(spark):
    rng = np.random.default_rng(3)
    held = {(x, y): float(rng.integers(0, 50)) for x in range(6) for y in range(5) if (x, y) not in ((2, 2), (0, 4))}
    cells = spark.createDataFrame([("b", x, y, v) for (x, y), v in held.items()], "band string, px long, py long, value double")
    source, target = warp.Grid(10.0, 20.0, 2.0, -2.0), warp.Grid(9.5, 21.0, 0.7, -0.9)
    truth = {"nearest": {}, "bilinear": {}}
    for px in range(-3, 30):
        for py in range(-3, 30):
            u, v = (9.5 + (px + 0.5) * 0.7 - 10) / 2, (21 - (py + 0.5) * 0.9 - 20) / -2
            at = (int(np.floor(u)), int(np.floor(v)))
            if at in held:
                truth["nearest"][px, py] = held[at]
                i, j = int(np.floor(u - 0.5)), int(np.floor(v - 0.5))
                near = [(held[i + a, j + b], abs(1 - a - (u - 0.5 - i)) * abs(1 - b - (v - 0.5 - j))) for a in (0, 1) for b in (0, 1) if (i + a, j + b) in held]
                truth["bilinear"][px, py] = sum(z * w for z, w in near) / sum(w for _, w in near)
    for method, wanted in truth.items():
        got = {(r["px"], r["py"]): r["value"] for r in warp.warped(cells, source, target, method).collect()}
        assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in wanted)
    assert warp.warped(cells.limit(0), source, target).count() == 0
    with pytest.raises(ValueError):
        warp.warped(cells, source, warp.Grid(crs="EPSG:1"))

"""Views and shadows by loops over rays."""

import math

import numpy as np
import pytest

from rastrix.operators import sight


@pytest.fixture(scope="module")
def ground():
    rng = np.random.default_rng(2)
    hill = np.add.outer(np.sin(np.arange(64) / 7), np.cos(np.arange(64) / 5)) * 12 + rng.random((64, 64)) * 4
    return {(x, y): float(hill[x, y]) for x in range(64) for y in range(64) if (x * 7 + y) % 23}


@pytest.fixture(scope="module")
def cells(spark, ground):
    return spark.createDataFrame([("b", x, y, v) for (x, y), v in ground.items()], "band string, px long, py long, value double").repartition(4)


def test_viewshed_by_lines_of_sight(cells, ground):
    vx, vy, radius, eye = 30, 27, 24, ground[30, 27] + 2.0
    best = {}
    for face in range(4):
        ahead = 1 if face % 2 == 0 else -1
        for k in range(-radius, radius + 1):
            horizon = None
            for m in range(1, radius + 1):
                off = k * m / radius
                spot = (lambda o: (vx + ahead * m, vy + o)) if face < 2 else (lambda o: (vx + o, vy + ahead * m))  # noqa: B023
                low = math.floor(off)
                near = [(ground[p], w) for o, w in ((low, 1 - (off - low)), (low + 1, off - low)) if w > 0 and (p := spot(o)) in ground]
                at = spot(math.floor(off + 0.5))
                if at in ground and near:
                    rank = (abs(off - math.floor(off + 0.5)), face * (2 * radius + 1) + k + radius, m)
                    if at not in best or rank < best[at][0]:
                        slope = (ground[at] - eye) / math.hypot(at[0] - vx, at[1] - vy)
                        best[at] = (rank, int(horizon is None or slope >= horizon))
                if near:
                    h = sum(v * w for v, w in near) / sum(w for _, w in near)
                    slope = (h - eye) / (m * math.sqrt(1 + (k / radius) ** 2))
                    horizon = slope if horizon is None else max(horizon, slope)
    got = {(r["px"], r["py"]): r["value"] for r in sight.viewshed(cells, vx, vy, 2.0, radius).collect()}
    assert got.pop((vx, vy)) == 1
    assert got == {p: v for p, (_, v) in best.items()} and 0.05 < np.mean(list(got.values())) < 0.95
    assert sight.viewshed(cells.limit(0), 1, 1).count() == 0


@pytest.mark.parametrize("azimuth", [100.0, 170.0, 295.0, 20.0])
def test_shadows_by_rays(cells, ground, azimuth):
    east, south, rise = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth)), math.tan(math.radians(20))
    major = abs(east) >= abs(south)
    slant = south / east if major else east / south
    ahead = 1 if (east if major else south) > 0 else -1
    lines = {}
    for (x, y), v in ground.items():
        lead, drift = (x, y) if major else (y, x)
        lines.setdefault(math.floor(drift - lead * slant + 0.5), []).append((lead, v, (x, y)))
    truth = {}
    for line in lines.values():
        for lead, v, at in line:
            truth[at] = int(any((o - lead) * ahead > 0 and h > v + abs(o - lead) * math.sqrt(1 + slant**2) * 2 * rise + 1e-9 for o, h, _ in line))
    got = {(r["px"], r["py"]): r["value"] for r in sight.shadows(cells, azimuth, 20.0, 2.0).collect()}
    assert got == truth and 0 < np.mean(list(got.values())) < 1

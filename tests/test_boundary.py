"""Overlay of irregular polygons and rasters under them, against tests of single points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix.operators import boundary, zonal

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(rng, cx, cy, n):
    turn, far = np.sort(rng.random(n)) * 2 * np.pi, 1 + 4 * rng.random(n)
    return list(zip((cx + far * np.cos(turn)).tolist(), (cy + far * np.sin(turn)).tolist()))


def inside(rings, x, y):
    return sum(((p["y"] <= y) != (q["y"] <= y)) and p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]) > x for r in rings for p, q in zip(r, r[1:])) % 2 == 1


SQUARE, HOLE, ELL = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)], [(2, 2), (6, 2), (6, 3), (3, 3), (3, 6), (2, 6)]


@pytest.mark.parametrize("operation,wanted", [("union", lambda a, b: a or b), ("intersection", lambda a, b: a and b), ("difference", lambda a, b: a and not b), ("symmetric_difference", lambda a, b: a != b)])
def test_overlay_of_irregular_polygons(spark, operation, wanted):
    rng = np.random.default_rng(1)
    fixed = [([ring(SQUARE), ring(HOLE)], [ring(ELL)]), ([ring(SQUARE)], [ring(SQUARE)]), ([ring(SQUARE)], [ring([(4, 0), (8, 0), (8, 4), (4, 4)])]), ([ring(SQUARE)], [ring([(4, 4), (5, 4), (5, 5), (4, 5)])]), ([ring(SQUARE)], [ring([(1, 1), (2, 1), (2, 2), (1, 2)])]), ([ring(SQUARE)], [ring([(9, 9), (10, 9), (9, 10)])]), ([ring(SQUARE)], [])]
    pairs = fixed + [([ring(star(rng, 0, 0, 12)), ring([(9, 9), (9.5, 9), (9, 9.5)])], [ring(star(rng, *(rng.random(2) * 4), 15))]) for _ in range(12)]
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"id long, a {RINGS}, b {RINGS}")
    found = {r["id"]: [[{"x": p["x"], "y": p["y"]} for p in x["ring"]] for x in r["rings"]] for r in boundary.paired(table, operation, side=2.0).collect()}
    assert found.keys() == set(range(len(pairs)))
    for k, (a, b) in enumerate(pairs):
        for x, y in rng.random((150, 2)) * 14 - 4:
            assert inside(found[k], x, y) == wanted(inside(a, x, y), inside(b, x, y)), (k, x, y)


def test_overlay_gives_parts_and_holes(spark):
    table = spark.createDataFrame([(1, [ring(SQUARE), ring(HOLE)], [ring(ELL)])], f"id long, a {RINGS}, b {RINGS}")
    got = boundary.paired(table, "union").select("rings", boundary.area_of(F.col("rings")).alias("a"), boundary.length_of(F.col("rings")).alias("l")).first()
    assert (got["a"], got["l"]) == (17.0, 32.0) and [(x["part"], x["hole"]) for x in got["rings"]] == [(0, False), (0, True)]
    apart = boundary.paired(table, "difference").first()["rings"]
    assert [x["part"] for x in apart] == [0, 1] and not any(x["hole"] for x in apart)


def test_union_of_many(spark):
    rng = np.random.default_rng(4)
    shapes = [(k % 2, k, [ring(star(rng, *(rng.random(2) * 8), 9))]) for k in range(14)]
    got = {r["g"]: [[{"x": p["x"], "y": p["y"]} for p in x["ring"]] for x in r["rings"]] for r in boundary.dissolved(spark.createDataFrame(shapes, f"g int, id long, rings {RINGS}"), "g", side=3.0).collect()}
    for x, y in rng.random((300, 2)) * 16 - 4:
        for g in (0, 1):
            assert inside(got[g], x, y) == any(inside(r, x, y) for h, _, r in shapes if h == g)


def test_runs_of_irregular_polygons(spark):
    rng = np.random.default_rng(6)
    shapes = [(k, [ring(star(rng, *(rng.random(2) * 20), 14))] + ([ring(star(rng, 8, 8, 5))] if k % 3 == 0 else [])) for k in range(9)]
    table = spark.createDataFrame(shapes, f"id long, rings {RINGS}")
    cells = [("b", x, y, float(rng.integers(0, 9)) if rng.random() > 0.1 else None) for x in range(-6, 30) for y in range(-6, 30)]
    raster = spark.createDataFrame(cells, "band string, px long, py long, value double")
    size = 0.75
    under = {k: [(x, y, v) for _, x, y, v in cells if v is not None and inside(rings, (x + 0.5) * size, (y + 0.5) * size)] for k, rings in shapes}
    got = {r["id"]: (r["n"], r["total"], r["least"], r["most"], r["mean"]) for r in zonal.zonal(raster, table, size).collect()}
    assert got == {k: (len(v), sum(x[2] for x in v), min(x[2] for x in v), max(x[2] for x in v), pytest.approx(np.mean([x[2] for x in v]))) for k, v in under.items() if v}
    assert {(r["id"], r["px"], r["py"], r["value"]) for r in zonal.masked(raster, table, size).collect()} == {(k, *c) for k, v in under.items() for c in v}
    assert zonal.zonal(raster.limit(0), table).count() == zonal.zonal(raster, table.limit(0)).count() == 0


def test_equal_pieces_are_folded(spark, monkeypatch):
    """30 squares in a row of half steps, three of each: their pieces were kept once for each polygon (before: 4 a polygon at least)."""
    tables, stored = [], boundary.stored
    monkeypatch.setattr(boundary, "stored", lambda df, label: tables.append(stored(df, label)) or tables[-1])
    shapes = [(0, k, [ring([(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)])]) for k in range(90) for x in [k % 30 / 2]]
    got = boundary.dissolved(spark.createDataFrame(shapes, f"g int, id long, rings {RINGS}"), "g").select(boundary.area_of(F.col("rings")).alias("a"), boundary.length_of(F.col("rings")).alias("l"), F.size("rings").alias("n")).first()
    assert (got["a"], got["l"], got["n"]) == (15.5, 33.0, 1)
    assert tables[-1].count() <= 31 * 2 + 32

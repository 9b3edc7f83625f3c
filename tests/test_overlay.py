"""Polygons, files, catalogues and model selection on cases of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix.operators import feature, image, overlay, regression, statistics
from rastrix.plans import catalogue
from rastrix.sources import files

RING = "array<struct<x:double,y:double>>"


def square(x, y, size=1.0):
    x, y = float(x), float(y)
    return [(x, y), (x + float(size), y), (x + float(size), y + float(size)), (x, y + float(size)), (x, y)]


def test_predicates_of_squares(spark):
    cases = [
        (square(0, 0), square(2, 0), "disjoint"),
        (square(0, 0), square(1, 0), "touches"),
        (square(0, 0), square(1, 1), "touches"),
        (square(0, 0), square(0.5, 0.5), "overlaps"),
        (square(0, 0, 3), square(1, 1), "covers"),
        (square(1, 1), square(0, 0, 3), "covered_by"),
        (square(0, 0), square(0, 0), "equal"),
    ]
    table = spark.createDataFrame(cases, f"a {RING}, b {RING}, kind string")
    a, b = F.col("a"), F.col("b")
    found = table.select("kind", *[f(a, b).alias(f.__name__) for f in (overlay.disjoint, overlay.intersects, overlay.touches, overlay.overlaps, overlay.covers, overlay.covered_by)]).collect()
    for r in found:
        assert r["disjoint"] == (r["kind"] == "disjoint") == (not r["intersects"]), r
        assert r["touches"] == (r["kind"] == "touches") and r["overlaps"] == (r["kind"] == "overlaps"), r
        assert r["covers"] == (r["kind"] in ("covers", "equal")) and r["covered_by"] == (r["kind"] in ("covered_by", "equal")), r
    apart = table.select(overlay.distance(a, b).alias("d"), overlay.shared_area(a, b).alias("s")).collect()
    assert [round(r["d"], 9) for r in apart] == [1.0, 0, 0, 0, 0, 0, 0]
    assert [round(r["s"], 9) for r in apart] == [0, 0, 0, 0.25, 1.0, 1.0, 1.0]


def test_convex_hull(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(y)) for g in "ab" for x, y in rng.integers(0, 30, (200, 2))] + [("c", 1.0, 1.0), ("c", 2.0, 2.0)]
    table = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    hulls = {r["g"]: [(p["x"], p["y"]) for p in r["ring"]] for r in overlay.convex_hull(table, "g").collect()}
    for g in "ab":
        ring, points = hulls[g], [(x, y) for k, x, y in rows if k == g]
        assert set(ring) <= set(points) and ring[0] == ring[-1]
        for p, q in zip(ring, ring[1:]):  # all points lie left of or on each edge
            assert all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for x, y in points)
    assert hulls["c"] == [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]


def test_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([(1, "2.5", "3", "7"), (2, None, "x", "8")], "id int, lon string, lat string, v string").write.option("header", True).csv(path)
    read = files.read_csv(spark, path, "id int, lon double, lat double, v double")
    assert [tuple(r) for r in files.point_rows(read, "lon", "lat", "v", "id").collect()] == [(1, 2.5, 3.0, 7.0)]
    texts = spark.createDataFrame([("POINT (1 2)",), ("LINESTRING(0 0,  1 1)",), ("polygon ((0 0, 1 0, 0 1, 0 0))",), ("nothing",), (None,)], "t string")
    found = texts.select(files.geometry_type(F.col("t")).alias("kind"), files.from_wkt(F.col("t")).alias("p")).collect()
    assert [r["kind"] for r in found] == ["POINT", "LINESTRING", "POLYGON", "NOTHING", None]
    assert [r["p"] and [tuple(p) for p in r["p"]] for r in found] == [[(1, 2)], [(0, 0), (1, 1)], [(0, 0), (1, 0), (0, 1), (0, 0)], None, None]
    lines = str(tmp_path / "json")
    files.write_lines(spark.createDataFrame([(5, square(0, 0), {"a": "b"})], f"id int, ring {RING}, props map<string,string>").select(files.to_geojson(F.col("id"), F.col("ring"), F.col("props")).alias("line")), "line", lines)
    back = spark.read.text(lines).select(files.from_geojson(F.col("value")).alias("f")).select("f.*").first()
    assert back["id"] == "5" and [tuple(p) for p in back["ring"]] == square(0, 0) and back["props"] == {"a": "b"}


def test_unknown_filter():
    with pytest.raises(ValueError):
        catalogue.condition({"like": ["a", "b"]})


def test_bandwidth_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y), float(np.sin(x / 4) + 0.1 * rng.normal())) for k, (x, y) in enumerate(rng.uniform(0, 40, (120, 2)))]
    points = spark.createDataFrame(rows, "id long, x double, y double, v double")
    best = regression.best_bandwidth(points, "v", ["x"], 8.0, 40.0, rounds=4)
    scores = {r["width"]: r["cv"] for r in regression.bandwidth_scores(points, "v", ["x"], [best, 35.0]).collect()}
    assert scores[best] < scores[35.0]
    assert overlay.polygon_join(*[spark.createDataFrame([], f"id long, ring {RING}")] * 2, 1.0).count() == 0
    cells = spark.createDataFrame([], "band string, px long, py long, value double")
    assert image.gradient(cells).count() == image.entropy(cells).count() == image.filled(cells, cells, 2.0).count() == 0
    assert statistics.numbered(points.limit(0), ["v"]).count() == 0


def test_clip_leaves_nothing_outside(spark):
    table = spark.createDataFrame([(square(0, 0),), (square(5, 5),)], f"ring {RING}")
    found = [r[0] for r in table.select(overlay.clipped_area(F.col("ring"), 0.25, -1.0, 9.0, 0.5)).collect()]
    assert found == [0.375, 0.0]
    assert [round(r[0], 6) for r in table.select(feature.area(overlay.buffer(F.lit(0.0), F.lit(0.0), 1.0, 4))).collect()] == [2.0, 2.0]

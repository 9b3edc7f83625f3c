"""Every query against its SQL on the smallest tables, and operators on cases of their own."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix import queries
from rastrix.operators import coverage, feature, regression, spatial, statistics, tiles
from rastrix.plans.expression import compile_graph
from rastrix.streaming import windows

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return found


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)[:19]
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    truth = db.execute(queries.ORACLE_SQL[name])
    assert canonical(df.columns, rows) == canonical([c[0] for c in truth.description], truth.fetchall())


def test_nearest_goes_on_until_all_are_settled(spark):
    pts = spark.createDataFrame([(k, float(k % 3), 0.0, 1.0) for k in range(9)] + [(100, 1e6, 1e6, 2.0)], "id long, x double, y double, v double")
    found = spatial.nearest(pts, pts, 3, same=True).collect()
    assert len(found) == 30 and sorted(r["j"] for r in found if r["i"] == 100) == [2, 5, 8] and sorted(r["j"] for r in found if r["i"] == 0) == [1, 3, 6]
    assert spatial.nearest(pts.limit(0), pts, 3).count() == spatial.nearest(pts, pts.limit(0), 3).count() == 0


@pytest.mark.parametrize("levels,points", [(10, 512), (2, 6)])
def test_nearest_of_uneven_points(spark, monkeypatch, levels, points):
    """Clusters, shared places and far points, in a tree of many levels and in one that is cut often."""
    monkeypatch.setattr(spatial, "LEVELS", levels)
    monkeypatch.setattr(spatial, "CELL_POINTS", points)
    rng = np.random.default_rng(8)
    near = [(float(x), float(y)) for x, y in rng.normal(size=(120, 2)) * 1e-3 + 5] + [(float(x), float(y)) for x, y in rng.random((60, 2)) * 100] + [(7.0, 7.0)] * 25 + [(1e6, -1e6), (-4e5, 3e5)]
    other = [(float(x), float(y)) for x, y in rng.random((40, 2)) * 300 - 100] + [(7.0, 7.0)] * 3 + [(5e6, 0.0)]
    make = lambda p: spark.createDataFrame([(k, *q, 0.0) for k, q in enumerate(p)] + [(900, None, 1.0, 0.0)], "id long, x double, y double, v double").repartition(4)
    for a, b, k, same in ((near, near, 4, True), (other, near, 3, False), (near, other, 60, False)):
        got = {(r["i"], r["rank"]): (r["j"], round(r["d"], 9)) for r in spatial.nearest(make(a), make(b), k, same).collect()}
        truth = {}
        for i, p in enumerate(a):
            order = sorted((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5, j) for j, q in enumerate(b) if not same or i != j)[:k]
            truth |= {(i, r + 1): (j, round(d, 9)) for r, (d, j) in enumerate(order)}
        assert got == truth


def test_bands_must_be_there(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, None)], "band string, px int, py int, value double")
    assert coverage.select_bands(cells, ["b"]).count() == 1
    for bands in (["a", "a"], ["a", "c"]):
        with pytest.raises(ValueError):
            coverage.select_bands(cells, bands)
    assert [r["value"] for r in coverage.unary(cells, "sqrt").orderBy("band").collect()] == [1.0, None]


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "id long, ring array<struct<x:double,y:double>>")
    r = df.select(feature.area(F.col("ring")).alias("a"), feature.length(F.col("ring")).alias("l"), feature.centroid(F.col("ring")).alias("c"), feature.geojson(F.col("ring")).alias("g"), feature.contains(F.col("ring"), F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (r["a"], r["l"], tuple(r["c"]), r["o"]) == (8.0, 12.0, (2.0, 1.0), False)
    assert json.loads(r["g"])["coordinates"] == [[list(p) for p in ring]]
    back = df.select(feature.reproject(feature.reproject(F.col("ring"), "EPSG:3857"), "EPSG:4326").alias("r")).first()["r"]
    assert all(p["x"] == pytest.approx(x, abs=1e-9) and p["y"] == pytest.approx(y, abs=1e-9) for p, (x, y) in zip(back, ring))


def test_regressions(spark):
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 5), 3.0 + 2 * (k % 7) - (k % 5)) for k in range(60)], "id long, a double, b double, y double")
    assert [round(r["coefficient"], 6) for r in regression.linear(rows, "y", ["a", "b"]).collect()] == [3.0, 2.0, -1.0]
    counts = rows.withColumn("n", F.round(F.exp(0.2 + 0.3 * F.col("a"))))
    assert abs(regression.generalised(counts, "n", ["a"], "poisson").collect()[1]["coefficient"] - 0.3) < 0.05


def test_graphs(spark):
    cells = spark.createDataFrame([("a", 0, 0, 2.0)], "band string, px int, py int, value double")
    call = lambda name, **args: {"functionInvocationValue": {"functionName": name, "arguments": args}}
    source = call("Service.getCoverage", id={"constantValue": "c"})
    graph = {"0": call("CoverageCollection.map", c=source, f={"functionDefinitionValue": {"argumentNames": ["x"], "body": "1"}}), "1": call("Coverage.add", a={"argumentReference": "x"}, b={"argumentReference": "x"})}
    wrong = [{"0": call("Coverage.add", coverage1=source)}, {"0": call("Coverage.add", coverage1=source, coverage2=source, coverage3=source)}, {"0": call("Coverage.add", a=source, coverage1=source, b=source)}, {"0": call("Service.getCoverage", coverageID={"constantValue": "d"})}]
    assert compile_graph(json.dumps(graph), {"c": cells}).first()["value"] == 4.0
    for bad in ({"0": {"valueReference": "0"}}, {"0": call("No.such")}, {"0": {"valueReference": "7"}}, *wrong):
        with pytest.raises(ValueError):
            compile_graph(json.dumps(bad), {"c": cells})


def test_bands_meet_by_name_or_by_order(spark):
    make = lambda rows: spark.createDataFrame([(b, 0, 0, v) for b, v in rows], "band string, px int, py int, value double")
    found = lambda a, b: sorted((r["band"], r["value"]) for r in coverage.paired(make(a), make(b), "subtract").collect())
    assert found([("a", 5.0), ("b", 7.0)], [("b", 1.0), ("a", 2.0)]) == [("a", 3.0), ("b", 6.0)]
    assert found([("a", 5.0), ("b", 7.0)], [("y", 1.0), ("x", 2.0)]) == [("a", 3.0), ("b", 6.0)]
    with pytest.raises(ValueError):
        found([("a", 5.0)], [("x", 1.0), ("y", 2.0)])


@pytest.mark.parametrize("radius", [1, 2])
def test_windows_over_many_tiles(spark, radius):
    rng = np.random.default_rng(5)
    held = {(int(x), int(y)): None if k % 9 == 0 else float(rng.integers(0, 6)) for k, (x, y) in enumerate(rng.integers(-9, 14, (260, 2)))}
    cells = spark.createDataFrame([("b", t, x, y, v if v is None else v + t) for (x, y), v in held.items() for t in (1, 2)], "band string, instant int, px long, py long, value double").repartition(5)
    around = lambda x, y, t: [v + t for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if (v := held.get((x + dx, y + dy))) is not None]
    for method, f in (("mean", np.mean), ("median", np.median), ("min", min), ("max", max), ("sum", sum), ("mode", lambda v: min(v, key=lambda x: (-v.count(x), x)))):
        got = {(r["px"], r["py"], r["instant"]): r["value"] for r in tiles.windows(cells, radius, tiles.REDUCERS[method], side=4).collect()}
        assert got.keys() == {(x, y, t) for x, y in held for t in (1, 2)}
        for (x, y, t), v in got.items():
            near = around(x, y, t)
            assert (v is None) == (not near) and (v is None or v == pytest.approx(f(near)))
    back = tiles.untiled(tiles.tiled(cells, 4), 4)
    assert sorted(map(str, back.select(cells.columns).collect())) == sorted(map(str, cells.collect()))


def test_tiles_send_their_borders_only(spark):
    cells = spark.range(64 * 64).select(F.lit("b").alias("band"), (F.col("id") % 64).alias("px"), F.floor(F.col("id") / 64).alias("py"), F.lit(1.0).alias("value"))
    held = tiles.with_halo(tiles.tiled(cells, 16), 1, 16)
    assert held.agg(F.sum(F.size("halo"))).first()[0] == 24 * 16 * 2 + 9 * 4  # both sides of 24 shared borders of 16 cells, and four corners at each of nine crossings
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "6 hours", "60 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == windows.tumbling(batch, "6 hours").count()
    assert windows.sliding(batch, "6 hours", "3 hours").agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_ranks_share_ties(spark):
    rows = spark.createDataFrame([(x,) for x in (5.0, 1.0, 5.0, 2.0, None)], "v double")
    assert dict(tuple(r) for r in statistics.ranks(rows, "v").collect()) == {1.0: 1.0, 2.0: 2.0, 5.0: 3.5}

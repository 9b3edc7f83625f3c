"""Rasters under polygons: shapes as runs of cells.

A polygon is, in each row of cells, the runs between its edges' crossings with the row's middle, so it takes a few rows of a table for
each row of cells it meets instead of one for each cell, however large it is. Raster rows are cut to strips of STRIP cells, each one row
with an array; a run meets the strips it lies over by an equi-join and takes their share of its statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import keys_of

#: Cells in a strip of a raster row.
STRIP = 256


def runs(polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(id, py, x0, x1) of polygons (id, rings): the cells x0 to x1 of row py have their middle inside; holes and parts as rings meet a ray an odd number of times."""
    edges = polygons.select("id", F.explode("rings").alias("r")).select("id", F.explode(F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e"))
    edges = edges.select("id", *[(F.col(f"e.{k}.{c}") / size).alias(f"{k}{c}") for k in "pq" for c in "xy"]).where("py <> qy")
    first, last = (F.ceil(f(F.col("py"), F.col("qy")) - 0.5).cast("long") for f in (F.least, F.greatest))  # rows whose middle lies from the lower end on, below the upper one
    rows = edges.where(last > first).withColumn("row", F.explode(F.sequence(first, last - 1)))
    at = F.col("px") + (F.col("row") + 0.5 - F.col("py")) / (F.col("qy") - F.col("py")) * (F.col("qx") - F.col("px"))
    crossed = rows.groupBy("id", "row").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    each = crossed.select("id", "row", "xs", F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).alias("k"))
    edge = lambda k: F.ceil(F.get("xs", k) - 0.5).cast("long")
    return each.select("id", F.col("row").alias("py"), edge(F.col("k") * 2).alias("x0"), (edge(F.col("k") * 2 + 1) - 1).alias("x1")).where("x0 <= x1")


def strips(cells: DataFrame) -> DataFrame:
    """(band, instant if there is one, py, strip, cells: array of px, value) of the cells with a value."""
    keys = keys_of(cells)
    return cells.where("value is not null").groupBy(*keys, "py", F.floor(F.col("px") / STRIP).alias("strip")).agg(F.collect_list(F.struct(F.col("px").cast("long").alias("px"), F.col("value").cast("double").alias("value"))).alias("cells"))


def _met(cells: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Each run with the cells of a strip that lie in it."""
    spread = runs(polygons, size).withColumn("strip", F.explode(F.sequence(F.floor(F.col("x0") / STRIP), F.floor(F.col("x1") / STRIP))))
    return strips(cells).join(spread, ["py", "strip"]).withColumn("cells", F.filter("cells", lambda c: (c.px >= F.col("x0")) & (c.px <= F.col("x1")))).where(F.size("cells") > 0)


def zonal(cells: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(band, instant if there is one, id, n, total, mean, least, most) of the cells whose middle lies in each polygon; one without any has no row."""
    own = _met(cells, polygons, size).select(*keys_of(cells), "id", F.transform("cells", lambda c: c.value).alias("v"))
    parts = own.select(*keys_of(cells), "id", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda t, x: t + x).alias("total"), F.array_min("v").alias("least"), F.array_max("v").alias("most"))
    found = parts.groupBy(*keys_of(cells), "id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return found.withColumn("mean", F.col("total") / F.col("n"))


def masked(cells: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(band, instant if there is one, id, px, py, value): the cells whose middle lies in each polygon."""
    met = _met(cells, polygons, size)
    return met.select(*keys_of(cells), "id", "py", F.explode("cells").alias("c")).select(*keys_of(cells), "id", "c.px", "py", "c.value")


def histogram(cells: DataFrame, polygons: DataFrame, width: float, size: float = 1.0) -> DataFrame:
    """(band, instant if there is one, id, bin, n): how many cells of each polygon have their value in each bin of a width."""
    own = _met(cells, polygons, size).select(*keys_of(cells), "id", F.explode(F.transform("cells", lambda c: F.floor(c.value / width))).alias("bin"))
    return own.groupBy(*keys_of(cells), "id", "bin").agg(F.count("*").alias("n"))


def with_facts(zones: DataFrame, facts: DataFrame, per: str | None = None) -> DataFrame:
    """Zones (id, ...) with the facts of a table (id, columns); `per` names a fact by which the zones' totals are divided as `rate`."""
    found = zones.join(facts, "id")
    return found.withColumn("rate", F.try_divide(F.col("total"), F.col(per))) if per else found


def rasterised(polygons: DataFrame, size: float) -> DataFrame:
    """(px, py, value) of the cells whose middle lies in a polygon (id, rings, v); of several polygons the one of the largest id counts."""
    each = runs(polygons, size).join(polygons.select("id", "v"), "id").withColumn("px", F.explode(F.sequence("x0", "x1")))
    return each.groupBy("px", "py").agg(F.max_by("v", "id").alias("value"))

"""Rasters on other grids and in other coordinate systems.

A target cell's middle is mapped back to the source grid, and the cell takes the nearest source cell's value or the four nearest ones', weighed by their distance
(bilinear); weights of cells without data go to the others. Target cells are dealt out by the source cells they need, an equi-join, so
each source cell meets only what lies upon it. The targets are those whose middle falls on the source's extent, which one aggregate tells.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import atan, ceil, exp, floor, log, pi, radians, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import keys_of

#: The earth's radius of the web's Mercator projection; a fixed value.
RADIUS = 6378137.0


@dataclass(frozen=True)
class Grid:
    """Cell (0, 0) begins at x0, y0 and is width by height units large (a negative height: rows go down) in a coordinate system."""

    x0: float = 0.0
    y0: float = 0.0
    width: float = 1.0
    height: float = 1.0
    crs: str = "EPSG:4326"


def _mapped(x: Column, y: Column, of: str, to: str) -> tuple[Column, Column]:
    if of == to:
        return x, y
    if (of, to) == ("EPSG:4326", "EPSG:3857"):
        return F.radians(x) * RADIUS, F.log(F.tan(F.lit(pi / 4) + F.radians(y) / 2)) * RADIUS
    if (of, to) == ("EPSG:3857", "EPSG:4326"):
        return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - pi / 2)
    raise ValueError(f"no way from {of} to {to}")


def _corner(x: float, y: float, of: str, to: str) -> tuple[float, float]:
    if of == to:
        return x, y
    if to == "EPSG:3857":
        return radians(x) * RADIUS, log(tan(pi / 4 + radians(y) / 2)) * RADIUS
    return x / RADIUS * 180 / pi, (atan(exp(y / RADIUS)) * 2 - pi / 2) * 180 / pi


def warped(cells: DataFrame, source: Grid, target: Grid, method: str = "bilinear") -> DataFrame:
    """The cells (band, instant if there is one, px, py, value) of the target grid whose middle lies on a source cell that is there, by `nearest` or `bilinear`."""
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"unknown method: {method}")
    keys = keys_of(cells)
    edge = cells.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if edge[0] is None:
        return cells.select(*keys, "px", "py", F.col("value").cast("double").alias("value"))
    corners = [_corner(source.x0 + px * source.width, source.y0 + py * source.height, source.crs, target.crs) for px in (edge[0], edge[1] + 1) for py in (edge[2], edge[3] + 1)]
    span = lambda values, at, size: (floor(min((v - at) / size for v in values)), ceil(max((v - at) / size for v in values)))
    (left, right), (low, high) = span([c[0] for c in corners], target.x0, target.width), span([c[1] for c in corners], target.y0, target.height)
    wide = right - left
    places = cells.sparkSession.range(wide * (high - low)).select((F.lit(left) + F.col("id") % wide).alias("px"), (F.lit(low) + F.floor(F.col("id") / wide)).alias("py"))
    x, y = _mapped(F.lit(target.x0) + (F.col("px") + 0.5) * target.width, F.lit(target.y0) + (F.col("py") + 0.5) * target.height, target.crs, source.crs)
    seen = places.select("px", "py", ((x - source.x0) / source.width).alias("u"), ((y - source.y0) / source.height).alias("v"))
    own = seen.select("px", "py", "u", "v", F.floor("u").alias("sx"), F.floor("v").alias("sy"))
    held = cells.select(*keys, F.col("px").cast("long").alias("sx"), F.col("py").cast("long").alias("sy"), F.col("value").cast("double").alias("value"))
    if method == "nearest":
        return own.join(held, ["sx", "sy"]).select(*keys, "px", "py", "value")
    ends = lambda c: F.array(F.struct(F.floor(F.col(c) - 0.5).alias("at"), (1 - (F.col(c) - 0.5 - F.floor(F.col(c) - 0.5))).alias("w")), F.struct((F.floor(F.col(c) - 0.5) + 1).alias("at"), (F.col(c) - 0.5 - F.floor(F.col(c) - 0.5)).alias("w")))
    four = own.withColumn("a", F.explode(ends("u"))).withColumn("b", F.explode(ends("v"))).select("px", "py", "sx", "sy", F.col("a.at").alias("nx"), F.col("b.at").alias("ny"), (F.col("a.w") * F.col("b.w")).alias("w"))
    near = four.join(held.select(*keys, F.col("sx").alias("nx"), F.col("sy").alias("ny"), "value"), ["nx", "ny"])
    there = F.max((F.col("nx") == F.col("sx")) & (F.col("ny") == F.col("sy")))
    known = F.when(F.col("value").isNotNull(), F.col("w"))
    found = near.groupBy(*keys, "px", "py").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum(known)).alias("value"), there.alias("there"))
    return found.where("there").drop("there")


def aligned(a: DataFrame, a_grid: Grid, b: DataFrame, b_grid: Grid, method: str = "bilinear") -> tuple[DataFrame, DataFrame]:
    """Two coverages on the grid of the finer one, in the first one's coordinate system if they differ; a binary operator then joins the extent they share."""
    if a_grid.crs == b_grid.crs and abs(b_grid.width) < abs(a_grid.width):
        return warped(a, a_grid, b_grid, method), b
    return a, warped(b, b_grid, a_grid, method)

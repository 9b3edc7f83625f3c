"""Terrain measures over 3 x 3 windows, resampling, overlays of category maps and colours, and sensor calibration.

Coverages are tables of cells (band, px, py, value), and cubes have an instant as well; rows of py go south. Windows work on tiles that
exchange their borders.
"""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, radians, sin

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .coverage import CELL, REDUCERS, sobel
from .statistics import numbered


def _gradient(cells: DataFrame, size: float) -> DataFrame:
    """gx (to the east) and gy (to the south) by Horn's differences; cells that are not there count as 0."""
    return sobel(cells).withColumns({"gx": F.col("sobel_x") / (8 * size), "gy": F.col("sobel_y") / (8 * size)}).drop("sobel_x", "sobel_y")


def aspect(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """The compass direction in which the ground falls, 0 (north) to under 360 degrees; null where it is flat."""
    east, north = -F.col("gx"), F.col("gy")
    turned = F.degrees(F.atan2(east, north))
    return _gradient(cells, size).withColumn("value", F.when((F.col("gx") != 0) | (F.col("gy") != 0), F.when(turned < 0, turned + 360).otherwise(F.abs(turned)))).drop("gx", "gy")


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, size: float = 1.0) -> DataFrame:
    """Light from 1 (shade) to 255 by the angle between the ground's normal and the sun."""
    sun = sin(radians(altitude)) + cos(radians(altitude)) * (F.col("gy") * cos(radians(azimuth)) - F.col("gx") * sin(radians(azimuth)))
    light = sun / F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return _gradient(cells, size).withColumn("value", F.when(light > 0, 1 + 254 * light).otherwise(1.0)).drop("gx", "gy")


def _window(cells: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A measure of each cell's own value and those of the eight around it (NaN without data), where both are there."""
    found = tiles.windows(cells, 1, lambda values, there: measure(values[4], np.delete(values, 4, axis=0)))
    return found.where("value is not null")


def ruggedness(cells: DataFrame) -> DataFrame:
    """The mean absolute difference from the eight cells around."""
    return _window(cells, lambda own, around: np.nansum(np.abs(around - own), axis=0) / (~np.isnan(around - own)).sum(axis=0))


def position_index(cells: DataFrame) -> DataFrame:
    """The value less the mean of the eight cells around."""
    return _window(cells, lambda own, around: own - np.nansum(around, axis=0) / (~np.isnan(around)).sum(axis=0))


def roughness(cells: DataFrame) -> DataFrame:
    """The largest less the smallest value of the window."""
    apart = lambda own, around: np.fmax(own, np.fmax.reduce(around, axis=0)) - np.fmin(own, np.fmin.reduce(around, axis=0))
    return _window(cells, lambda own, around: np.where(np.isnan(own) | tiles.nothing(around), np.nan, apart(own, around)))


def coarser(cells: DataFrame, factor: int, method: str = "mean") -> DataFrame:
    """Blocks of factor x factor cells, aggregated."""
    block = lambda c: F.floor(F.col(c) / factor).alias(c)
    return cells.groupBy("band", block("px"), block("py")).agg(REDUCERS[method](F.col("value")).alias("value"))


def finer(cells: DataFrame, factor: int) -> DataFrame:
    """Every cell as factor x factor cells of its value."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return cells.withColumn("_x", F.explode(steps)).withColumn("_y", F.explode(steps)).select("band", (F.col("px") * factor + F.col("_x")).alias("px"), (F.col("py") * factor + F.col("_y")).alias("py"), "value")


def _both(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.select(*CELL, F.col("value").alias("a")).join(b.select(*CELL, F.col("value").alias("b")), CELL, how)


def patch(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's values; b's where a has none."""
    return _both(a, b, "full").select(*CELL, F.coalesce("a", "b").alias("value"))


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of categories that meet, numbered from 0 in their order."""
    pairs = _both(a, b)
    numbers = numbered(pairs.where("a is not null and b is not null"), ["a", "b"])
    return pairs.join(numbers, ["a", "b"]).select(*CELL, F.col("number").alias("value"))


def blend(a: DataFrame, b: DataFrame, percent: float) -> DataFrame:
    """percent of a, the rest of b."""
    return _both(a, b).select(*CELL, (F.col("a") * (percent / 100) + F.col("b") * (1 - percent / 100)).alias("value"))


def shade(relief: DataFrame, colour: DataFrame, brighten: float = 0.0) -> DataFrame:
    """Colours (0 to 255) dimmed by relief (0 to 255); brighten is -99 to 99 percent."""
    return _both(relief, colour).select(*CELL, F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("a") / 255 * F.col("b") * (1 + brighten / 100))).alias("value"))


def rgb(cells: DataFrame, bands: list[str], levels: int = 32) -> DataFrame:
    """(px, py, value): three bands of 0 to 255, each rounded down to one of `levels`, in one number red * levels**2 + green * levels + blue."""
    level = lambda b: F.floor(F.least(F.greatest(F.max(F.when(F.col("band") == b, F.col("value"))), F.lit(0.0)), F.lit(255.0)) * levels / 256)
    r, g, b = map(level, bands)
    return cells.where(F.col("band").isin(bands)).groupBy("px", "py").agg((r * levels * levels + g * levels + b).cast("long").alias("value"))


def add_bands(a: DataFrame, b: DataFrame, names: list[str], overwrite: bool = False) -> DataFrame:
    """a with the named bands of b; a band that both have is a's unless overwritten."""
    new = b.where(F.col("band").isin(names))
    keep, other = (new, a) if overwrite else (a, new)
    return keep.unionByName(other.join(keep.select("band").distinct(), "band", "left_anti"))


def rename_bands(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    return cells.replace(names, subset=["band"])


def radiance(cells: DataFrame, gain: float, bias: float) -> DataFrame:
    """gain * number + bias; 0 is no data."""
    return cells.withColumn("value", F.when(F.col("value") != 0, F.col("value") * gain + bias))


def sun_distance(day: Column) -> Column:
    """Astronomical units from the sun on a day of the year."""
    return 1 - 0.01674 * F.cos((day - 4) * (0.9856 * pi / 180))


def reflectance(cells: DataFrame, gain: float, bias: float, sun: float, zenith: float, distance: float, haze: float = 0.0) -> DataFrame:
    """Reflectance of radiance above the haze for a sun of that strength, zenith (degrees) and distance."""
    return radiance(cells, gain, bias).withColumn("value", (F.col("value") - haze) * (pi * distance * distance / (sun * cos(radians(zenith)))))

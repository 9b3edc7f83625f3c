"""Space-time cubes: selection, spectral indices, reductions over areas and times, change, and star-schema reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coverage import band_pair, normalized_difference, thresholded

AGGREGATES = {"min": F.min, "max": F.max, "avg": F.avg}


def subset(cube: DataFrame, bands: list[str] | None = None, start=None, end=None, bbox: tuple | None = None) -> DataFrame:
    """Bands, a closed interval of instants and a closed box of cells; all are filters that reach the scan."""
    if bands:
        cube = cube.where(F.col("band").isin(bands))
    if start is not None:
        cube = cube.where(F.col("instant").between(start, end if end is not None else start))
    if bbox:
        cube = cube.where(F.col("px").between(bbox[0], bbox[2]) & F.col("py").between(bbox[1], bbox[3]))
    return cube


def ndvi(cube: DataFrame) -> DataFrame:
    return normalized_difference(cube, "NIR", "Red")


def ndwi(cube: DataFrame) -> DataFrame:
    return normalized_difference(cube, "Green", "NIR")


def ndbi(cube: DataFrame) -> DataFrame:
    return normalized_difference(cube, "SWIR1", "NIR")


def mndwi(cube: DataFrame, threshold: float) -> DataFrame:
    return normalized_difference(cube, "Green", "SWIR1").withColumn("value", thresholded(F.col("value"), threshold))


def savi(cube: DataFrame, threshold: float) -> DataFrame:
    index = band_pair(cube, ["NIR", "Red"], lambda n, r: 1.5 * F.try_divide(n - r, n + r + 0.5))
    return index.withColumn("value", thresholded(F.col("value"), threshold))


def area_raster(cube: DataFrame, aggregate: str) -> DataFrame:
    """A reduction over instants for each cell and band."""
    return cube.groupBy("band", "px", "py").agg(AGGREGATES[aggregate]("value").alias("value"))


def area_series(cube: DataFrame, aggregate: str) -> DataFrame:
    """A reduction over cells for each instant and band."""
    return cube.groupBy("band", "instant").agg(AGGREGATES[aggregate]("value").alias("value"))


def area_value(cube: DataFrame, aggregate: str) -> DataFrame:
    """The reduction over instants of the reduction over cells."""
    return area_series(cube, aggregate).groupBy("band").agg(AGGREGATES[aggregate]("value").alias("value"))


def position_series(cube: DataFrame, px: int, py: int) -> DataFrame:
    return cube.where((F.col("px") == px) & (F.col("py") == py)).select("band", "instant", "value")


def position_value(cube: DataFrame, px: int, py: int, aggregate: str) -> DataFrame:
    return position_series(cube, px, py).groupBy("band").agg(AGGREGATES[aggregate]("value").alias("value"))


def change(index: DataFrame, first, second) -> DataFrame:
    """value(second) - value(first) for each cell that has both, by one aggregate."""
    keys = [c for c in index.columns if c not in ("instant", "value")]
    at = lambda t: F.max(F.when(F.col("instant") == t, F.col("value")))
    return index.where(F.col("instant").isin(first, second)).groupBy(*keys).agg((at(second) - at(first)).alias("value")).where("value is not null")


def water_share(index: DataFrame, threshold: float) -> DataFrame:
    """For each cell how many instants are valid, how many are water, and their share."""
    wet = F.count_if(F.col("value") > threshold)
    return index.groupBy("px", "py").agg(F.count("value").alias("n_valid"), wet.alias("n_water"), F.try_divide(wet, F.count("value")).alias("share"))


def rollup(facts: DataFrame, dimensions: list[str], measure: str) -> DataFrame:
    return facts.rollup(*dimensions).agg(F.sum(measure).alias("total"), F.count("*").alias("n"))


def data_cube(facts: DataFrame, dimensions: list[str], measure: str) -> DataFrame:
    return facts.cube(*dimensions).agg(F.sum(measure).alias("total"), F.count("*").alias("n"))

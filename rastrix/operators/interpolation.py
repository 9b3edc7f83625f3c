"""Kriging and thin plates over each cell's nearest points, so that no system grows with the number of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored
from .spatial import near_places, nearest


def variogram(points: DataFrame, reach: float, bins: int = 20) -> DataFrame:
    """(bin, n, d, gamma): mean distance and half the mean squared difference of the pairs in each of `bins` steps up to the reach."""
    step = reach / bins
    mean = points.agg(F.avg(F.col("v").cast("double"))).first()[0] or 0.0
    v = F.col("v").cast("double") - mean
    places = stored(points.groupBy("x", "y").agg(F.count("*").alias("n"), F.count("v").alias("k"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q")), "places")
    other = places.withColumnsRenamed({"n": "m", "k": "l", "s": "t", "q": "r"})
    # of two places each pair comes twice; within one, n rows form n (n - 1) / 2 pairs, whose squared differences sum up to k q - s s
    one = F.col("d") == 0
    part = lambda inside, between: F.when(one, inside).otherwise(between) / 2
    pairs = near_places(places, other, reach).select(
        "d",
        part(F.col("n") * (F.col("n") - 1), F.col("n") * F.col("m")).alias("n"),
        part(F.col("k") * (F.col("k") - 1), F.col("k") * F.col("l")).alias("k"),
        part(2 * (F.col("k") * F.col("q") - F.col("s") * F.col("s")), F.col("l") * F.col("q") + F.col("k") * F.col("r") - 2 * F.col("s") * F.col("t")).alias("square"),
    ).where("n > 0")
    binned = F.least(F.floor(F.col("d") / step), F.lit(bins - 1)).alias("bin")
    return pairs.groupBy(binned).agg(F.round(F.sum("n")).cast("long").alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("d"), (F.try_divide(F.sum("square"), F.sum("k")) / 2).alias("gamma"))


def fitted_variogram(points: DataFrame, reach: float, bins: int = 20) -> dict[str, float]:
    """nugget, sill and range: the first bin's value, and the middle bin's value and distance."""
    found = variogram(points, reach, bins).orderBy("bin").collect()  # one row a bin
    if not found:
        return {"nugget": 0.0, "sill": 1.0, "range": reach}
    middle = found[len(found) // 2]
    return {"nugget": found[0]["gamma"], "sill": max(middle["gamma"], 1e-12), "range": middle["d"]}


def semivariance(d: np.ndarray, model: str, nugget: float, sill: float, range_: float) -> np.ndarray:
    """Sph, Exp or Gau; 0 at no distance."""
    r = d / max(range_, 1e-12)
    shape = {"Sph": np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0), "Exp": 1 - np.exp(-r), "Gau": 1 - np.exp(-r * r)}[model]
    return np.where(d > 0, nugget + (sill - nugget) * shape, 0.0)


def _surface(points: DataFrame, cells: DataFrame, k: int, value) -> DataFrame:
    """(id, v) of `value(x, y of the cell; x, y, v of its k nearest points)`; at most k points are held for a cell."""
    near = nearest(cells, points, k).join(points.select(F.col("id").alias("j"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").cast("double").alias("pv")), "j")
    each = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "px", "py", "pv"))).alias("near"))
    placed = each.join(cells.select(F.col("id").alias("i"), "x", "y"), "i").select("i", "x", "y", *[F.col(f"near.{c}") for c in ("px", "py", "pv")])

    def solve(batches):
        for t in batches:
            yield pd.DataFrame({"id": t["i"], "v": [value(*row) for row in t[["x", "y", "px", "py", "pv"]].itertuples(index=False, name=None)]})

    return placed.mapInPandas(solve, f"id {cells.schema['id'].dataType.simpleString()}, v double")


def kriging(points: DataFrame, cells: DataFrame, k: int = 16, model: str = "Sph", nugget: float = 0.0, sill: float = 1.0, range_: float = 1.0) -> DataFrame:
    """(id, v) by ordinary kriging from each cell's k nearest points."""

    def value(x, y, px, py, pv) -> float:
        n = len(px)
        a = np.ones((n + 1, n + 1))
        a[n, n] = 0
        a[:n, :n] = semivariance(np.hypot(px[:, None] - px, py[:, None] - py), model, nugget, sill, range_)
        b = np.append(semivariance(np.hypot(px - x, py - y), model, nugget, sill, range_), 1.0)
        return float(np.linalg.lstsq(a, b, rcond=None)[0][:n] @ pv)

    return _surface(points, cells, k, value)


def thin_plate(points: DataFrame, cells: DataFrame, k: int = 16) -> DataFrame:
    """(id, v) of the thin plate (r**2 ln r and a plane) through each cell's k nearest points."""

    def value(x, y, px, py, pv) -> float:
        bent = lambda d: np.where(d > 0, d * d * np.log(np.maximum(d, 1e-300)), 0.0)
        n, mx, my = len(px), px.mean(), py.mean()
        flat = np.stack([np.ones(n), px - mx, py - my], axis=1)  # about the mean, so that one point or a line of them gives a level plane
        a = np.block([[bent(np.hypot(px[:, None] - px, py[:, None] - py)), flat], [flat.T, np.zeros((3, 3))]])
        c = np.linalg.lstsq(a, np.append(pv, np.zeros(3)), rcond=None)[0]
        return float(bent(np.hypot(px - x, py - y)) @ c[:n] + c[n:] @ (1.0, x - mx, y - my))

    return _surface(points, cells, k, value)

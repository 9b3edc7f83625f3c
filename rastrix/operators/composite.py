"""One picture of many scenes: masks by quality codes, and medians of the vectors of bands over time.

A pixel's group holds one short vector for each scene, however large the area is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked(cube: DataFrame, quality: DataFrame, codes: list[int]) -> DataFrame:
    """Cells (band, instant, px, py, value), null where the quality band (instant, px, py, code) has one of the codes."""
    hit = quality.where(F.col("code").isin(codes)).select("instant", "px", "py", F.lit(True).alias("_hit")).distinct()
    return cube.join(hit, ["instant", "px", "py"], "left").select("band", "instant", "px", "py", F.when(F.col("_hit").isNull(), F.col("value")).alias("value"))


def _scenes(cube: DataFrame, bands: list[str]) -> DataFrame:
    """(px, py, scenes: instant and vector), of scenes in which no band is missing, in order."""
    wide = cube.where(F.col("band").isin(bands)).groupBy("px", "py", "instant").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]).dropna(subset=bands)
    return wide.groupBy("px", "py").agg(F.sort_array(F.collect_list(F.struct("instant", F.array(*bands).alias("v")))).alias("scenes"))


def medoid(cube: DataFrame, bands: list[str]) -> DataFrame:
    """(px, py, instant, and a column for each band) of the scene with the least sum of distances to the others, ties to the earliest."""
    apart = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    total = lambda p: F.aggregate(F.transform("scenes", lambda q: apart(p["v"], q["v"])), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform("scenes", lambda p: F.struct(F.round(total(p), 9).alias("total"), p["instant"].alias("instant"), p["v"].alias("v"))))
    return _scenes(cube, bands).select("px", "py", best.alias("b")).select("px", "py", "b.instant", *[F.col("b.v")[k].alias(b) for k, b in enumerate(bands)])


def geometric_median(cube: DataFrame, bands: list[str], rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(px, py, and a column for each band): the point with the least sum of distances to all scenes, by Weiszfeld's rounds in batches of pixels."""
    source = _scenes(cube, bands).select("px", "py", F.transform("scenes", lambda s: s["v"]).alias("v"))
    kinds = dict(source.dtypes)

    def centre(v: np.ndarray) -> np.ndarray:
        at = v.mean(axis=0)
        for _ in range(rounds):
            d = np.maximum(np.linalg.norm(v - at, axis=1), 1e-12)
            new = (v / d[:, None]).sum(axis=0) / (1 / d).sum()
            settled, at = np.abs(new - at).max() <= tolerance, new
            if settled:
                break
        own = np.linalg.norm(v[:, None] - v, axis=2).sum(axis=1)  # the rounds creep up to a scene that is itself the median
        return v[own.argmin()] if own.min() <= np.linalg.norm(v - at, axis=1).sum() else at

    def solve(batches):
        for t in batches:
            found = np.array([centre(np.stack(v)) for v in t["v"]]).reshape(len(t), len(bands))
            yield pd.concat([t[["px", "py"]].reset_index(drop=True), pd.DataFrame(found, columns=bands)], axis=1)

    return source.mapInPandas(solve, f"px {kinds['px']}, py {kinds['py']}, " + ", ".join(f"`{b}` double" for b in bands))

"""Surfaces of cubic B-splines over a hierarchy of control lattices.

A lattice of n x n cells over the points' box has (n + 3) x (n + 3) control values. Each point pulls the sixteen around it towards what would meet
its value alone, weighed by the squares of the basis; a control value is the weighted mean, one aggregate of at most sixteen rows a point. The next lattice has cells
half as wide and is fitted to what this one leaves. A surface's value is the sum of all levels'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored


def basis(t: Column) -> list[Column]:
    """The four cubic basis functions at t in a cell."""
    return [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]


def _around(points: DataFrame, box: tuple[float, float, float, float], n: int) -> DataFrame:
    """Each point with the sixteen control places around it (k, l), their weight w, and the sum of the weights' squares."""
    u, v = (F.least(F.greatest((F.col(c) - low) / (high - low) * n, F.lit(0.0)), F.lit(float(n))) for c, low, high in (("x", box[0], box[1]), ("y", box[2], box[3])))
    placed = points.withColumns({"_u": u, "_v": v}).withColumns({"_i": F.least(F.floor("_u"), F.lit(n - 1)), "_j": F.least(F.floor("_v"), F.lit(n - 1))})
    placed = placed.withColumns({"_a": F.array(*basis(F.col("_u") - F.col("_i"))), "_b": F.array(*basis(F.col("_v") - F.col("_j")))})
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, w: s + w * w)
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.struct((F.col("_i") + p).alias("k"), (F.col("_j") + q).alias("l"), (F.get("_a", p) * F.get("_b", q)).alias("w")))))
    return placed.withColumn("squares", squares("_a") * squares("_b")).withColumn("s", F.explode(each)).select(*points.columns, "squares", "s.*")


def spline_lattices(points: DataFrame, levels: int = 4, first: int = 2) -> tuple[list[DataFrame], tuple[float, float, float, float], list[float]]:
    """The lattices (k, l, phi) of points (id, x, y, v), coarsest first, the box they lie over, and the mean square of what each level leaves."""
    known = points.where("x is not null and y is not null and v is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("v"))
    edge = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if edge[0] is None:
        return [], (0.0, 1.0, 0.0, 1.0), []
    box = (edge[0], edge[1] if edge[1] > edge[0] else edge[0] + 1, edge[2], edge[3] if edge[3] > edge[2] else edge[2] + 1)
    lattices, left, missed = [], known, []
    for level in range(levels):
        n = first << level
        pulled = _around(left, box, n)
        lattice = pulled.groupBy("k", "l").agg(F.try_divide(F.sum(F.pow("w", F.lit(3)) * F.col("v") / F.col("squares")), F.sum(F.col("w") * F.col("w"))).alias("phi"))
        lattices.append(stored(lattice, "lattice"))
        found = _summed(left.drop("v"), lattices[-1], box, n)
        left = stored(left.join(found, "id").select("id", "x", "y", (F.col("v") - F.col("s")).alias("v")), "left")
        missed.append(left.agg(F.avg(F.col("v") * F.col("v"))).first()[0])
    return lattices, box, missed


def _summed(places: DataFrame, lattice: DataFrame, box: tuple[float, float, float, float], n: int) -> DataFrame:
    """(id, s): a lattice's surface at places (id, x, y)."""
    return _around(places, box, n).join(lattice, ["k", "l"]).groupBy("id").agg(F.sum(F.col("w") * F.coalesce("phi", F.lit(0.0))).alias("s"))


def spline_surface(points: DataFrame, places: DataFrame, levels: int = 4, first: int = 2) -> DataFrame:
    """(id, v): the surface through points (id, x, y, v) at places (id, x, y); places outside of the points' box take the value at its border."""
    lattices, box, _ = spline_lattices(points, levels, first)
    if not lattices:
        return places.select("id", F.lit(None).cast("double").alias("v"))
    each = [_summed(places.select("id", "x", "y"), lattice, box, first << level) for level, lattice in enumerate(lattices)]
    return places.select("id").join(reduce(DataFrame.unionByName, each).groupBy("id").agg(F.sum("s").alias("v")), "id", "left")

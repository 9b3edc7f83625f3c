"""Linear interpolation over a Delaunay triangulation that is never built as a whole.

The triangle around a place is the one of three points whose circle holds no other. It is found for each place: of the points nearest to it, the
three around it whose plane through (x, y, x**2 + y**2) lies lowest there are the triangle among these. That is certain if no point of the table is
nearer to the circle's middle than the three, which a join of nearest rows tells; if some are, they join the three and the place
goes on. Each round's triangle lies lower, so the rounds end, after two or three for most. Places that their nearest points don't surround start
from three corners of the convex hull, and those outside of it have no value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored
from .overlay import convex_hull
from .spatial import nearest

#: Points that a place starts with, and points nearest to a circle's middle that it meets in a round.
START, MORE = 12, 6
POINT = "array<struct<id:long,x:double,y:double,v:double>>"


def lowest(q: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For places q (a row each) and as many points each (rows of x and y; NaN: none) the numbers of the three around it that lie lowest, or -1."""
    best, chosen = np.full(len(q), np.inf), np.full((len(q), 3), -1)
    # seen from the place, so that large coordinates cost no digits
    dx, dy = x - q[:, :1], y - q[:, 1:]
    lift = dx * dx + dy * dy
    with np.errstate(all="ignore"):
        for a, b, c in combinations(range(x.shape[1]), 3):
            u, v, w = (dx[:, i] * dy[:, j] - dx[:, j] * dy[:, i] for i, j in ((b, c), (c, a), (a, b)))
            area = u + v + w
            u, v, w = u / area, v / area, w / area
            height = u * lift[:, a] + v * lift[:, b] + w * lift[:, c]
            low = (u >= -1e-12) & (v >= -1e-12) & (w >= -1e-12) & (height < best - 1e-12 * np.abs(height))
            best[low] = height[low]
            chosen[low] = (a, b, c)
    return chosen


def _solved(sets: DataFrame) -> DataFrame:
    """(id, x, y, tri: the three points, or null; cx, cy, r: their circle) of places with points (id, x, y, points)."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["points"].tolist()
            size = max(3, max(map(len, points), default=3))
            xs, ys = (np.array([[p[c] for p in row] + [np.nan] * (size - len(row)) for row in points], float).reshape(len(points), size) for c in "xy")
            chosen = lowest(frame[["x", "y"]].to_numpy(float), xs, ys)
            out = []
            for row, three in zip(points, chosen, strict=True):
                if three[0] < 0:
                    out.append((None, None, None, None))
                    continue
                a, b, c = (row[k] for k in three)
                bx, by, cx, cy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - a["x"], c["y"] - a["y"]
                d = 2 * (bx * cy - by * cx)
                ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
                out.append(([a, b, c], a["x"] + ux, a["y"] + uy, (ux * ux + uy * uy) ** 0.5))
            tri, mx, my, r = zip(*out) if out else ((), (), (), ())
            yield frame[["id", "x", "y"]].assign(tri=list(tri), cx=np.array(mx, float), cy=np.array(my, float), r=np.array(r, float))

    return sets.select("id", "x", "y", "points").mapInPandas(run, f"id {kind}, x double, y double, tri {POINT}, cx double, cy double, r double")


def triangles_around(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, x, y, tri) of places (id, x, y): the Delaunay triangle around each of points (id, x, y, v), null outside of the hull. Of points in one place the least id counts; of several triangles on one circle any may be taken."""
    double = lambda t, *c: t.select(F.col("id"), *[F.col(k).cast("double").alias(k) for k in c]).where("x is not null and y is not null")
    points = double(points, "x", "y", "v").groupBy("x", "y").agg(F.min(F.struct(F.col("id").cast("long").alias("id"), "v")).alias("p")).select("p.id", "x", "y", "p.v")
    points, places = stored(points, "points"), double(places, "x", "y")
    own = points.select(F.col("id").alias("j"), F.struct("id", "x", "y", "v").alias("p"))
    none = places.sparkSession.createDataFrame([], f"id {dict(places.dtypes)['id']}, x double, y double, tri {POINT}, cx double, cy double, r double")
    near = nearest(places, points, START).join(own, "j").groupBy(F.col("i").alias("id")).agg(F.collect_list("p").alias("points"))
    first = stored(_solved(places.join(near, "id", "left").withColumn("points", F.coalesce("points", F.array().cast(POINT)))), "triangles")
    lost = first.where("tri is null")
    if not lost.isEmpty():
        hull = convex_hull(points.withColumn("_all", F.lit(0)).select("_all", "x", "y"), "_all").select("ring")
        corners = F.col("ring")
        # the fan of triangles from the first corner: the place lies in the one between two corners it is turned from otherwise
        side = lambda p, q: (q.x - p.x) * (F.col("y") - p.y) - (q.y - p.y) * (F.col("x") - p.x)
        fan = F.filter(F.sequence(F.lit(1), F.greatest(F.size(corners) - 3, F.lit(1))), lambda k: (side(F.get(corners, F.lit(0)), F.get(corners, k)) >= 0) & (side(F.get(corners, k), F.get(corners, k + 1)) >= 0) & (side(F.get(corners, k + 1), F.get(corners, F.lit(0))) >= 0))
        placed = lost.select("id", "x", "y").crossJoin(F.broadcast(hull)).where(F.size(corners) > 3).withColumn("k", F.get(fan, F.lit(0))).where("k is not null")  # one row, the hull
        three = placed.select("id", "x", "y", F.explode(F.array(F.get(corners, F.lit(0)), F.get(corners, F.col("k")), F.get(corners, F.col("k") + 1))).alias("c"))
        found = three.join(points.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.struct("id", "x", "y", "v").alias("p")), (F.col("c.x") == F.col("hx")) & (F.col("c.y") == F.col("hy"))).groupBy("id", "x", "y").agg(F.collect_list("p").alias("points"))
        none = none.unionByName(lost.join(found.select("id"), "id", "left_anti"))
        first = first.where("tri is not null").unionByName(_solved(found.join(near.withColumnRenamed("points", "near"), "id").withColumn("points", F.array_union("points", "near")).select("id", "x", "y", "points")))
        first = stored(first, "triangles")
    done, left = none, first
    while not left.isEmpty():
        met = nearest(left.select("id", F.col("cx").alias("x"), F.col("cy").alias("y")), points, MORE).join(own, "j").select(F.col("i").alias("id"), "d", "p")
        inside = met.join(left.select("id", "r", "tri"), "id").where((F.col("d") < F.col("r") * (1 - 1e-9)) & ~F.exists("tri", lambda t: t.id == F.col("p.id"))).groupBy("id").agg(F.collect_list("p").alias("more"))
        checked = stored(left.join(inside, "id", "left"), "checked")
        done = done.unionByName(checked.where("more is null").drop("more"))
        left = stored(_solved(checked.where("more is not null").select("id", "x", "y", F.concat("tri", "more").alias("points"))), "triangles")
    return done.select("id", "x", "y", "tri")


def tin(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, v): the plane through the corners of the triangle around each place; null outside of the points' hull."""
    a, b, c = (F.get("tri", F.lit(k)) for k in range(3))
    cross = lambda px, py, qx, qy: px * qy - qx * py
    whole = cross(b.x - a.x, b.y - a.y, c.x - a.x, c.y - a.y)
    u, v = cross(F.col("x") - a.x, F.col("y") - a.y, c.x - a.x, c.y - a.y) / whole, cross(b.x - a.x, b.y - a.y, F.col("x") - a.x, F.col("y") - a.y) / whole
    return triangles_around(points, places).select("id", F.when(F.col("tri").isNotNull(), a.v + u * (b.v - a.v) + v * (c.v - a.v)).alias("v"))

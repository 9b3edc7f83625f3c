"""Predicates and joins of polygons given as closed rings of (x, y) points; all of it column expressions.

Points on an edge are part of a polygon. A join deals boxes out to grid cells; a pair that meets in several cells is made in one
only: the cell of the lower left corner of the two boxes' overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feature import area, bounds, contains
from .spatial import blocks, meeting


def edges(ring: Column) -> Column:
    """The edges of a ring as structs of two points."""
    return F.filter(F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda e: e.p.isNotNull() & e.q.isNotNull())


def _side(e: Column, p: Column) -> Column:
    """On which side of an edge's line a point lies: -1, 0 or 1."""
    return F.signum((e.q.x - e.p.x) * (p.y - e.p.y) - (e.q.y - e.p.y) * (p.x - e.p.x))


def _on(e: Column, p: Column) -> Column:
    between = (p.x >= F.least(e.p.x, e.q.x)) & (p.x <= F.greatest(e.p.x, e.q.x)) & (p.y >= F.least(e.p.y, e.q.y)) & (p.y <= F.greatest(e.p.y, e.q.y))
    return (_side(e, p) == 0) & between


def _cross(e: Column, f: Column) -> Column:
    """Whether two edges cross at a point inside both."""
    return (_side(e, f.p) * _side(e, f.q) < 0) & (_side(f, e.p) * _side(f, e.q) < 0)


def on_edge(ring: Column, p: Column) -> Column:
    return F.exists(edges(ring), lambda e: _on(e, p))


def covers_point(ring: Column, p: Column) -> Column:
    """Whether a point lies inside a ring or on it."""
    return contains(ring, p.x, p.y) | on_edge(ring, p)


def _any_cross(a: Column, b: Column) -> Column:
    return F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: _cross(e, f)))


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons share a point."""
    return _any_cross(a, b) | F.exists(b, lambda p: covers_point(a, p)) | F.exists(a, lambda p: covers_point(b, p))


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def covers(a: Column, b: Column) -> Column:
    """Whether no point of b is outside of a, for a convex a or a b without edges that leave a between its corners."""
    return F.forall(b, lambda p: covers_point(a, p)) & ~_any_cross(a, b)


def covered_by(a: Column, b: Column) -> Column:
    return covers(b, a)


def _inner_points(ring: Column) -> Column:
    """Corners and the middles of edges."""
    return F.concat(ring, F.transform(edges(ring), lambda e: F.struct(((e.p.x + e.q.x) / 2).alias("x"), ((e.p.y + e.q.y) / 2).alias("y"))))


def _inside(a: Column, p: Column) -> Column:
    return contains(a, p.x, p.y) & ~on_edge(a, p)


def _interiors_meet(a: Column, b: Column) -> Column:
    return _any_cross(a, b) | F.exists(_inner_points(b), lambda p: _inside(a, p)) | F.exists(_inner_points(a), lambda p: _inside(b, p)) | (covers(a, b) & covers(b, a))


def touches(a: Column, b: Column) -> Column:
    """Whether they share points of their edges only."""
    return intersects(a, b) & ~_interiors_meet(a, b)


def overlaps(a: Column, b: Column) -> Column:
    """Whether their insides meet and neither covers the other."""
    return _interiors_meet(a, b) & ~covers(a, b) & ~covers(b, a)


def _to_edge(e: Column, p: Column) -> Column:
    dx, dy = e.q.x - e.p.x, e.q.y - e.p.y
    along = F.least(F.greatest(((p.x - e.p.x) * dx + (p.y - e.p.y) * dy) / F.when(dx * dx + dy * dy > 0, dx * dx + dy * dy).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    x, y = e.p.x + along * dx - p.x, e.p.y + along * dy - p.y
    return F.sqrt(x * x + y * y)


def distance(a: Column, b: Column) -> Column:
    """The least distance between two polygons; 0 if they share a point."""
    least = lambda r, s: F.array_min(F.flatten(F.transform(r, lambda p: F.transform(edges(s), lambda e: _to_edge(e, p)))))
    return F.when(intersects(a, b), 0.0).otherwise(F.least(least(a, b), least(b, a)))


def buffer(x: Column, y: Column, radius: float, corners: int = 32) -> Column:
    """A regular polygon around a point."""
    turn = F.sequence(F.lit(0), F.lit(corners))
    return F.transform(turn, lambda k: F.struct((x + radius * F.cos(F.radians((k % corners) * (360.0 / corners)))).alias("x"), (y + radius * F.sin(F.radians((k % corners) * (360.0 / corners)))).alias("y")))


def clipped(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of a polygon inside a box, cut at one side after another; a ring without points if nothing is left."""
    for axis, limit, keep in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        ring = _once(ring, _cutter(axis, limit, keep))
    return ring


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _cutter(axis: str, limit: float, keep: int) -> Callable[[Column], Column]:
    return lambda ring: _cut(ring, axis, limit, keep)


def _cut(ring: Column, axis: str, limit: float, keep: int) -> Column:
    """The part of a ring on one side of a line along an axis."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] - limit) * keep >= 0

    def at(e: Column) -> Column:
        share = (limit - e.p[axis]) / (e.q[axis] - e.p[axis])
        cross = {axis: F.lit(float(limit)), other: e.p[other] + share * (e.q[other] - e.p[other])}
        return F.struct(cross["x"].alias("x"), cross["y"].alias("y"))

    point = lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))
    step = lambda e: F.when(inside(e.p) & inside(e.q), F.array(point(e.q))).when(inside(e.p), F.array(at(e))).when(inside(e.q), F.array(at(e), point(e.q))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    cut = F.flatten(F.transform(edges(ring), step))
    return _once(cut, lambda c: F.when(F.size(c) > 0, F.concat(c, F.slice(c, 1, 1))).otherwise(c))


def clipped_area(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return _once(clipped(ring, x0, y0, x1, y1), lambda c: F.when(F.size(c) > 3, area(c)).otherwise(0.0))


def polygon_join(a: DataFrame, b: DataFrame, side: float, predicate: Callable[[Column, Column], Column] = intersects) -> DataFrame:
    """(i, j) of polygons of a and b (id, ring) for which a predicate that needs a common point holds. Rings that are equal meet once, with all their ids."""

    def dealt(polygons: DataFrame, name: str) -> DataFrame:
        rings = blocks(polygons.select("id", "ring"), ["ring"], f"ids_{name}", [F.col("id").alias(name)])
        boxed = rings.select(F.col(f"ids_{name}"), F.col("ring").alias(f"_{name}"), bounds(F.col("ring")).alias(f"box_{name}"))
        cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"box_{name}.{low}") / side), F.floor(F.col(f"box_{name}.{high}") / side)))
        return boxed.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))

    # a predicate costs about as much as sixteen rows
    pairs = meeting(dealt(a, "i"), dealt(b, "j"), ["cx", "cy"], "_i", ("greatest(4, size(ids_i))", "greatest(4, size(ids_j))"))
    low = lambda c: F.floor(F.greatest(F.col(f"box_i.{c}"), F.col(f"box_j.{c}")) / side)
    meet = (F.col("box_i.x0") <= F.col("box_j.x1")) & (F.col("box_j.x0") <= F.col("box_i.x1")) & (F.col("box_i.y0") <= F.col("box_j.y1")) & (F.col("box_j.y0") <= F.col("box_i.y1"))
    once = pairs.where(meet & (F.col("cx") == low("x0")) & (F.col("cy") == low("y0"))).where(predicate(F.col("_i"), F.col("_j")))
    return once.select(F.explode("ids_i").alias("_a"), "ids_j").select("_a", F.explode("ids_j").alias("_b")).select("_a.i", "_b.j")


def convex_hull(points: DataFrame, group: str) -> DataFrame:
    """(group, ring) of the points (group, x, y): each task takes the hull of its own points first, so a group of any size meets as a few corners."""
    import pandas as pd

    kind = points.schema[group].dataType.simpleString()

    def corners(t: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(set(zip(t["x"].tolist(), t["y"].tolist())))
        if len(rows) < 3:
            return pd.DataFrame(rows, columns=["x", "y"])
        out = []
        for way in (rows, rows[::-1]):  # the lower side, then the upper one
            part: list[tuple[float, float]] = []
            for p in way:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                    part.pop()
                part.append(p)
            out += part[:-1]
        return pd.DataFrame(out, columns=["x", "y"])

    def local(batches):
        for t in batches:
            for name, own in t.groupby(group, sort=False, dropna=False):
                yield corners(own).assign(**{group: name})[[group, "x", "y"]]

    def whole(t: pd.DataFrame) -> pd.DataFrame:
        found = corners(t).to_dict("records")
        return pd.DataFrame({group: [t[group].iloc[0]], "ring": [found + found[:1]]})

    few = points.select(group, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null").mapInPandas(local, f"{group} {kind}, x double, y double")
    return few.groupBy(group).applyInPandas(whole, f"{group} {kind}, ring array<struct<x:double,y:double>>")


def intersection(a: Column, b: Column) -> Column:
    """The part of a polygon inside a convex one, cut along one edge of that after another; a ring without points if they share no area."""
    turn = F.signum(F.aggregate(edges(b), F.lit(0.0), lambda t, e: t + e.p.x * e.q.y - e.q.x * e.p.y))
    point = lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def cut(ring: Column, line: Column) -> Column:
        height = lambda p: ((line.q.x - line.p.x) * (p.y - line.p.y) - (line.q.y - line.p.y) * (p.x - line.p.x)) * turn

        def at(e: Column) -> Column:
            share = height(e.p) / (height(e.p) - height(e.q))
            return F.struct((e.p.x + share * (e.q.x - e.p.x)).alias("x"), (e.p.y + share * (e.q.y - e.p.y)).alias("y"))

        step = lambda e: F.when((height(e.p) >= 0) & (height(e.q) >= 0), F.array(point(e.q))).when(height(e.p) >= 0, F.array(at(e))).when(height(e.q) >= 0, F.array(at(e), point(e.q))).otherwise(none)
        return _once(F.flatten(F.transform(edges(ring), step)), lambda c: F.when(F.size(c) > 0, F.concat(c, F.slice(c, 1, 1))).otherwise(c))

    return F.aggregate(edges(b), F.transform(a, point), cut)


def shared_area(a: Column, b: Column) -> Column:
    """The area of what a polygon and a convex one share; with either's own area it gives those of union and differences."""
    return _once(intersection(a, b), lambda c: F.when(F.size(c) > 3, area(c)).otherwise(0.0))


def dissolved(features: DataFrame, group: str) -> DataFrame:
    """(group, ax, ay, bx, by): the outer edges of the union of each group of gap-free polygons: those that one of them alone has."""
    each = features.select(group, F.explode(edges(F.col("ring"))).alias("e")).select(group, F.least("e.p", "e.q").alias("p"), F.greatest("e.p", "e.q").alias("q"))
    once = each.groupBy(group, "p", "q").agg(F.count("*").alias("n")).where("n = 1")
    return once.select(group, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def along(ring: Column, n: int) -> Column:
    """n points on each edge, evenly from its start on."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(F.transform(edges(ring), lambda e: F.transform(steps, lambda k: F.struct((e.p.x + (e.q.x - e.p.x) * k / n).alias("x"), (e.p.y + (e.q.y - e.p.y) * k / n).alias("y")))))


def rasterised(polygons: DataFrame, size: float) -> DataFrame:
    """(px, py, value) of the cells of a size whose middle lies in a polygon (id, ring, v); of several polygons the one of the largest id counts."""
    box = bounds(F.col("ring"))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"box.{low}") / size), F.floor(F.col(f"box.{high}") / size)))
    cells = polygons.withColumn("box", box).withColumn("px", span("x0", "x1")).withColumn("py", span("y0", "y1"))
    hit = cells.where(contains(F.col("ring"), (F.col("px") + 0.5) * size, (F.col("py") + 0.5) * size))
    return hit.groupBy("px", "py").agg(F.max_by("v", "id").alias("value"))

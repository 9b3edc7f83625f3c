"""Vector features: a geometry as rings or paths of points, and properties as a map.

Geometries are arrays of (x, y) structs; polygons are closed rings without holes. Properties are a map of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import from_mercator, to_mercator


def _segments(ring: Column, f) -> Column:
    """The sum of f(p, q) over neighbouring points of a ring or path."""
    nexts = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.filter(F.zip_with(ring, nexts, lambda p, q: F.when(q.isNotNull(), f(p, q))), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def area(ring: Column) -> Column:
    return F.abs(_segments(ring, lambda p, q: p.x * q.y - q.x * p.y)) / 2


def length(path: Column) -> Column:
    return _segments(path, lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)))


def centroid(ring: Column) -> Column:
    """Of the area; rings without area have the mean of their points."""
    twice = _segments(ring, lambda p, q: p.x * q.y - q.x * p.y)
    cx = _segments(ring, lambda p, q: (p.x + q.x) * (p.x * q.y - q.x * p.y))
    cy = _segments(ring, lambda p, q: (p.y + q.y) * (p.x * q.y - q.x * p.y))
    mean = lambda axis: F.aggregate(F.transform(ring, lambda p: p[axis]), F.lit(0.0), lambda s, x: s + x) / F.size(ring)
    return F.struct(F.when(twice != 0, cx / (3 * twice)).otherwise(mean("x")).alias("x"), F.when(twice != 0, cy / (3 * twice)).otherwise(mean("y")).alias("y"))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the parity of crossings of a ray to the right."""
    crossed = _segments(ring, lambda p, q: F.when(((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / F.when(q.y != p.y, q.y - p.y) + p.x), 1.0).otherwise(0.0))
    return crossed % 2 == 1


def reproject(ring: Column, to: str) -> Column:
    """EPSG:4326 and EPSG:3857 into each other."""
    change = {"EPSG:3857": to_mercator, "EPSG:4326": from_mercator}[to]

    def moved(p: Column) -> Column:
        x, y = change(p.x, p.y)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


def geojson(ring: Column) -> Column:
    points = F.array_join(F.transform(ring, lambda p: F.concat(F.lit("["), p.x.cast("string"), F.lit(","), p.y.cast("string"), F.lit("]"))), ",")
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), points, F.lit("]]}"))


def set_properties(features: DataFrame, properties: dict[str, str]) -> DataFrame:
    """The given properties over the features' own."""
    new = F.create_map(*[F.lit(x) for pair in properties.items() for x in pair])
    own = F.map_filter("props", lambda k, _: ~k.isin(list(properties)))
    return features.withColumn("props", F.map_concat(own, new))


def get_property(features: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return features.select("id", F.col("props")[name].try_cast(kind).alias(name))


def property_names(features: DataFrame) -> DataFrame:
    return features.select("id", F.array_join(F.array_sort(F.map_keys("props")), ",").alias("names"))

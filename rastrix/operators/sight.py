"""What is seen from a place, and what lies in shadow: horizons along rays.

Each ray is a group of its own and keeps the highest slope so far as a running maximum, so work grows with the cells and no cell is held against
all those before it. Cells are tables (band, px, py, value) of heights, `size` units wide and high; rows of py go south.
"""

from __future__ import annotations

from math import cos, radians, sin, tan

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def viewshed(cells: DataFrame, x: int, y: int, eye: float = 1.75, radius: int = 100, size: float = 1.0, target: float = 0.0) -> DataFrame:
    """(band, px, py, value: whether a target of a height above the ground is seen) of the cells up to `radius` columns and rows from the viewer's.

    Rays go to each cell of the square's rim; at each column (or row) they take the height between the two cells on either side. A cell is judged on the ray that
    passes nearest to its middle, by the steepest height before it there; where both cells beside a ray lack data, nothing blocks.
    """
    spark = cells.sparkSession
    r = float(radius)
    rays = spark.range(4 * (2 * radius + 1)).select(F.col("id").alias("ray"), F.floor(F.col("id") / (2 * radius + 1)).alias("face"), (F.col("id") % (2 * radius + 1) - radius).alias("k"))
    ahead, along = F.when(F.col("face") % 2 == 0, 1).otherwise(-1), F.col("face") < 2  # faces: east, west, south, north
    steps = rays.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(radius)))).withColumn("off", F.col("k") * F.col("m") / r)
    low = F.floor("off")
    sides = F.array(F.struct(low.alias("at"), (1 - (F.col("off") - low)).alias("w")), F.struct((low + 1).alias("at"), (F.col("off") - low).alias("w")))
    spot = lambda o: (F.when(along, x + ahead * F.col("m")).otherwise(x + o).cast("long"), F.when(along, y + o).otherwise(y + ahead * F.col("m")).cast("long"))
    held = cells.where("value is not null").select("band", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.col("value").cast("double").alias("value"))
    beside = steps.withColumn("s", F.explode(sides)).where("s.w > 0")
    px, py = spot(F.col("s.at"))
    met = beside.select("ray", "m", "k", px.alias("px"), py.alias("py"), F.col("s.w").alias("w")).join(held, ["px", "py"])
    heights = met.groupBy("band", "ray", "m", "k").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("h"))
    start = held.where((F.col("px") == x) & (F.col("py") == y)).select("band", (F.col("value") + eye).alias("eye"))  # a row a band
    slope = (F.col("h") - F.col("eye")) / (F.col("m") * size * F.sqrt(1 + F.col("k") * F.col("k") / (r * r)))
    before = Window.partitionBy("band", "ray").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    nx, ny = spot(F.floor(F.col("off") + 0.5))
    aim = steps.select("ray", "m", nx.alias("px"), ny.alias("py"), F.abs(F.col("off") - F.floor(F.col("off") + 0.5)).alias("miss")).join(held, ["px", "py"])
    # the nearest ray of each cell
    chosen = aim.groupBy("band", "px", "py").agg(F.min(F.struct("miss", "ray", "m")).alias("a"), F.first("value").alias("value")).select("band", "px", "py", "value", "a.ray", "a.m")
    highest = heights.join(F.broadcast(start), "band").withColumn("horizon", F.max(slope).over(before)).select("band", "ray", "m", "horizon", "eye")
    far = F.sqrt((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y)) * size
    seen = chosen.join(highest, ["band", "ray", "m"]).withColumn("value", (F.coalesce((F.col("value") + target - F.col("eye")) / far >= F.col("horizon"), F.lit(True))).cast("int"))
    own = held.where((F.col("px") == x) & (F.col("py") == y)).select("band", "px", "py", F.lit(1).alias("value"))
    return seen.select("band", "px", "py", "value").unionByName(own)


def shadows(cells: DataFrame, azimuth: float, altitude: float, size: float = 1.0) -> DataFrame:
    """(band, px, py, value: 1 in shadow) with the sun at an azimuth (degrees from north, clockwise) and an altitude. Cells are dealt out to rays that lead to the sun; a cell is in shadow if the ground nearer to the sun on its ray rises over the line from it to the sun."""
    east, south = sin(radians(azimuth)), -cos(radians(azimuth))
    major = abs(east) >= abs(south)
    lead, drift = (F.col("px"), F.col("py")) if major else (F.col("py"), F.col("px"))
    slant = south / east if major else east / south
    toward = (east if major else south) > 0
    ray = F.floor(drift - lead * slant + 0.5)
    run = size * (1 + slant * slant) ** 0.5 * (1 if toward else -1)  # units towards the sun for each step along the ray
    level = F.col("value") - lead * (run * tan(radians(altitude)))
    before = Window.partitionBy("band", "_ray").orderBy(lead.desc() if toward else lead.asc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.where("value is not null").withColumn("_ray", ray).withColumn("_level", level)
    found = placed.withColumn("_highest", F.max("_level").over(before))
    return found.select("band", "px", "py", F.coalesce((F.col("_highest") > F.col("_level") + 1e-9).cast("int"), F.lit(0)).alias("value"))

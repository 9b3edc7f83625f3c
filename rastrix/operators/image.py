"""Colour models, masks, distances and gaps of coverages (band, px, py, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import CELL, focal, sobel
from .feature import contains
from .spatial import nearest, within_distance


def _wide(cells: DataFrame, bands: list[str]) -> DataFrame:
    return cells.where(F.col("band").isin(bands)).groupBy("px", "py").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"_{k}") for k, b in enumerate(bands)]).where("_0 is not null and _1 is not null and _2 is not null")


def _tall(wide: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("band"), v.cast("double").alias("value")) for n, v in values.items()])
    return wide.select("px", "py", F.explode(pairs).alias("b")).select("b.band", "px", "py", "b.value")


def rgb_to_hsv(cells: DataFrame, red: str, green: str, blue: str, most: float = 255.0) -> DataFrame:
    """Bands hue (0 to 360), saturation and value (0 to 1) of three bands from 0 to `most`."""
    wide = _wide(cells, [red, green, blue])
    r, g, b = (F.col(f"_{k}") / most for k in range(3))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, F.pmod(60 * (g - b) / span, F.lit(360.0))).when(high == g, 60 * (b - r) / span + 120).otherwise(60 * (r - g) / span + 240)
    return _tall(wide, {"hue": hue, "saturation": F.when(high == 0, 0.0).otherwise(span / high), "value": high})


def hsv_to_rgb(cells: DataFrame, most: float = 255.0) -> DataFrame:
    """Bands red, green and blue from 0 to `most` of bands hue, saturation and value."""
    wide = _wide(cells, ["hue", "saturation", "value"])
    h, s, v = (F.col(f"_{k}") for k in range(3))

    def channel(shift: int) -> Column:
        k = F.pmod(h / 60 + shift, F.lit(6.0))
        return most * (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))

    return _tall(wide, {"red": channel(5), "green": channel(3), "blue": channel(1)})


def entropy(cells: DataFrame, width: float = 1.0) -> DataFrame:
    """Shannon's entropy in bits of each band's values in bins of a width."""
    bins = cells.where("value is not null").groupBy("band", F.floor(F.col("value") / width).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("band").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def focal_mode(cells: DataFrame, radius: int = 1) -> DataFrame:
    """The most frequent value of each cell's window, the least of equals."""
    return focal(cells, "mode", radius)


def gradient(cells: DataFrame) -> DataFrame:
    """The length of the gradient by Sobel's kernels, both sums from one pass."""
    return sobel(cells).withColumn("value", F.sqrt(F.col("sobel_x") ** 2 + F.col("sobel_y") ** 2)).drop("sobel_x", "sobel_y")


def near_black(cells: DataFrame, most: float) -> DataFrame:
    """Values up to `most` away from 0 become 0."""
    return cells.withColumn("value", F.when(F.abs("value") <= most, 0.0).otherwise(F.col("value")))


def clip(cells: DataFrame, ring: Column, size: float = 1.0) -> DataFrame:
    """The cells whose middle lies in a polygon."""
    return cells.where(contains(ring, (F.col("px") + 0.5) * size, (F.col("py") + 0.5) * size))


def _points(cells: DataFrame) -> DataFrame:
    return cells.select(F.struct("px", "py").alias("id"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), "value")


def proximity(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Each cell's distance to the nearest target cell (px, py), in cells."""
    best = nearest(_points(cells.select("px", "py", F.lit(0.0).alias("value")).distinct()), _points(targets.select("px", "py", F.lit(0.0).alias("value")).distinct()).withColumn("v", F.lit(0.0)), 1)
    return best.select("i.px", "i.py", F.col("d").alias("value"))


def buffered(cells: DataFrame, targets: DataFrame, distances: list[float]) -> DataFrame:
    """1 at the targets, 2 up to the first distance, 3 up to the second and so on; cells farther away go."""
    zone = F.when(F.col("value") == 0, 1)
    for k, d in enumerate(sorted(distances)):
        zone = zone.when(F.col("value") <= d, k + 2)
    return proximity(cells, targets).withColumn("value", zone).where("value is not null")


def filled(cells: DataFrame, places: DataFrame, radius: float, power: float = 2.0) -> DataFrame:
    """The coverage with the places (px, py) it lacks filled by the inverse-distance mean of cells within a radius; places without any stay away."""
    own = cells.select(*CELL, "value").where("value is not null")
    bands = sorted(r[0] for r in own.select("band").distinct().collect())  # a coverage has a handful
    gaps = places.select("px", "py").distinct().select(F.explode(F.array(*map(F.lit, bands)) if bands else F.array().cast("array<string>")).alias("band"), "px", "py").join(own, CELL, "left_anti")
    left = gaps.select("px", "py").distinct().select(F.struct("px", "py").alias("id"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    right = own.select(F.struct("px", "py").alias("id"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), F.struct("band", "value").alias("v"))
    near = within_distance(left, right, radius).where("d > 0").select(F.col("vj.band").alias("band"), "i.px", "i.py", F.col("vj.value").alias("near"), "d")
    means = near.groupBy(*CELL).agg((F.sum(F.col("near") / F.pow("d", F.lit(power))) / F.sum(1 / F.pow("d", F.lit(power)))).alias("value"))
    return own.unionByName(means.join(gaps, CELL, "left_semi"))


def to_resolution(cells: DataFrame, size: int, wanted: int) -> DataFrame:
    """Cells of `size` units as cells of `wanted` units, one a multiple of the other: the value of the cell that holds the middle, or the mean of all within."""
    if size == wanted:
        return cells
    if size % wanted == 0:
        steps = F.explode(F.sequence(F.lit(0), F.lit(size // wanted - 1)))
        return cells.withColumn("_i", steps).withColumn("_j", steps).select("band", (F.col("px") * (size // wanted) + F.col("_i")).alias("px"), (F.col("py") * (size // wanted) + F.col("_j")).alias("py"), "value")
    if wanted % size:
        raise ValueError("one size must be a multiple of the other")
    return cells.groupBy("band", F.floor(F.col("px") / (wanted // size)).alias("px"), F.floor(F.col("py") / (wanted // size)).alias("py")).agg(F.avg("value").alias("value"))


def aligned(a: DataFrame, a_size: int, b: DataFrame, b_size: int) -> tuple[DataFrame, DataFrame]:
    """Two coverages at the finer of their resolutions; a binary operator then joins the extent they share."""
    finer = min(a_size, b_size)
    return to_resolution(a, a_size, finer), to_resolution(b, b_size, finer)


def metadata(cells: DataFrame) -> DataFrame:
    """Of each band: the extent in cells, the number of cells with data, and the range of values."""
    return cells.groupBy("band").agg(F.min("px").alias("px0"), F.min("py").alias("py0"), F.max("px").alias("px1"), F.max("py").alias("py1"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def texture(cells: DataFrame, dx: int = 1, dy: int = 0) -> DataFrame:
    """(band, contrast, energy, homogeneity, entropy) of the co-occurrence of whole values with those a step away."""
    left = cells.select("band", "px", "py", F.floor("value").alias("a"))
    right = cells.select("band", (F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.floor("value").alias("b"))
    pairs = left.join(right, CELL).groupBy("band", "a", "b").agg(F.count("*").alias("n"))
    total = pairs.groupBy("band").agg(F.sum("n").alias("all"))
    n, every, gap = F.col("n"), F.max("all"), F.col("a") - F.col("b")
    # whole numbers are summed and divided once, so that contrast and energy do not depend on the order of rows
    alike = pairs.withColumn("gap", gap * gap).groupBy("band", "gap").agg(F.sum("n").alias("n"), F.sum(n * n).alias("squares"), F.sum(n * F.log2("n")).alias("bits")).join(total, "band")
    return alike.groupBy("band").agg((F.sum(n * F.col("gap")) / every).alias("contrast"), (F.sum("squares") / (every * every)).alias("energy"), (F.sum(n / (1 + F.col("gap"))) / every).alias("homogeneity"), (F.log2(every) - F.sum("bits") / every).alias("entropy"))


def latitude(cells: DataFrame, top: float, size: float) -> DataFrame:
    """Each cell's value is the latitude of its middle."""
    return cells.withColumn("value", F.lit(top) - (F.col("py") + 0.5) * size)


def cube_facts(cubes: DataFrame) -> DataFrame:
    """Of a cube (band, instant, px, py, value): bands, instants, the span of time and the extent, in one row."""
    facts = cubes.agg(F.array_join(F.array_sort(F.collect_set("band")), ",").alias("bands"), F.count_distinct("instant").alias("instants"), F.min("instant").alias("first"), F.max("instant").alias("last"), F.min("px").alias("px0"), F.min("py").alias("py0"), F.max("px").alias("px1"), F.max("py").alias("py1"))
    return facts.withColumn("columns", F.col("px1") - F.col("px0") + 1).withColumn("rows", F.col("py1") - F.col("py0") + 1)


def mosaic_latest(cubes: DataFrame) -> DataFrame:
    """The value of the last instant that each cell has."""
    return cubes.where("value is not null").groupBy(*CELL).agg(F.max_by("value", "instant").alias("value"))

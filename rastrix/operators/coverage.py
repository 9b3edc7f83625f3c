"""Cell-wise algebra, reducers and neighbourhoods of coverages.

A coverage is a table of cells (band, px, py, value), a cube has an instant as well. Null is no data. Binary operators join the
cells of two coverages on band and place, so that a cell missing on either side is missing in the result; reducers combine
before the shuffle wherever they can, and neighbourhoods work on tiles that exchange their borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles

CELL = ["band", "px", "py"]

BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": F.try_divide,
    "pow": F.pow,
    "mini": F.least,
    "maxi": F.greatest,
    "atan2": F.atan2,
    "eq": lambda a, b: (a == b).cast("int"),
    "neq": lambda a, b: (a != b).cast("int"),
    "gt": lambda a, b: (a > b).cast("int"),
    "gte": lambda a, b: (a >= b).cast("int"),
    "lt": lambda a, b: (a < b).cast("int"),
    "lte": lambda a, b: (a <= b).cast("int"),
    "and": lambda a, b: a.cast("long").bitwiseAND(b.cast("long")),
    "or": lambda a, b: a.cast("long").bitwiseOR(b.cast("long")),
}

UNARY = {
    **{n: getattr(F, n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "ceil", "floor", "abs", "signum", "cbrt")},
    "asin": lambda v: F.when(F.abs(v) <= 1, F.asin(v)),
    "acos": lambda v: F.when(F.abs(v) <= 1, F.acos(v)),
    "log": lambda v: F.when(v > 0, F.log(v)),
    "log10": lambda v: F.when(v > 0, F.log10(v)),
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
    "round": lambda v: F.floor(v + 0.5),
    "not": lambda v: F.bitwise_not(v.cast("long")),
}

CASTS = {
    "toInt8": lambda v: F.pmod(v.cast("long") + 128, F.lit(256)) - 128,
    "toUint8": lambda v: F.pmod(v.cast("long"), F.lit(256)),
    "toInt16": lambda v: F.pmod(v.cast("long") + 32768, F.lit(65536)) - 32768,
    "toUint16": lambda v: F.pmod(v.cast("long"), F.lit(65536)),
    "toInt32": lambda v: v.cast("int"),
    "toFloat": lambda v: v.cast("float"),
    "toDouble": lambda v: v.cast("double"),
}

REDUCERS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": F.median,
    "mode": lambda v: F.mode(v, True),
    "or": lambda v: F.bit_or(v.cast("long")),
    "and": lambda v: F.bit_and(v.cast("long")),
}


def select_bands(cells: DataFrame, bands: list[str]) -> DataFrame:
    """The named bands; repeated names are an error, and so are missing ones (found by a scan of the band column only)."""
    if len(set(bands)) < len(bands):
        raise ValueError(f"repeated bands: {bands}")
    found = cells.where(F.col("band").isin(bands))
    missing = set(bands) - {r[0] for r in found.select("band").distinct().limit(len(bands)).collect()}
    if missing:
        raise ValueError(f"missing bands: {sorted(missing)}")
    return found


def binary(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """The operator on the cells that both have, of the same instant if both are collections."""
    keys = [*CELL, *(["instant"] if "instant" in a.columns and "instant" in b.columns else [])]
    joined = a.select(*keys, F.col("value").alias("_a")).join(b.select(*keys, F.col("value").alias("_b")), keys)
    return joined.select(*keys, BINARY[op](F.col("_a"), F.col("_b")).alias("value"))


def paired(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """binary() as requests mean it: bands of the same names meet by name; of as many other names, in the order of the names, called as in `a`. Another number of bands is an error. Reads the band columns first."""
    one, two = (sorted(r[0] for r in x.select("band").distinct().collect()) for x in (a, b))
    if len(one) != len(two):
        raise ValueError(f"not as many bands: {one}, {two}")
    if one != two:
        named = F.create_map(*[F.lit(x) for pair in zip(two, one) for x in pair])
        b = b.withColumn("band", named[F.col("band")]) if two else b
    return binary(a, b, op)


def unary(cells: DataFrame, op: str) -> DataFrame:
    return cells.withColumn("value", UNARY[op](F.col("value")))


def cast(cells: DataFrame, op: str) -> DataFrame:
    return cells.withColumn("value", CASTS[op](F.col("value")))


def binarization(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("value") > threshold, 255).otherwise(0))


def clamp(cells: DataFrame, low: float, high: float) -> DataFrame:
    return cells.withColumn("value", F.least(F.greatest("value", F.lit(float(low))), F.lit(float(high))))


def remap(cells: DataFrame, pairs: dict[float, float], default: float | None = None) -> DataFrame:
    out = F.lit(default)
    for old, new in pairs.items():
        out = F.when(F.col("value") == old, F.lit(float(new))).otherwise(out)
    return cells.withColumn("value", out)


def band_pair(cells: DataFrame, names: list[str], formula, keys: list[str] | None = None) -> DataFrame:
    """One value for each place from several bands of it: one aggregate, no join."""
    keys = keys or [c for c in cells.columns if c not in ("band", "value")]
    wide = cells.where(F.col("band").isin(names)).groupBy(*keys).agg(*[F.max(F.when(F.col("band") == n, F.col("value"))).alias(f"_{n}") for n in names])
    return wide.select(*keys, formula(*[F.col(f"_{n}") for n in names]).alias("value")).where("value is not null")


def normalized_difference(cells: DataFrame, one: str, two: str) -> DataFrame:
    return band_pair(cells, [one, two], lambda a, b: F.try_divide(a - b, a + b))


def thresholded(value: Column, threshold: float) -> Column:
    """255 above, 0 from -1 to the threshold, no data below -1."""
    return F.when(value > threshold, 255).when(value >= -1, 0)


def mosaic(cells: DataFrame, method: str) -> DataFrame:
    """Coverages of many instants reduced to one; integers of values for `or` and `and`."""
    return cells.groupBy(*CELL).agg(REDUCERS[method](F.col("value")).alias("value"))


def histogram(cells: DataFrame, width: float) -> DataFrame:
    return cells.where("value is not null").groupBy("band", F.floor(F.col("value") / width).alias("bin")).agg(F.count("*").alias("n"))


def focal(cells: DataFrame, method: str, radius: int = 1) -> DataFrame:
    """A reducer over the window of each cell that is there; cells that are not there don't count."""
    found = tiles.windows(cells, radius, tiles.REDUCERS[method])
    return found.withColumn("value", F.col("value").cast("long")) if method in ("or", "and") else found


#: Kernels by their rows, from the top (y = -1) down; fixed values.
KERNELS = {
    "sobel_x": [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]],
    "sobel_y": [[-1, -2, -1], [0, 0, 0], [1, 2, 1]],
    "prewitt_x": [[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]],
    "prewitt_y": [[-1, -1, -1], [0, 0, 0], [1, 1, 1]],
    "kirsch_x": [[-3, -3, 5], [-3, 0, 5], [-3, -3, 5]],
    "kirsch_y": [[-3, -3, -3], [-3, 0, -3], [5, 5, 5]],
    "laplacian4": [[0, 1, 0], [1, -4, 1], [0, 1, 0]],
    "laplacian8": [[1, 1, 1], [1, -8, 1], [1, 1, 1]],
}


def square_kernel(radius: int, value: float = 1.0, normalize: bool = False) -> list[list[float]]:
    """A square of equal weights, that sum up to 1 if normalised."""
    size = 2 * radius + 1
    return [[1 / (size * size) if normalize else value] * size] * size


def fixed_kernel(weights: list[list[float]], normalize: bool = False) -> list[list[float]]:
    """A kernel by its rows, from the top down, whose weights sum up to 1 if normalised; an even number of rows or columns, or uneven rows, are an error."""
    if len(weights) % 2 == 0 or any(len(r) != len(weights) for r in weights):
        raise ValueError("a kernel is a square of an odd number of rows")
    total = sum(map(sum, weights))
    return [[w / total if normalize and total else float(w) for w in row] for row in weights]


def add_kernels(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """The sums of two kernels' weights, middle upon middle; beyond the smaller one's border the larger one's weights stay."""
    if len(a) < len(b):
        a, b = b, a
    rim = (len(a) - len(b)) // 2
    inside = lambda k: rim <= k < rim + len(b)
    return [[w + (b[y - rim][x - rim] if inside(x) and inside(y) else 0) for x, w in enumerate(row)] for y, row in enumerate(a)]


def convolve(cells: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """The kernel's sum over the window of each cell; cells that are not there count as 0."""
    return tiles.windows(cells, len(kernel) // 2, tiles.weighed({"value": kernel}))


def sobel(cells: DataFrame) -> DataFrame:
    """sobel_x and sobel_y of each cell, from one pass."""
    names = ["sobel_x", "sobel_y"]
    return tiles.windows(cells, 1, tiles.weighed({k: KERNELS[k] for k in names}), names)


def scaled(cells: DataFrame, factor: float) -> DataFrame:
    return cells.withColumn("value", F.col("value") * factor)


def slope(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Degrees of slope by Horn's 3 x 3 differences."""
    return sobel(cells).withColumn("value", F.degrees(F.atan(F.sqrt(F.col("sobel_x") ** 2 + F.col("sobel_y") ** 2) / (8 * size)))).drop("sobel_x", "sobel_y")

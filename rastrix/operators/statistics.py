"""Descriptive, spatial and temporal statistics, stratified heterogeneity, sampling and interpolation."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import distance, kernel
from ..functions.special import f_tail
from ..functions.stored import stored
from .spatial import near_places, nearest, within_distance


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "x")
    return long.groupBy("name").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.stddev_pop("x").alias("stdev"), F.var_pop("x").alias("variance"), F.max("x").alias("largest"), F.min("x").alias("smallest"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, by one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of each different value, ties by their mean rank. Values are range-partitioned and sorted; only the partitions' totals meet in one task."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    parted = stored(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "ranges")
    before = parted.groupBy("part").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    return parted.withColumn("upto", local).join(F.broadcast(before.select("part", "before")), "part").select("value", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))  # a row for each partition


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different values of the columns and `number`, their place from 0 in order: range-partitioned and sorted; only the partitions' sizes meet in one task."""
    kinds = rows.select(*columns).distinct().repartitionByRange(*columns)
    parted = stored(kinds.withColumn("_part", F.spark_partition_id()), "ranges").withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*columns)))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parted.join(F.broadcast(before.select("_part", "_before")), "_part").select(*columns, (F.col("_before") + F.col("_row") - 1).cast("long").alias("number"))  # a row for each partition


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    one = rows.join(ranks(rows, a).select(F.col("value").alias(a), F.col("rank").alias("ra")), a).join(ranks(rows, b).select(F.col("value").alias(b), F.col("rank").alias("rb")), b)
    return one.agg(F.corr("ra", "rb").alias("rho"))


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """(lag, acf) of a series (t integer, x) with a value at every step: each value meets its lags by a join on the step."""
    m = series.agg(F.avg("x").alias("m"), F.sum("x").alias("s"), F.count("*").alias("n")).first()
    z = series.select("t", (F.col("x") - (m["m"] or 0.0)).alias("z"))
    moved = z.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "t", F.col("z").alias("later")).withColumn("t", F.col("t") - F.col("lag"))
    sums = moved.join(z, "t").groupBy("lag").agg(F.sum(F.col("z") * F.col("later")).alias("c"))
    own = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    return sums.select("lag", F.try_divide("c", F.lit(own)).alias("acf"))


def _centred(values: DataFrame) -> tuple[DataFrame, dict]:
    m = values.agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.var_pop("v").alias("s2")).first()
    return values.select("id", (F.col("v") - (m["m"] or 0.0)).alias("z")), {"n": m["n"], "s2": m["s2"] or 0.0}


def moran_global(values: DataFrame, weights: DataFrame) -> DataFrame:
    """I, its expectation, variance and z under normality (Cliff and Ord) of values (id, v) with weights (i, j, w)."""
    z, m = _centred(values)
    cross = weights.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    sums = cross.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c"))
    both = weights.select("i", "j", "w").union(weights.select("j", "i", "w"))
    s1 = both.groupBy("i", "j").agg((F.sum("w") ** 2).alias("q")).agg((F.sum("q") / 2).alias("s1"))
    s2 = both.groupBy("i").agg((F.sum("w") ** 2).alias("q")).agg(F.sum("q").alias("s2"))
    n = F.lit(float(m["n"]))
    one = sums.withColumn("k", F.lit(1)).join(s1.withColumn("k", F.lit(1)), "k").join(s2.withColumn("k", F.lit(1)), "k")
    i = F.col("c") / F.col("s0") / F.lit(m["s2"])
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * F.col("s0") ** 2) / ((n * n - 1) * F.col("s0") ** 2) - F.pow(n - 1, F.lit(-2.0))
    return one.select(i.alias("i"), (-1 / (n - 1)).alias("expected"), var.alias("variance"), ((i + 1 / (n - 1)) / F.sqrt(var)).alias("z"))


def _lag(values: DataFrame, weights: DataFrame) -> tuple[DataFrame, dict]:
    z, m = _centred(values)
    lag = weights.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"), F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2"))
    return z.join(lag, z["id"] == lag["i"]).select("id", "z", "lag", "w", "w2"), m


def moran_local(values: DataFrame, weights: DataFrame) -> DataFrame:
    one, m = _lag(values, weights)
    return one.select("id", (F.col("z") / F.lit(m["s2"]) * F.col("lag")).alias("i"))


def moran_local_test(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, i, expected, variance, z) of the local statistic, with its moments under random permutation of the values (Anselin)."""
    one, m = _lag(values, weights)
    n = float(m["n"])
    b2 = _centred(values)[0].agg(F.avg(F.col("z") ** 4)).first()[0] / m["s2"] ** 2
    expected = -F.col("w") / (n - 1)
    variance = F.col("w2") * (n - b2) / (n - 1) + (F.col("w") ** 2 - F.col("w2")) * (2 * b2 - n) / ((n - 1) * (n - 2)) - (F.col("w") / (n - 1)) ** 2
    i = F.col("z") / F.lit(m["s2"]) * F.col("lag")
    return one.select("id", i.alias("i"), expected.alias("expected"), variance.alias("variance"), ((i - expected) / F.sqrt(variance)).alias("z"))


def geary_global(values: DataFrame, weights: DataFrame) -> DataFrame:
    z, m = _centred(values)
    cross = weights.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    n = m["n"]
    return cross.agg((F.lit((n - 1) / (2 * n * m["s2"])) * F.sum(F.col("w") * (F.col("zi") - F.col("zj")) ** 2) / F.sum("w")).alias("c"))


def geary_local(values: DataFrame, weights: DataFrame) -> DataFrame:
    z, m = _centred(values)
    cross = weights.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    return cross.groupBy(F.col("i").alias("id")).agg((F.sum(F.col("w") * (F.col("zi") - F.col("zj")) ** 2) / F.lit(m["s2"])).alias("c"))


def getis_ord(values: DataFrame, weights: DataFrame, star: bool = False) -> DataFrame:
    """z-scores of G (the point itself left out of mean and variance) or G* (with it, if it is among its neighbours)."""
    m = values.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q")).first()
    lag = weights.join(values.select(F.col("id").alias("j"), F.col("v").alias("vj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("vj")).alias("lag"), F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2"))
    one = values.join(lag, values["id"] == lag["i"])
    n = F.lit(float(m["n"] - (0 if star else 1)))
    own = F.lit(0.0) if star else F.col("v")
    mean = (F.lit(m["s"]) - own) / n
    s = F.sqrt((F.lit(m["q"]) - own * own) / n - mean * mean)
    return one.select("id", ((F.col("lag") - mean * F.col("w")) / (s * F.sqrt((n * F.col("w2") - F.col("w") ** 2) / (n - 1)))).alias("g"))


def average_nearest_neighbour(points: DataFrame) -> DataFrame:
    near = nearest(points, points, 1, same=True).agg(F.avg("d").alias("observed"))
    box = points.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    one = near.withColumn("k", F.lit(1)).join(box.withColumn("k", F.lit(1)), "k").withColumn("expected", 0.5 / F.sqrt(F.col("n") / F.col("area")))
    return one.select("observed", "expected", (F.col("observed") / F.col("expected")).alias("ratio"), ((F.col("observed") - F.col("expected")) / (0.26136 / F.sqrt(F.col("n") * F.col("n") / F.col("area")))).alias("z"))


def ripley(points: DataFrame, steps: int = 10) -> DataFrame:
    """(d, l): L at `steps` distances up to a quarter of the longer side."""
    box = points.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    step = max(box["w"], box["h"]) / 4 / steps
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = near_places(places, places.withColumnRenamed("n", "m"), step * steps).withColumn("n", F.col("n") * F.col("m") - F.when(F.col("d") == 0, F.col("n")).otherwise(0))
    # each pair counts once, at the first distance over its own; the steps' counts are added up
    first = pairs.groupBy((F.floor(F.col("d") / step) + 1).cast("int").alias("k")).agg(F.sum("n").alias("n"))
    every = points.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"))
    upto = every.join(first, "k", "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k")))  # a row for each step
    return upto.select((F.col("k") * step).alias("d"), F.sqrt(box["w"] * box["h"] * F.coalesce("n", F.lit(0)) / (pi * box["n"] * (box["n"] - 1))).alias("l"))


# stratified heterogeneity


def factor_detector(rows: DataFrame, y: str, factors: list[str]) -> DataFrame:
    """(factor, q): 1 - within / total variation."""
    long = rows.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f")).select("y", "f.*")
    each = long.groupBy("factor", "level").agg(F.count("y").alias("n"), F.var_pop("y").alias("s2"))
    total = long.groupBy("factor").agg((F.count("y") * F.var_pop("y")).alias("sst"))
    return each.groupBy("factor").agg(F.sum(F.col("n") * F.col("s2")).alias("ssw")).join(total, "factor").select("factor", (1 - F.try_divide("ssw", "sst")).alias("q"))


def factor_test(rows: DataFrame, y: str, factors: list[str]) -> DataFrame:
    """(factor, q, f, p): the factor's share of the variation, and the chance of an F value as large under the noncentral distribution that its strata's means give."""
    long = rows.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f")).select("y", "f.*")
    each = long.groupBy("factor", "level").agg(F.count("y").alias("n"), F.avg("y").alias("m"))
    sums = each.groupBy("factor").agg(F.sum("n").alias("n"), F.count("*").alias("strata"), F.sum(F.col("m") ** 2).alias("squares"), F.sum(F.sqrt("n") * F.col("m")).alias("weighed"))
    spread = long.groupBy("factor").agg(F.var_samp("y").alias("variance"))
    known = {r["factor"]: r["q"] for r in factor_detector(rows.where(F.col(y).isNotNull()), y, factors).collect()}
    found = []
    for r in sums.join(spread, "factor").collect():  # a row a factor
        q, n, strata = known[r["factor"]], r["n"], r["strata"]
        f = (n - strata) / (strata - 1) * q / (1 - q) if strata > 1 and q is not None and q < 1 and n > strata else None
        shift = (r["squares"] - r["weighed"] ** 2 / n) / r["variance"] if r["variance"] else None
        found.append((r["factor"], q, f, f_tail(f, strata - 1, n - strata, max(shift, 0.0)) if f is not None and shift is not None else None))
    return rows.sparkSession.createDataFrame(found, "factor string, q double, f double, p double")


def interaction_detector(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    joined = rows.withColumn("_ab", F.concat_ws("\u0001", F.col(a).cast("string"), F.col(b).cast("string")))
    q = {r["factor"]: r["q"] for r in factor_detector(joined, y, [a, b, "_ab"]).collect()}
    low, high, both = min(q[a], q[b]), max(q[a], q[b]), q["_ab"]
    kind = "weaken, nonlinear" if both < low else "weaken, uni-" if both < high else "independent" if both == q[a] + q[b] else "enhance, nonlinear" if both > q[a] + q[b] else "enhance, bi-"
    return rows.sparkSession.createDataFrame([(a, b, both, kind)], "a string, b string, q double, kind string")


def risk_detector(rows: DataFrame, y: str, factor: str) -> DataFrame:
    """(a, b, difference, t): Welch's t of the means of two strata, for each pair of them; strata are few."""
    s = rows.groupBy(F.col(factor).alias("level")).agg(F.avg(y).alias("m"), F.var_samp(y).alias("s2"), F.count(y).alias("n"))
    a, b = (s.select(*[F.col(c).alias(f"{c}_{side}") for c in s.columns], F.lit(1).alias("k")) for side in "ab")
    pairs = a.join(b, "k").where("level_a < level_b")
    diff = F.col("m_a") - F.col("m_b")
    return pairs.select(F.col("level_a").alias("a"), F.col("level_b").alias("b"), diff.alias("difference"), (diff / F.sqrt(F.col("s2_a") / F.col("n_a") + F.col("s2_b") / F.col("n_b"))).alias("t"))


# sampling, by the order of a hash of the id


def stratified_sample(rows: DataFrame, stratum: str, n: int, order: str) -> DataFrame:
    """The n rows of each stratum that come first in `order` (an SQL expression), ties by id: least of few per partition, then of all."""
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("o"), "id"))), 1, n).alias("best")
    local = rows.withColumn("_part", F.spark_partition_id()).groupBy(stratum, "_part").agg(best)
    every = local.select(stratum, F.explode("best").alias("b")).groupBy(stratum).agg(F.slice(F.array_sort(F.collect_list("b")), 1, n).alias("best"))
    return every.select(stratum, F.explode("best").alias("b")).select(stratum, "b.id")


def regular_sample(points: DataFrame, side: float) -> DataFrame:
    """One point for each cell, that of the smallest id."""
    return points.groupBy(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).agg(F.min("id").alias("id"))


# interpolation to the cells of a grid


def grid(points: DataFrame, rows: int, cols: int) -> DataFrame:
    """(id, x, y): the centres of rows x cols cells over the points' box."""
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    cells = points.sparkSession.range(rows * cols)
    return cells.select("id", (box[0] + (F.col("id") % cols + 0.5) * ((box[1] - box[0]) / cols)).alias("x"), (box[2] + (F.floor(F.col("id") / cols) + 0.5) * ((box[3] - box[2]) / rows)).alias("y"))


def nearest_interpolation(points: DataFrame, cells: DataFrame) -> DataFrame:
    near = nearest(cells, points, 1)
    return near.join(points.select(F.col("id").alias("j"), "v"), "j").select(F.col("i").alias("id"), "v")


def inverse_distance(points: DataFrame, cells: DataFrame, radius: float, power: float = 2.0) -> DataFrame:
    """The mean weighed by 1 / d**power of points within the radius; a point at the cell itself gives its value; cells without points have no row."""
    pairs = within_distance(cells, points, radius)
    w = F.pow("d", F.lit(-power))
    return pairs.groupBy(F.col("i").alias("id")).agg(F.coalesce(F.avg(F.when(F.col("d") == 0, F.col("vj"))), F.sum(F.when(F.col("d") > 0, w * F.col("vj"))) / F.sum(F.when(F.col("d") > 0, w))).alias("v"))


def density(points: DataFrame, cells: DataFrame, width: float, kind: str = "bisquare") -> DataFrame:
    n = points.count()
    pairs = within_distance(cells, points, width if kind in ("bisquare", "tricube", "boxcar") else 8 * width)
    return pairs.groupBy(F.col("i").alias("id")).agg((F.sum(kernel(F.col("d"), width, kind)) / F.lit(float(max(1, n)))).alias("v"))


def path_length(points: DataFrame) -> DataFrame:
    """The length of each path of points (path, k, x, y) in the order of k."""
    step = distance(F.col("x"), F.col("y"), F.lag("x").over(Window.partitionBy("path").orderBy("k")), F.lag("y").over(Window.partitionBy("path").orderBy("k")))
    return points.withColumn("d", step).groupBy("path").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def ecological_detector(rows: DataFrame, y: str, factors: list[str]) -> DataFrame:
    """(a, b, f): for each pair of factors the ratio of their variances within strata; over 1: a leaves more unexplained than b."""
    long = rows.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f")).select("y", "f.*")
    within = long.groupBy("factor", "level").agg((F.count("y") * F.var_pop("y")).alias("ss"), F.count("y").alias("n")).groupBy("factor").agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    a, b = (within.select(*[F.col(c).alias(f"{c}_{side}") for c in within.columns], F.lit(1).alias("k")) for side in "ab")  # a row for each factor
    ratio = F.try_divide(F.col("n_a") * (F.col("n_b") - 1) * F.col("ss_a"), F.col("n_b") * (F.col("n_a") - 1) * F.col("ss_b"))
    return a.join(b, "k").where("factor_a < factor_b").select(F.col("factor_a").alias("a"), F.col("factor_b").alias("b"), ratio.alias("f"))


def random_sample(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The n rows (id) that come first in `order` (an SQL expression), ties by id."""
    return rows.select("id", F.expr(order).alias("_o")).orderBy("_o", "id").limit(n).select("id")


def sandwich(samples: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(unit, mean, variance): of samples (zone, v) and the shares (unit, zone, share) that zones have of reporting units, each unit's estimate and its variance."""
    zones = samples.groupBy("zone").agg(F.avg("v").alias("m"), (F.var_samp("v") / F.count("v")).alias("s2"))
    return overlaps.join(zones, "zone").groupBy("unit").agg((F.sum(F.col("share") * F.col("m")) / F.sum("share")).alias("mean"), (F.sum(F.col("share") ** 2 * F.col("s2")) / F.sum("share") ** 2).alias("variance"))


def principal_components(rows: DataFrame, columns: list[str], scaled: bool = True) -> DataFrame:
    """(component, value, share, and a weight for each column): of the correlations (or covariances), from one aggregate; a component's largest weight is positive."""
    import numpy as np

    k = range(len(columns))
    pair = F.corr if scaled else F.covar_samp
    row = rows.agg(*[pair(columns[i], columns[j]).alias(f"c{i}_{j}") for i in k for j in k if i <= j]).first()
    matrix = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k])
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    out = []
    for c, at in enumerate(order):
        v = vectors[:, at] * (1 if vectors[np.argmax(np.abs(vectors[:, at])), at] > 0 else -1)
        out.append((c + 1, float(values[at]), float(values[at] / values.sum()), *map(float, v)))
    return rows.sparkSession.createDataFrame(out, "component int, value double, share double, " + ", ".join(f"`{c}` double" for c in columns))


def component_scores(rows: DataFrame, columns: list[str], components: DataFrame, id_col: str, scaled: bool = True) -> DataFrame:
    """(id, pc1, pc2, ...): centred (and scaled) values on the components."""
    row = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    unit = {c: (F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] if scaled else 1.0) for c in columns}
    return rows.select(id_col, *[sum((unit[c] * r[c] for c in columns), F.lit(0.0)).alias(f"pc{r['component']}") for r in components.orderBy("component").collect()])


def grid_metrics(points: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """(id, n, mean, least, most, spread, distance) of the points within a radius of each cell: how many, their values, and how far they are on average."""
    near = within_distance(cells, points, radius)
    return near.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), F.avg("vj").alias("mean"), F.min("vj").alias("least"), F.max("vj").alias("most"), (F.max("vj") - F.min("vj")).alias("spread"), F.avg("d").alias("distance"))

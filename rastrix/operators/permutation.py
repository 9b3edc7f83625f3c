"""Inference by random permutation and simulation, from keys instead of shuffled tables.

A permutation is a bijection of the row numbers that anyone can evaluate for one row: in each of ROUNDS rounds a number n meets
its partner (key - n) mod size, and a hash of the larger of the two says whether they change places. So a task makes the rows of its own
permutations, and a statistic's sums of all of them come from one aggregate; no permuted table is written. All arithmetic is on whole
numbers below 2**62, the same in any SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import counts_apart
from .spatial import near_places
from .statistics import numbered

#: Points of a random pattern that a task draws at once.
SLICE = 1 << 14
#: A prime, a multiplier, and rounds of a permutation; fixed values.
PRIME, FACTOR, ROUNDS = 2147483647, 48271, 16


def mixed(x: Column, key: Column) -> Column:
    """A hash of two numbers, from 0 to PRIME - 1."""
    one = (x + key) % PRIME
    return ((one * one) % PRIME + key) % PRIME * F.lit(FACTOR).cast("long") % PRIME


MIXED_SQL = "((((({x}) + ({k})) % 2147483647) * ((({x}) + ({k})) % 2147483647) % 2147483647 + ({k})) % 2147483647 * 48271 % 2147483647)"


def keys(name: Column) -> Column:
    """The keys of a numbered permutation's rounds."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda k: mixed(mixed(name.cast("long"), F.lit(7).cast("long")), k.cast("long")))


def moved(row: Column, rounds: Column, size: Column) -> Column:
    """Where the permutation of the given keys takes a row number below `size`."""

    def step(now: Column, key: Column) -> Column:
        other = F.pmod(key - now, size)
        return F.when(mixed(F.greatest(now, other), key) % 2 == 1, other).otherwise(now)

    return F.aggregate(rounds, row.cast("long"), step)


def mixed_numbers(x: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """mixed() of arrays."""
    one = (x + key) % PRIME
    return ((one * one) % PRIME + key) % PRIME * FACTOR % PRIME


def moved_by(size: int) -> Callable[[Column, Column], Column]:
    """moved(row, keys(name), size) of columns (name, row) without nulls, a batch of rows at a time."""

    def move(name: pd.Series, row: pd.Series) -> pd.Series:
        first, now = mixed_numbers(name.to_numpy(np.int64), 7), row.to_numpy(np.int64)
        for k in range(1, ROUNDS + 1):
            key = mixed_numbers(first, k)
            other = (key - now) % size
            now = np.where(mixed_numbers(np.maximum(now, other), key) % 2 == 1, other, now)
        return pd.Series(now)

    each = F.pandas_udf(move, "long")
    return lambda name, row: each(name.cast("long"), row.cast("long"))


#: moved() in DuckDB's SQL, from a list of keys with the row number before them.
MOVED_SQL = "list_reduce(list_prepend({row}, {keys}), lambda a, k: CASE WHEN " + MIXED_SQL.format(x="greatest(a, (k - a % {n} + {n} * 2147483648) % {n})", k="k") + " % 2 = 1 THEN (k - a % {n} + {n} * 2147483648) % {n} ELSE a END)"
KEYS_SQL = "list_transform(range(1, 17), lambda i: " + MIXED_SQL.format(x=MIXED_SQL.format(x="{t}", k="7"), k="i") + ")"


def _rows(values: DataFrame) -> tuple[DataFrame, int, float]:
    """(id, r: its number in the order of ids, z: its value less the mean), how many, and the mean square."""
    m = values.where("v is not null").agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.var_pop("v").alias("s2")).first()
    names = numbered(values.where("v is not null"), ["id"])
    return values.where("v is not null").join(names, "id").select("id", F.col("number").alias("r"), (F.col("v") - F.lit(m["m"])).alias("z")), m["n"], m["s2"]


def _pseudo(found: DataFrame, keys_: list[str]) -> DataFrame:
    """(observed, mean, sd, p) of a statistic (t, value): t = 0 is the observed one; p counts the permutations that are as far out on the nearer side."""
    own = F.max(F.when(F.col("t") == 0, F.col("value"))).alias("observed")
    drawn = F.when(F.col("t") > 0, F.col("value"))
    every = found.withColumn("observed", own_over(keys_))
    above, n = F.count_if((F.col("t") > 0) & (F.col("value") >= F.col("observed"))), F.count(drawn)
    agg = every.groupBy(*keys_).agg(own, F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("sd"), ((F.least(above, n - above) + 1) / (n + 1)).alias("p"))
    return agg.select(*keys_, "observed", "mean", "sd", "p")


def own_over(keys_: list[str]) -> Column:
    return F.max(F.when(F.col("t") == 0, F.col("value"))).over(Window.partitionBy(*keys_) if keys_ else Window.partitionBy())


def moran_permuted(values: DataFrame, weights: DataFrame, times: int = 99) -> DataFrame:
    """(observed, mean, sd, p) of Moran's I under `times` permutations of the values (id, v) over the places."""
    rows, n, s2 = _rows(values)
    number = rows.select("id", "r")
    pairs = weights.join(number.select(F.col("id").alias("i"), F.col("r").alias("ri")), "i").join(number.select(F.col("id").alias("j"), F.col("r").alias("rj")), "j").select("ri", "rj", "w")
    z = rows.select("r", "z")
    every = z.select("r", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("t"))
    drawn = every.withColumn("at", moved_by(n)(F.col("t"), F.col("r")))  # a row a permutation and place
    values_ = drawn.join(z.withColumnRenamed("r", "at"), "at").select("t", "r", "z").unionByName(z.select(F.lit(0).alias("t"), "r", "z"))
    each = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times))))
    side = lambda k: values_.select("t", F.col("r").alias(f"r{k}"), F.col("z").alias(f"z{k}"))
    sums = each.join(side("i"), ["t", "ri"]).join(side("j"), ["t", "rj"]).groupBy("t").agg((F.sum(F.col("w") * F.col("zi") * F.col("zj")) / F.sum("w") / F.lit(s2)).alias("value"))
    return _pseudo(sums, [])


def moran_local_permuted(values: DataFrame, weights: DataFrame, times: int = 99) -> DataFrame:
    """(id, observed, mean, sd, p) of the local statistic: each place keeps its value, its neighbours get those of other places, each at most once."""
    rows, n, s2 = _rows(values)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    pairs = weights.withColumn("m", rank).join(rows.select(F.col("id").alias("i"), F.col("r").alias("ri"), F.col("z").alias("zi")), "i").join(rows.select(F.col("id").alias("j"), F.col("r").alias("rj")), "j")
    each = pairs.select("i", "ri", "zi", "rj", "m", "w", F.explode(F.sequence(F.lit(0), F.lit(times))).alias("t"))
    # a permutation of the other places for each place and time: its first numbers are the neighbours
    each = each.withColumn("other", moved_by(n - 1)(F.col("t").cast("long") * n + F.col("ri"), F.col("m")))
    drawn = F.when(F.col("t") == 0, F.col("rj")).otherwise(F.col("other") + (F.col("other") >= F.col("ri")).cast("int"))
    got = each.select(F.col("i").alias("id"), "t", "zi", "w", drawn.alias("r")).join(rows.select("r", "z"), "r")
    return _pseudo(got.groupBy("id", "t").agg((F.max("zi") * F.sum(F.col("w") * F.col("z")) / F.lit(s2)).alias("value")), ["id"])


def ripley_envelope(points: DataFrame, steps: int = 10, times: int = 19) -> DataFrame:
    """(d, l, low, high): L at `steps` distances up to a quarter of the longer side, and the least and largest L of `times` patterns of as many random points in the box."""
    box = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    n, wide, high, step = box["n"], box["w"], box["h"], max(box["w"], box["h"]) / 4 / steps
    spark = points.sparkSession
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    own = near_places(places, places.withColumnRenamed("n", "m"), step * steps).withColumn("n", F.col("n") * F.col("m") - F.when(F.col("d") == 0, F.col("n")).otherwise(0))
    own = own.groupBy(F.lit(0).alias("t"), (F.floor(F.col("d") / step) + 1).cast("int").alias("k")).agg(F.sum("n").alias("m"))
    # a task draws two slices of a pattern and counts their pairs; a slice's own points and a slice before another one count both ways
    slices = math.ceil(n / SLICE)
    drawn = spark.range(times * slices * slices).select((F.col("id") % times + 1).alias("t"), F.floor(F.col("id") / times % slices).alias("a"), F.floor(F.col("id") / times / slices).alias("b")).where("a <= b")

    def place(t: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(of * SLICE, min(n, (of + 1) * SLICE), dtype=np.int64)
        x, y = (mixed_numbers(mixed_numbers(k, 2 * t + c), c + 11) / float(PRIME) * side for c, side in ((0, wide), (1, high)))
        return x, y

    def counted(batches):
        for batch in batches:
            for t, a, b in zip(batch["t"].tolist(), batch["a"].tolist(), batch["b"].tolist(), strict=True):
                found = counts_apart(place(t, a), place(t, b), step, steps)
                found = found * 2 if a < b else found
                found[0] -= n_of(a) if a == b else 0  # a point and itself
                yield pd.DataFrame({"t": np.full(steps, t, np.int32), "k": np.arange(1, steps + 1, dtype=np.int32), "m": found})

    n_of = lambda of: min(n, (of + 1) * SLICE) - of * SLICE
    tasks = max(1, min(4096, times * slices * (slices + 1) // 2))
    random = drawn.repartition(tasks, "t", "a", "b").mapInPandas(counted, "t int, k int, m long").groupBy("t", "k").agg(F.sum("m").alias("m"))
    first = own.unionByName(random)
    grid = spark.range(1, steps + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(times))).alias("t"))
    upto = F.sum(F.coalesce("m", F.lit(0))).over(Window.partitionBy("t").orderBy("k"))
    found = grid.join(first, ["t", "k"], "left").withColumn("l", F.sqrt(F.lit(box["w"] * box["h"]) * upto / (F.pi() * n * (n - 1))))
    drawn = F.when(F.col("t") > 0, F.col("l"))
    return found.groupBy("k").agg(F.max(F.when(F.col("t") == 0, F.col("l"))).alias("l"), F.min(drawn).alias("low"), F.max(drawn).alias("high")).select((F.col("k") * step).alias("d"), "l", "low", "high")

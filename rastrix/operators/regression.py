"""Linear, logistic and Poisson regression, and geographically weighted models.

Global models gather X'X and X'y in one aggregate; iterated ones repeat that until the coefficients settle. Geographically
weighted models fold the rows of each place into such sums first, which the weights of a bounded-reach join of places then add up, so that rows that
share places cost no more than one, and no task holds more than a place's few sums; small systems are solved by the driver (global) or in batches of rows (local).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import distance, kernel, reach, space_time_distance
from ..functions.stored import stored
from .spatial import kernel_sums, meeting, near_places


def _sums(x: list[Column], y: Column, w: Column) -> list[Column]:
    k = range(len(x))
    return [F.sum(w * x[a] * x[b]).alias(f"a{a}_{b}") for a in k for b in k if b >= a] + [F.sum(w * x[a] * y).alias(f"b{a}") for a in k]


def _system(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)])


def _design(columns: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]


def linear(rows: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """(term, coefficient), and r2 and aic repeated in each row. Sums are taken of values less their means, which a first pass gives, so large values cost no digits."""
    kept = rows.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate([*columns, y])])
    k = len(columns)
    mean = [v or 0.0 for v in kept.agg(*[F.avg(c) for c in kept.columns]).first()]
    away = [F.col(c) - m for c, m in zip(kept.columns, mean)]
    row = kept.agg(*_sums([F.lit(1.0), *away[:k]], away[k], F.lit(1.0)), F.sum(away[k] * away[k]).alias("yy"), F.count("*").alias("n")).first()
    a, b = _system(row, k + 1)
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    n, sst = row["n"], row["yy"] or 0.0
    rss = sst - beta @ b
    beta[0] += mean[k] - sum(v * m for v, m in zip(beta[1:], mean))
    r2 = 1 - rss / sst if sst else None
    aic = n * np.log(2 * np.pi * rss / n) + n + 2 * (k + 2) if n and rss > 0 else None
    out = [(t, float(v), r2 if r2 is None else float(r2), aic if aic is None else float(aic)) for t, v in zip(["intercept", *columns], beta)]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, r2 double, aic double")


def generalised(rows: DataFrame, y: str, columns: list[str], family: str, rounds: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """(term, coefficient) of a logistic or Poisson model by iterated weighted least squares; each round is one aggregate."""
    x, t = _design(columns), F.col(y).cast("double")
    beta = np.zeros(len(x))
    if family == "poisson":
        beta[0] = np.log(max(rows.agg(F.avg(t)).first()[0] or 0.0, 1e-9))
    for _ in range(rounds):
        eta = sum((x[k] * float(v) for k, v in enumerate(beta)), F.lit(0.0))
        eta = F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))
        mean = 1 / (1 + F.exp(-eta)) if family == "logistic" else F.exp(eta)
        w = mean * (1 - mean) if family == "logistic" else mean
        a, b = _system(rows.agg(*_sums(x, eta + (t - mean) / w, w)).first(), len(x))
        new = np.linalg.lstsq(a, b, rcond=None)[0]
        done = np.abs(new - beta).max() < tolerance
        beta = new
        if done:
            break
    return rows.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(["intercept", *columns], beta)], "term string, coefficient double")


ONE = "_one"


def _term(a: str, b: str) -> str:
    """The name of the folded product of two columns."""
    return "|".join(sorted((a, b)))


def _products(columns: list[str]) -> dict[str, Column]:
    """Products of all pairs of the columns and one."""
    value = {ONE: F.lit(1.0)} | {c: F.col(c).cast("double") for c in columns}
    return {_term(a, b): value[a] * value[b] for a in value for b in value if a <= b}


def _folded(points: DataFrame, sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, by, the sums): a row a place."""
    return points.groupBy("x", "y", *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def near_sums(points: DataFrame, columns: list[str]) -> DataFrame:
    """Each place's sums of products of all pairs of the columns and one, written for several fits."""
    return stored(_folded(points, _products(columns)), "places")


def _around(places: DataFrame, held: DataFrame, width: float, kind: str) -> DataFrame:
    """Each place's neighbours among the folded ones within the kernel's reach, with their sums and the weight w; the asked place is ax, ay."""
    pairs = near_places(places.select("x", "y").distinct(), held, reach(width, kind))
    return pairs.withColumn("w", kernel(F.col("d"), width, kind)).where("w > 0")


def _local(pairs: DataFrame, sums: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy("ax", "ay", *by).agg(*sums).withColumnsRenamed({"ax": "x", "ay": "y"})


def _system_sums(y: str, columns: list[str], w: Column) -> list[Column]:
    """The weighted sums of a fit from folded products."""
    x = [ONE, *columns]
    k = range(len(x))
    return [F.sum(w * F.col(_term(x[a], x[b]))).alias(f"a{a}_{b}") for a in k for b in k if b >= a] + [F.sum(w * F.col(_term(x[a], y))).alias(f"b{a}") for a in k]


def weighted_regression(points: DataFrame, y: str, columns: list[str], width: float, kind: str = "bisquare") -> DataFrame:
    """(id, beta: array with the intercept first, yhat, residual): weighted least squares at each point; singular systems get 1e-6 on the diagonal."""
    return _fitted(points, _local_systems(points, points, y, columns, width, kind), y, columns)


def _local_systems(places: DataFrame, points: DataFrame, y: str, columns: list[str], width: float, kind: str, held: DataFrame | None = None) -> DataFrame:
    held = _folded(points, _products([y, *columns])) if held is None else held
    return _local(_around(places, held, width, kind), _system_sums(y, columns, F.col("w")))


def space_time_regression(points: DataFrame, y: str, columns: list[str], time: str, width: float, share: float = 0.05, kind: str = "bisquare") -> DataFrame:
    """As weighted_regression, by distance in space and time; what comes later than a point takes no part. The kernel must end (bisquare, tricube, boxcar) and share be over 0, which bounds the distance in space."""
    return _fitted(points, _space_time_systems(points, points, y, columns, time, width, share, kind), y, columns, (time,))


def space_time_prediction(points: DataFrame, places: DataFrame, y: str, columns: list[str], time: str, width: float, share: float = 0.05, kind: str = "bisquare") -> DataFrame:
    """(id, beta, yhat) at places (id, x, y, the time and the columns) by the points around and before them; places out of reach of all go."""
    return _fitted(places.withColumn(y, F.lit(0.0)), _space_time_systems(places, points, y, columns, time, width, share, kind), y, columns, (time,)).select("id", "beta", "yhat")


#: Steps that the longest time back is cut into, and sides of cells at most, for pairs by how far back they lie.
STEPS_BACK, SIDES = 16, 5


def _earlier(places: DataFrame, held: DataFrame, time: str, width: float, share: float) -> DataFrame:
    """(ax, ay, _t, bx, by, the time and the other columns of held) of places and what is held around and before them, if it may lie within the width. The farther
    back, the nearer it must be: share * space <= (sqrt(width) - sqrt((1 - share) * time)) ** 2. So rows meet by steps of time and by cells whose side is that of the step."""
    if share < 1:
        step = width / (1 - share) / STEPS_BACK
        far = [(width**0.5 - ((1 - share) * step * max(0, k - 1)) ** 0.5) ** 2 / share for k in range(STEPS_BACK + 2)]
    else:  # time doesn't count, so nothing is too far back
        step, far = None, [width]
    level = [min(SIDES - 1, int(np.log(far[0] / max(r, far[0] * 1e-3)) / np.log(1.5))) for r in far]
    sides = {n: max(far[0] * 1e-3, *(r for r, own in zip(far, level) if own == n)) * (1 + 1e-9) for n in set(level)}
    bin_of = lambda t: F.floor(t.cast("double") / step) if step else F.when(t.isNotNull(), F.lit(0).cast("long"))
    cell = lambda c: F.floor(F.col(c) / F.col("_s.side"))
    back = F.array(*[F.struct(F.lit(k).alias("back"), F.lit(n).alias("level"), F.lit(sides[n]).alias("side")) for k, n in enumerate(level)])
    near = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(side).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, side in sides.items() for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = places.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col(time).alias("_t"), F.explode(back).alias("_s")).withColumns({"_cx": cell("ax"), "_cy": cell("ay"), "_bin": bin_of(F.col("_t")) - F.col("_s.back"), "_level": F.col("_s.level")}).drop("_s")
    right = held.withColumnsRenamed({"x": "bx", "y": "by"}).withColumn("_s", F.explode(near)).withColumns({"_cx": cell("bx") + F.col("_s.a"), "_cy": cell("by") + F.col("_s.b"), "_bin": bin_of(F.col(time)), "_level": F.col("_s.level")}).drop("_s")
    keys = ["_level", "_cx", "_cy", "_bin"]
    return meeting(left, right, keys, "ax, ay").drop(*keys)


def _space_time_systems(places: DataFrame, points: DataFrame, y: str, columns: list[str], time: str, width: float, share: float, kind: str) -> DataFrame:
    """The sums of a fit at each place and time: rows alike in both are folded, and meet those that may lie within the width only."""
    if kind not in ("bisquare", "tricube", "boxcar") or not 0 < share <= 1:
        raise ValueError("a kernel that ends and a share over 0 up to 1")
    held = _folded(points, _products([y, *columns]), (time,))
    pairs = _earlier(places.select("x", "y", time).distinct(), held, time, width, share)
    late = pairs.withColumn("ago", (F.col("_t") - F.col(time)).cast("double")).where("ago >= 0")
    apart = space_time_distance(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), F.col("ago"), share)
    near = late.withColumn("w", kernel(apart, width, kind)).where("w > 0")
    return near.groupBy("ax", "ay", "_t").agg(*_system_sums(y, columns, F.col("w"))).withColumnsRenamed({"ax": "x", "ay": "y", "_t": time})


def _fitted(points: DataFrame, local: DataFrame, y: str, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(id, beta, yhat, residual) from the sums at each place (x, y, by)."""
    own = points.select(F.col("id").alias("i"), "x", "y", *by, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    return _solved(local.join(own, ["x", "y", *by]), points, columns)


def _solved(systems: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    k = len(columns) + 1
    kind_of_id = points.schema["id"].dataType.simpleString()

    def solve(batches):
        for t in batches:
            a = np.empty((len(t), k, k))
            for i in range(k):
                for j in range(k):
                    a[:, i, j] = t[f"a{min(i, j)}_{max(i, j)}"]
            b = np.stack([t[f"b{i}"] for i in range(k)], axis=1)
            bad = np.linalg.cond(a) > 1e14
            a[bad] += 1e-6 * np.eye(k)
            beta = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            at = np.concatenate([np.ones((len(t), 1)), *[t[[f"_x{c}"]].to_numpy() for c in range(k - 1)]], axis=1)
            yhat = (beta * at).sum(axis=1)
            yield pd.DataFrame({"id": t["i"], "beta": list(beta), "yhat": yhat, "residual": t["_y"] - yhat})

    return systems.mapInPandas(solve, f"id {kind_of_id}, beta array<double>, yhat double, residual double")


def _at_points(points: DataFrame, local: DataFrame) -> DataFrame:
    """The sums of each point's place, by its id as i."""
    return points.select(F.col("id").alias("i"), "x", "y").join(local, ["x", "y"]).drop("x", "y")


def weighted_average(points: DataFrame, y: str, width: float, kind: str = "bisquare") -> DataFrame:
    """(id, mean, variance, skewness) of the neighbours, weighed."""
    v, w = F.col(y).cast("double"), F.col("w")
    held = _folded(points, {"s": F.lit(1.0), "m1": v, "m2": v * v, "m3": v * v * v})
    m = _at_points(points, _local(_around(points, held, width, kind), [F.sum(w * F.col(c)).alias(c) for c in ("s", "m1", "m2", "m3")]))
    mean = F.col("m1") / F.col("s")
    var = F.greatest(F.col("m2") / F.col("s") - mean * mean, F.lit(0.0))
    third = F.col("m3") / F.col("s") - 3 * mean * F.col("m2") / F.col("s") + 2 * mean * mean * mean
    return m.select(F.col("i").alias("id"), mean.alias("mean"), var.alias("variance"), F.when(var > 1e-9, third / F.pow(var, F.lit(1.5))).alias("skewness"))


def weighted_correlation(points: DataFrame, a: str, b: str, width: float, kind: str = "bisquare") -> DataFrame:
    """(id, covariance, r): weighed, the covariance over 1 - sum of squared shares."""
    w, x, y = F.col("w"), F.col(a).cast("double"), F.col(b).cast("double")
    held = _folded(points, {"s": F.lit(1.0), "sx": x, "sy": y, "xx": x * x, "yy": y * y, "xy": x * y})
    m = _at_points(points, _local(_around(points, held, width, kind), [*[F.sum(w * F.col(c)).alias(c) for c in ("s", "sx", "sy", "xx", "yy", "xy")], F.sum(w * w * F.col("s")).alias("q")]))
    s = F.col("s")
    cov = lambda u, v, uv: F.col(uv) / s - F.col(u) / s * F.col(v) / s
    vx, vy = cov("sx", "sx", "xx"), cov("sy", "sy", "yy")
    return m.select(F.col("i").alias("id"), F.try_divide(cov("sx", "sy", "xy"), 1 - F.col("q") / s / s).alias("covariance"), F.when((vx > 1e-9) & (vy > 1e-9), cov("sx", "sy", "xy") / F.sqrt(vx * vy)).alias("r"))


def weighted_quantiles(points: DataFrame, y: str, width: float, kind: str = "bisquare", shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(id, one column q<percent> a share): the least value at which the neighbours' weights come to the share.

    The weights of QUANTILE_BINS ranges of values are summed for each place first; only the values of the ranges in which its shares fall are then gone through.
    """
    v, w = F.col(y), F.col("w")
    edges = sorted(set(points.select(v.cast("double").alias("v")).approxQuantile("v", [k / QUANTILE_BINS for k in range(1, QUANTILE_BINS)], 0.005)))
    binned = points.withColumn("_bin", sum((F.when(v > e, 1).otherwise(0) for e in edges), F.lit(0)))
    bins = range(len(edges) + 1)
    held = _folded(binned, {f"n{k}": F.when(F.col("_bin") == k, 1.0).otherwise(0.0) for k in bins})
    upto = _local(_around(points, held, width, kind), [F.sum(w * F.col(f"n{k}")).alias(f"n{k}") for k in bins])
    upto = upto.select("x", "y", F.array(*[sum((F.col(f"n{m}") for m in range(k + 1)), F.lit(0.0)) for k in bins]).alias("upto"))
    asked = upto.select("x", "y", "upto", F.element_at("upto", -1).alias("all"), F.explode(F.array(*map(F.lit, shares))).alias("q")).withColumn("least", F.col("all") * F.col("q") - 1e-12)
    at = F.least(F.size(F.filter("upto", lambda u: u < F.col("least"))), F.lit(len(edges)))
    asked = stored(asked.withColumn("_bin", at).select("x", "y", "q", "least", "_bin", F.when(F.col("_bin") > 0, F.get("upto", F.col("_bin") - 1)).otherwise(0.0).alias("before")), "shares")
    values = binned.groupBy("x", "y", "_bin", v.alias("v")).agg(F.count("*").alias("n"))
    near = near_places(asked.select("x", "y", "_bin").distinct(), values, reach(width, kind), by=("_bin",)).withColumn("w", kernel(F.col("d"), width, kind)).where("w > 0")
    each = _local(near, [F.sum(w * F.col("n")).alias("w")], ("_bin", "v")).withColumn("upto", F.sum("w").over(Window.partitionBy("x", "y", "_bin").orderBy("v")))
    found = asked.join(each, ["x", "y", "_bin"])
    here = lambda q: F.col("q") == q
    best = lambda q: F.coalesce(F.min(F.when(here(q) & (F.col("before") + F.col("upto") >= F.col("least")), F.col("v"))), F.max(F.when(here(q), F.col("v"))))  # noqa: E731  the last one, where rounding leaves none
    return _at_points(points, found.groupBy("x", "y").agg(*[best(q).alias(f"q{round(q * 100)}") for q in shares])).withColumnRenamed("i", "id")


#: Ranges of values whose weights are summed before single values are looked at.
QUANTILE_BINS = 24


def _moment_sums(columns: list[str]) -> tuple[dict[str, Column], list[Column]]:
    """Sums to fold by place, and those of the folded ones by weight: s of the weights, n of rows, m of values, c of products."""
    k, w = range(len(columns)), F.col("w")
    x = [F.col(c).cast("double") for c in columns]
    sums = {"s": F.lit(1.0), **{f"m{a}": x[a] for a in k}, **{f"c{a}_{b}": x[a] * x[b] for a in k for b in k if b >= a}}
    return sums, [*[F.sum(w * F.col(c)).alias(c) for c in sums], F.sum("s").alias("n")]


def _mean_covariance(t: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    s = t["s"].to_numpy()
    mean = np.stack([t[f"m{a}"] for a in range(k)], axis=1).reshape(len(t), k) / s[:, None]
    cov = np.array([[t[f"c{min(a, b)}_{max(a, b)}"] / s for b in range(k)] for a in range(k)]).transpose(2, 0, 1)
    return mean, cov - mean[:, :, None] * mean[:, None, :]


def weighted_components(points: DataFrame, columns: list[str], width: float, kind: str = "bisquare") -> DataFrame:
    """(id, variances, loadings): principal components of the neighbours, largest first; a loading's largest entry is positive. Five neighbours or fewer give zeros."""
    k, kind_of_id = len(columns), points.schema["id"].dataType.simpleString()
    sums, weighed = _moment_sums(columns)
    local = _at_points(points, _local(_around(points, _folded(points, sums), width, kind), weighed))

    def solve(batches):
        for t in batches:
            values, vectors = np.linalg.eigh(_mean_covariance(t, k)[1])
            values, vectors = values[:, ::-1], vectors[:, :, ::-1].transpose(0, 2, 1)
            top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=2)[:, :, None], axis=2)
            few = (t["n"] <= 5).to_numpy()
            values, vectors = np.where(few[:, None], 0.0, values), np.where(few[:, None, None], 0.0, vectors * np.sign(top))
            yield pd.DataFrame({"id": t["i"], "variances": list(values), "loadings": [[list(r) for r in v] for v in vectors]})

    return local.mapInPandas(solve, f"id {kind_of_id}, variances array<double>, loadings array<array<double>>")


def weighted_discriminant(points: DataFrame, label: str, columns: list[str], width: float, kind: str = "bisquare", quadratic: bool = False) -> DataFrame:
    """(id, predicted, share, entropy): the class that the neighbours' weighted priors, means and covariances (one, or one a class) make likeliest, ties to the first in order, with its probability and the bits of entropy of all."""
    k = len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    sums = _moment_sums(columns)[0]
    held = stored(_folded(points.withColumn("label", F.col(label)), sums, ("label",)), "places")
    names = list(sums)
    local = kernel_sums(held.select("x", "y").distinct(), held, names, [width], kind, "label")
    each = local.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("label", *names))).alias("classes"))  # one entry a class
    own = points.select(F.col("id").alias("i"), "x", "y", F.array(*[F.col(c).cast("double") for c in columns]).alias("at"))

    def solve(batches):
        for batch in batches:
            if not len(batch):
                continue
            classes, lengths = batch.column("classes"), batch.column("classes").value_lengths().to_numpy()
            flat, row = classes.flatten(), np.repeat(np.arange(len(batch)), lengths)
            starts = np.cumsum(lengths) - lengths
            t = pd.DataFrame({c: flat.field(c).to_numpy(zero_copy_only=False) for c in names})
            over = lambda v, how=np.add: how.reduceat(v, starts, axis=0)[row]  # noqa: B023, E731
            mean, cov = _mean_covariance(t, k)
            prior = t["s"].to_numpy() / over(t["s"].to_numpy())
            second = np.trace(cov, axis1=1, axis2=2) + (mean * mean).sum(axis=1)
            if not quadratic:
                cov, second = over(cov * prior[:, None, None]), over(second * prior)
            cov = cov + 1e-6 * np.eye(k) * np.maximum(1.0, second)[:, None, None]  # a class of one point has none
            off = batch.column("at").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)[row] - mean
            score = np.log(prior) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ca,ca->c", off, np.linalg.solve(cov, off[:, :, None])[:, :, 0])
            p = np.exp(score - over(score, np.maximum))
            p /= over(p)
            best = np.flatnonzero((p == over(p, np.maximum)) | np.isnan(p))
            best = best[np.unique(row[best], return_index=True)[1]]
            bits = np.add.reduceat(-p * np.log2(np.where(p > 0, p, 1.0)), starts)
            yield pa.RecordBatch.from_arrays([batch.column("i"), flat.field("label").take(pa.array(best)), pa.array(p[best]), pa.array(bits)], names=["id", "predicted", "share", "entropy"])

    return each.join(own, ["x", "y"]).select("i", "at", "classes").mapInArrow(solve, f"id {kinds['id']}, predicted {kinds[label]}, share double, entropy double")


def weighted_generalised(points: DataFrame, y: str, columns: list[str], width: float, family: str = "poisson", kind: str = "bisquare", rounds: int = 6) -> DataFrame:
    """(id, beta): a Poisson or logistic model at each point, by that many rounds of weighted least squares; rows alike in place and columns are folded, and a round joins the last coefficients to the pairs of places."""
    k = len(columns) + 1
    t = F.col(y).cast("double")
    first = t + 0.1 if family == "poisson" else (t + 0.5) / 2
    link = F.log(first) if family == "poisson" else F.log(first / (1 - first))
    bent = first if family == "poisson" else first * (1 - first)
    known = points.where(t.isNotNull()).withColumns({f"_c{c}": F.col(name).cast("double") for c, name in enumerate(columns)})
    held = stored(_folded(known, {"n": F.lit(1.0), "t": t, "bent": bent, "start": bent * link + (t - first)}, tuple(f"_c{c}" for c in range(k - 1))), "places")
    pairs = _around(points, held, width, kind)
    x = [F.lit(1.0), *[F.col(f"_c{c}") for c in range(k - 1)]]

    def solve(batches):
        for b in batches:
            a = np.array([[b[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).transpose(2, 0, 1)
            right = np.stack([b[f"b{i}"] for i in range(k)], axis=1)
            a = a + 1e-9 * np.maximum(1e-9, np.trace(a, axis1=1, axis2=2))[:, None, None] * np.eye(k)
            yield pd.DataFrame({"x": b["x"], "y": b["y"], "beta": list(np.linalg.solve(a, right[:, :, None])[:, :, 0])})

    beta, kinds = None, {f.name: f.dataType.simpleString() for f in points.schema}
    for _ in range(rounds):
        if beta is None:
            now, curve, part = pairs, F.col("bent"), F.col("start")
        else:
            now = pairs.join(beta.withColumnsRenamed({"x": "ax", "y": "ay"}), ["ax", "ay"])
            eta = sum((x[c] * F.col("beta")[c] for c in range(k)), F.lit(0.0))
            eta = F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))
            mean = F.exp(eta) if family == "poisson" else 1 / (1 + F.exp(-eta))
            curve = F.col("n") * (mean if family == "poisson" else mean * (1 - mean))
            part = curve * eta + F.col("t") - F.col("n") * mean
        w = F.col("w")
        sums = [F.sum(w * curve * x[a] * x[b]).alias(f"a{a}_{b}") for a in range(k) for b in range(a, k)] + [F.sum(w * x[a] * part).alias(f"b{a}") for a in range(k)]
        beta = stored(_local(now, sums).mapInPandas(solve, f"x {kinds['x']}, y {kinds['y']}, beta array<double>"), "beta")
    return _at_points(points, beta).withColumnRenamed("i", "id")


def linear_diagnostics(rows: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """(term, coefficient, error, t) and, in each row, r2, adjusted r2 and f of the model: the moments are taken about the means, in one aggregate after that of the means."""
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate([y, *columns])]).first()
    d = [F.col(c).cast("double") - F.lit(means[f"m{k}"]) for k, c in enumerate([y, *columns])]
    size = range(len(d))
    row = rows.agg(*[F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i in size for j in size if i <= j], F.count("*").alias("n")).first()
    s = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in size] for i in size])
    n, k = row["n"], len(columns)
    inverse = np.linalg.pinv(s[1:, 1:])
    beta = inverse @ s[1:, 0]
    rss = max(0.0, s[0, 0] - beta @ s[1:, 0])
    m = np.array([means[f"m{j}"] or 0.0 for j in range(1, k + 1)])
    s2 = rss / max(1, n - k - 1)
    coefficients = np.append((means["m0"] or 0.0) - beta @ m, beta)
    errors = np.sqrt(np.append(s2 * (1 / max(1, n) + m @ inverse @ m), s2 * np.diag(inverse)))
    r2 = 1 - rss / s[0, 0] if s[0, 0] else None
    whole = (r2, 1 - (1 - r2) * (n - 1) / (n - k - 1), r2 / k / ((1 - r2) / (n - k - 1)) if r2 < 1 else None) if r2 is not None and n > k + 1 else (r2, None, None)
    out = [(t, float(b), float(e), float(b / e) if e else None, *(v if v is None else float(v) for v in whole)) for t, b, e in zip(["intercept", *columns], coefficients, errors)]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, error double, t double, r2 double, adjusted double, f double")


def scored(rows: DataFrame, columns: list[str], model: DataFrame, family: str = "linear") -> DataFrame:
    """The rows with yhat by a model's (term, coefficient)."""
    beta = {r["term"]: r["coefficient"] for r in model.collect()}
    eta = sum((F.col(c).cast("double") * beta[c] for c in columns), F.lit(beta["intercept"]))
    return rows.withColumn("yhat", 1 / (1 + F.exp(-eta)) if family == "logistic" else F.exp(eta) if family == "poisson" else eta)


def predicted(rows: DataFrame, columns: list[str], model: DataFrame, id_col: str, family: str = "linear") -> DataFrame:
    """(id, yhat) by a model's (term, coefficient)."""
    return scored(rows, columns, model, family).select(id_col, "yhat")


def deviance(rows: DataFrame, y: str, family: str, terms: int) -> DataFrame:
    """(deviance, null_deviance, pseudo_r2, aic) of rows with the yhat of a logistic or Poisson model with so many terms, in one pass after the mean's."""
    both = rows.select(F.col(y).cast("double").alias("_y"), "yhat").withColumn("_m", F.lit(rows.agg(F.avg(F.col(y).cast("double"))).first()[0]).cast("double"))

    def of(m: Column) -> Column:
        if family == "logistic":
            return -2 * (F.when(F.col("_y") > 0, F.log(m)).otherwise(F.log(1 - m)))
        return 2 * (F.when(F.col("_y") > 0, F.col("_y") * F.log(F.col("_y") / m)).otherwise(0.0) - F.col("_y") + m)

    # twice the negative log-likelihood, with the factorials of a Poisson model
    like = of(F.col("yhat")) if family == "logistic" else -2 * (F.col("_y") * F.log("yhat") - F.col("yhat") - F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_y").cast("int"), F.lit(1))), F.lit(0.0), lambda s, k: s + F.log(k.cast("double"))))
    sums = both.agg(F.sum(of(F.col("yhat"))).alias("deviance"), F.sum(of(F.col("_m"))).alias("null_deviance"), (F.sum(like) + 2 * terms).alias("aic"))
    return sums.select("deviance", "null_deviance", (1 - F.try_divide("deviance", "null_deviance")).alias("pseudo_r2"), "aic")


def weighted_prediction(points: DataFrame, places: DataFrame, y: str, columns: list[str], width: float, kind: str = "bisquare") -> DataFrame:
    """(id, beta, yhat) at places (id, x, y and the columns) by the points around them; places out of reach of all go."""
    return _fitted(places.withColumn(y, F.lit(0.0)), _local_systems(places, points, y, columns, width, kind), y, columns).select("id", "beta", "yhat")


def bandwidth_scores(points: DataFrame, y: str, columns: list[str], widths: list[float], kind: str = "bisquare", near: DataFrame | None = None) -> DataFrame:
    """(width, cv): for each width the sum of squares of what each point's neighbours without itself miss it by; `near` are a table's near_sums.

    A width at which a point has too few neighbours for a fit (singular) has no score there.
    """
    near = near_sums(points, [y, *columns]) if near is None else near
    return reduce(DataFrame.unionByName, [_cross_validated(points, near, y, columns, float(w), kind) for w in widths])


def _cross_validated(points: DataFrame, near: DataFrame, y: str, columns: list[str], width: float, kind: str) -> DataFrame:
    """(width, cv). A point's own share is taken from the sums of its place only, so that no large sum is lessened by a small one."""
    x = [ONE, *columns]
    terms = {f"a{a}_{b}": _term(x[a], x[b]) for a in range(len(x)) for b in range(a, len(x))} | {f"b{a}": _term(x[a], y) for a in range(len(x))}
    others = _local(_around(near, near, width, kind).where("d > 0"), [*_system_sums(y, columns, F.col("w")), F.sum(_term(ONE, ONE)).alias("others")])
    here = near.select("x", "y", *[F.col(t).alias(f"here_{n}") for n, t in terms.items()])
    mine = _products([y, *columns])
    own = points.select(F.col("id").alias("i"), "x", "y", F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)], *[mine[t].alias(f"own_{n}") for n, t in terms.items()])
    every = own.join(here, ["x", "y"]).join(others, ["x", "y"], "left").where((F.coalesce("others", F.lit(0.0)) + F.col("here_a0_0")) > 1.5)
    less = lambda n: (F.coalesce(n, F.lit(0.0)) + (F.coalesce(f"here_{n}", F.lit(0.0)) - F.coalesce(f"own_{n}", F.lit(0.0)))).alias(n)
    systems = every.select("i", "_y", *[f"_x{k}" for k in range(len(columns))], *[less(n) for n in terms])
    return _solved(systems, points, columns).groupBy(F.lit(width).alias("width")).agg(F.sum(F.col("residual") ** 2).alias("cv"))


def best_bandwidth(points: DataFrame, y: str, columns: list[str], low: float, high: float, kind: str = "bisquare", rounds: int = 12, approach: str = "cv", near: DataFrame | None = None) -> float:
    """The width between two bounds with the least cross-validation score or corrected criterion ("aicc"), by golden section; places are folded once, and each round is one job over their pairs."""
    share = (5**0.5 - 1) / 2
    if near is None:
        near = near_sums(points, [y, *columns])

    def score(w: float) -> float:
        found = bandwidth_scores(points, y, columns, [w], kind, near).first() if approach == "cv" else weighted_diagnostics(points, y, columns, w, kind, near).first()
        value = found[approach] if found else None
        return value if value is not None and value == value else float("inf")

    a, b = high - share * (high - low), low + share * (high - low)
    fa, fb = score(a), score(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - share * (high - low)
            fa = score(a)
        else:
            low, a, fa = a, b, fb
            b = low + share * (high - low)
            fb = score(b)
    return a if fa < fb else b


def weighted_diagnostics(points: DataFrame, y: str, columns: list[str], width: float, kind: str = "bisquare", near: DataFrame | None = None) -> DataFrame:
    """(rss, trace, aicc, r2) of a geographically weighted regression: the trace of its hat matrix is the sum of what each point weighs in its own fit."""
    k, kind_of_id = len(columns) + 1, points.schema["id"].dataType.simpleString()
    sums = _at_points(points, _local_systems(points, points, y, columns, width, kind, near))
    own = points.select(F.col("id").alias("i"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])

    def run(batches):
        for t in batches:
            a = np.stack([np.stack([t[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)], axis=1) for i in range(k)], axis=1).astype(float)
            b = np.stack([t[f"b{i}"] for i in range(k)], axis=1).astype(float)
            a[np.linalg.cond(a) > 1e14] += 1e-6 * np.eye(k)
            x = np.concatenate([np.ones((len(t), 1)), t[[f"_x{j}" for j in range(k - 1)]].to_numpy(float)], axis=1)
            both = np.linalg.solve(a, np.stack([b, x], axis=2))
            yhat, hat = (x * both[:, :, 0]).sum(axis=1), (x * both[:, :, 1]).sum(axis=1)
            yield pd.DataFrame({"id": t["i"], "y": t["_y"], "residual": t["_y"] - yhat, "hat": hat})

    each = sums.join(own, "i").mapInPandas(run, f"id {kind_of_id}, y double, residual double, hat double")
    one = each.agg(F.count("*").alias("n"), F.sum(F.col("residual") ** 2).alias("rss"), F.sum("hat").alias("trace"), (F.var_pop("y") * F.count("y")).alias("tss"))
    aicc = F.col("n") * F.log(F.col("rss") / F.col("n")) + F.col("n") * float(np.log(2 * np.pi)) + F.col("n") * (F.col("n") + F.col("trace")) / (F.col("n") - 2 - F.col("trace"))
    return one.select("rss", "trace", aicc.alias("aicc"), (1 - F.col("rss") / F.col("tss")).alias("r2"))


def forward_selection(points: DataFrame, y: str, candidates: list[str], width: float, kind: str = "bisquare", near: DataFrame | None = None) -> DataFrame:
    """(step, column, aicc): columns in the order in which each lowers the corrected criterion most; candidates are few, places are folded once, and each fit is one job over their pairs."""
    chosen, out = [], []
    near = near_sums(points, [y, *candidates]) if near is None else near
    while len(chosen) < len(candidates):
        scores = [(weighted_diagnostics(points, y, [*chosen, c], width, kind, near).first()["aicc"], c) for c in candidates if c not in chosen]
        best = min((s, c) for s, c in scores if s is not None and s == s)
        chosen.append(best[1])
        out.append((len(chosen), best[1], float(best[0])))
    return points.sparkSession.createDataFrame(out, "step int, column string, aicc double")


def auto_fit(points: DataFrame, y: str, candidates: list[str], low: float, high: float, kind: str = "bisquare", approach: str = "aicc", gain: float = 3.0, rounds: int = 12) -> tuple[DataFrame, list[str], float]:
    """A regression that chooses for itself: columns in forward order at the widest bandwidth, as long as each lowers the corrected criterion by `gain`, then the bandwidth. The fit, the columns and the width."""
    near = near_sums(points, [y, *candidates])
    steps = forward_selection(points, y, candidates, high, kind, near).orderBy("step").collect()  # a row a candidate
    kept = [steps[0]["column"]]
    for before, now in zip(steps, steps[1:]):
        if before["aicc"] - now["aicc"] < gain:
            break
        kept.append(now["column"])
    width = best_bandwidth(points, y, kept, low, high, kind, rounds, approach, near)
    return _fitted(points, _local_systems(points, points, y, kept, width, kind, near), y, kept), kept, width

"""Whitening of embeddings on MLlib's RowMatrix.

A component c becomes the long x = floor(scale * c). The fit list holds each distinct x vector once: n vectors, whose sums S are exact. Each row of
the RowMatrix is the exact n * x - S, divided by n once, so it is centred before anything is multiplied;
computeGramianMatrix sums the rows' products over all executors, and divided by n that is the covariance. The driver gets that matrix of
dimension times dimension, takes its eigenvectors (eigh), and broadcasts the first `components` of them; mapInPandas
projects each row. The whitened fit list's own covariance, found by Spark, says how far from the identity it is.

What the driver holds depends on the dimension alone (8 MB for 1024); no vector passes through it. Copies of a vector, a third
of all rows or more, are folded within tasks before they are shuffled.

Defined results: vectors that are null or empty, or hold null or non-finite components, are left out, and so are those of another length than
most (of lengths equally frequent the largest counts), as a matrix has one width; null ids and repeated rows stay; floors beyond the range of a
long are drawn to it. A `deviation` too large for a long is null; `deviation_exact`, a decimal as text, is always there.
Of a component without variance (eigenvalue below the rounding error of the largest) `whitened` is null, and identity_error
leaves it out (null if none is left); `explained` is null if there is no variance at all. Other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, written

SCALE, COMPONENTS = 256, 4


@dataclass
class Whitening:
    """What the fit list determines: its size and sums, eigenvalues from the largest on, and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of rows of longs, exactly: in longs if they hold it, else in Python's integers."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        kind = np.int64 if most < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def whitened(self, away: np.ndarray) -> np.ndarray:
        """Rows of n * x - S projected on the components, over their standard deviations (NaN without variance)."""
        rows = (away / self.n).astype(float) if away.dtype == object else away / float(self.n)
        return (rows @ self.vectors) / np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)


def integral(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x: array of longs) of the rows that take part, before lengths are looked at."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def sums_of(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows (x) and the exact sum of each of their places; a row a task reaches the driver's reduction."""

    schema = pa.schema([("n", pa.int64()), ("at", pa.int32()), ("total", pa.string())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, dim)
            n += len(x)
            small = len(x) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 1 << 62
            total = total + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        yield as_batch(schema, n=[n] * dim, at=list(range(dim)), total=[str(t) for t in total])

    found = fit.select("x").mapInArrow(partial, "n long, at int, total string")
    found = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect()  # a row a dimension
    return (found[0]["n"] if found else 0), [int(r["total"]) for r in found]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum over all rows of the products of their places, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias(column)), column)
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(x: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of rows (x: arrays of `dim` longs)."""
    distinct = written(x.select("x").distinct(), "fit-list")
    n, sums = sums_of(distinct, dim)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    held = x.sparkSession.sparkContext.broadcast(model)

    def centred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            away = held.value.centred(np.stack(frame["x"].to_list()).astype(np.int64)) if len(frame) else np.zeros((0, dim))
            yield pd.DataFrame({"row": list((away / held.value.n).astype(float))})

    covariance = gramian(distinct.mapInPandas(centred, "row array<double>"), "row") / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values = np.where(values > len(values) * np.finfo(float).eps * values.max(initial=0), values, 0.0)
    model.values, model.vectors, model.trace = values[order], vectors[:, order], float(np.trace(covariance))
    kept = np.flatnonzero(model.values > 0)
    if len(kept):
        full = x.sparkSession.sparkContext.broadcast(model)

        def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    away = full.value.centred(np.stack(frame["x"].to_list()).astype(np.int64))
                    yield pd.DataFrame(full.value.whitened(away)[:, kept], columns=[f"w{k}" for k in kept])

        names = [f"w{k}" for k in kept]
        white = distinct.mapInPandas(project, ", ".join(f"{w} double" for w in names))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        found = white.agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()  # centred, merged from tasks
        model.identity_error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    return model


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each row that takes part and each component (from 1): id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rest = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    rows = integral(vectors, id_col, vector_col, scale)
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {rest}")
    rows = rows.where(F.size("x") == common["dim"])
    model = fit(rows, common["dim"], components)
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
        for frame in frames:
            if not len(frame):
                continue
            away = m.centred(np.stack(frame["x"].to_list()).astype(np.int64))
            largest = max(abs(int(away.max())), abs(int(away.min())))
            small = away.dtype != object and len(m.sums) * largest**2 < 1 << 63
            square = (away**2).sum(axis=1) if small else (away.astype(object) ** 2).sum(axis=1)
            white = m.whitened(away)
            rows = len(frame)
            yield pd.DataFrame(
                {
                    "id": frame["id"].repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    "n": np.full(rows * k, m.n),
                    "deviation": pd.array([v if v < 1 << 63 else None for v in map(int, square)], dtype="Int64").repeat(k),
                    "whitened": white.ravel(),
                    "explained": np.tile(explained, rows),
                    "identity_error": np.full(rows * k, np.nan if m.identity_error is None else m.identity_error),
                    "deviation_exact": np.repeat([str(v) for v in square], k),
                }
            )

    # ids pass pandas as text, as it has no null among longs
    found = rows.select(F.col("id").cast("string").alias("id"), "x").mapInPandas(project, f"id string, {rest}")
    found = found.select(F.col("id").cast(kind).alias(id_col), *found.columns[1:])
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("whitened", "explained", "identity_error")})

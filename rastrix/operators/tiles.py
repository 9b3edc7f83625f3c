"""Rasters as tiles, and windows over them that exchange border strips only.

A tile is one row: the band (and instant, if there is one), its place (tx, ty), and an array of the cells it has, each with its
place within the tile and its value. Cells are shuffled once, to their tile; from there on a tile sends the strips along its
borders to the eight tiles around it, and joins the strips it gets. The tiles themselves stay where they are, as both sides of
the join are dealt out by the tile; so what windows shuffle grows with the tiles' circumference, and not with the number of
cells times the window. A window's function sees arrays and is called once a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a tile's side.
SIDE = 128

#: A window's function: (values, there) -> values, or a dict of them; both arguments have a first axis for the window's places, row by row from the top left; values are NaN for no data.
Window = Callable[[np.ndarray, np.ndarray], np.ndarray | dict[str, np.ndarray]]


def keys_of(cells: DataFrame) -> list[str]:
    return [c for c in ("band", "instant") if c in cells.columns]


def tiled(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(band, instant if there is one, tx, ty, cells: array of at, value) of cells (band, px, py, value)."""
    place = (F.col("py") - F.floor(F.col("py") / side) * side) * side + (F.col("px") - F.floor(F.col("px") / side) * side)
    own = F.struct(place.cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    return cells.groupBy(*keys_of(cells), F.floor(F.col("px") / side).alias("tx"), F.floor(F.col("py") / side).alias("ty")).agg(F.collect_list(own).alias("cells"))  # side * side cells


def untiled(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The cells (band, instant if there is one, px, py, value) of tiles."""
    keys = keys_of(tiles)
    each = tiles.select(*keys, "tx", "ty", F.explode("cells").alias("c"))
    return each.select(*keys, (F.col("tx") * side + F.col("c.at") % side).alias("px"), (F.col("ty") * side + F.floor(F.col("c.at") / side)).alias("py"), F.col("c.value").alias("value"))


def with_halo(tiles: DataFrame, radius: int, side: int = SIDE) -> DataFrame:
    """The tiles with `halo`: arrays of the cells of the tiles around that lie within the radius, their places seen in a frame of side + 2 * radius cells."""
    if radius > side:
        raise ValueError(f"the radius must not exceed the tile's side of {side}")
    keys, frame = [*keys_of(tiles), "tx", "ty"], side + 2 * radius
    x, y = (lambda c: c.at % side), (lambda c: F.floor(c.at / side))

    def strip(dx: int, dy: int) -> Column:
        """What the tile dx, dy away gets."""
        near = lambda v, d: v < radius if d < 0 else v >= side - radius if d > 0 else F.lit(True)
        held = F.filter("cells", lambda c: near(x(c), dx) & near(y(c), dy))
        moved = F.transform(held, lambda c: F.struct(((y(c) - dy * side + radius) * frame + x(c) - dx * side + radius).cast("int").alias("at"), c.value.alias("value")))
        return F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), moved.alias("strip"))

    strips = [strip(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    sent = tiles.select(*keys_of(tiles), F.explode(F.array(*strips)).alias("s")).select(*keys_of(tiles), "s.*").where(F.size("strip") > 0)
    halo = sent.groupBy(*keys).agg(F.flatten(F.collect_list("strip")).alias("halo"))  # eight strips
    return tiles.join(halo, keys, "left")


def windows(cells: DataFrame, radius: int, window: Window, outputs: list[str] | None = None, side: int = SIDE) -> DataFrame:
    """A function over the window of each cell that is there: its places with one column `value`, or the named outputs; NaN becomes null."""
    outputs = outputs or ["value"]
    keys, frame = keys_of(cells), side + 2 * radius
    ready = with_halo(tiled(cells, side), radius, side).select(*keys, "tx", "ty", "cells", "halo")
    kinds = [(f.name, f.dataType.simpleString()) for f in ready.schema if f.name in keys]

    def places(column: pa.ChunkedArray | pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
        held = column[row].values
        if held is None:
            return np.zeros(0, np.int64), np.zeros(0)
        return held.field("at").to_numpy(zero_copy_only=False).astype(np.int64), held.field("value").to_numpy(zero_copy_only=False).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in range(len(keys))), ("px", pa.int64()), ("py", pa.int64()), *((o, pa.float64()) for o in outputs)])
            for row in range(len(batch)):
                values, there = np.full(frame * frame, np.nan), np.zeros(frame * frame, bool)
                own, own_values = places(batch.column(len(keys) + 2), row)
                around, around_values = places(batch.column(len(keys) + 3), row)
                x, y = own % side, own // side
                for at, v in (((y + radius) * frame + x + radius, own_values), (around, around_values)):
                    values[at], there[at] = v, True
                size = 2 * radius + 1
                stacks = [np.moveaxis(np.lib.stride_tricks.sliding_window_view(a.reshape(frame, frame), (size, size)).reshape(side, side, -1), -1, 0) for a in (values, there)]
                with np.errstate(all="ignore"):
                    found = window(*stacks)
                found = found if isinstance(found, dict) else {outputs[0]: found}
                tx, ty = (batch.column(len(keys) + k)[row].as_py() for k in (0, 1))
                named = [pa.repeat(batch.column(k)[row], len(own)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*named, pa.array(tx * side + x), pa.array(ty * side + y), *(pa.array(found[o][y, x], from_pandas=True) for o in outputs)], schema=schema)

    return ready.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in kinds), "px long", "py long", *(f"{o} double" for o in outputs)]))


def nothing(values: np.ndarray) -> np.ndarray:
    """Where a window has no data at all."""
    return np.isnan(values).all(axis=0)


def _mode(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The most frequent value, the least of equals."""
    best, most = np.full(values.shape[1:], np.nan), np.zeros(values.shape[1:], int)
    for own in values:
        n = (values == own).sum(axis=0)
        better = (n > most) | ((n == most) & (own < best))
        best, most = np.where(better, own, best), np.where(better, n, most)
    return best


def _bits(ufunc: np.ufunc, start: int) -> Window:
    return lambda values, there: np.where(nothing(values), np.nan, ufunc.reduce(np.where(np.isnan(values), start, values).astype(np.int64), axis=0))


def _median(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    ordered, n = np.sort(values, axis=0), (~np.isnan(values)).sum(axis=0)
    at = lambda k: np.take_along_axis(ordered, np.maximum(k, 0)[None], axis=0)[0]
    return np.where(n > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


def _sum(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.where(nothing(values), np.nan, np.nansum(values, axis=0))


REDUCERS: dict[str, Window] = {
    "mean": lambda values, there: np.nansum(values, axis=0) / (~np.isnan(values)).sum(axis=0),
    "min": lambda values, there: np.fmin.reduce(values, axis=0),
    "max": lambda values, there: np.fmax.reduce(values, axis=0),
    "sum": _sum,
    "median": _median,
    "mode": _mode,
    "or": _bits(np.bitwise_or, 0),
    "and": _bits(np.bitwise_and, -1),
}


def weighed(kernels: dict[str, list[list[float]]]) -> Window:
    """The kernels' sums over the window; cells without data count as 0, and null comes out where none has any."""
    flat = {name: np.array(rows, float).ravel() for name, rows in kernels.items()}

    def window(values: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        empty, filled = nothing(values), np.nan_to_num(values, nan=0.0)
        return {name: np.where(empty, np.nan, np.tensordot(w, filled, axes=1)) for name, w in flat.items()}

    return window

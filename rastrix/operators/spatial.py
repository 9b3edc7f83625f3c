"""Joins of points by place. Every join is an equi-join on grid cells; no pair of far rows is ever formed."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.kernels import distance, kernel, reach, weighed_sums
from ..functions.stored import stored


def _cell(x: Column, side: float) -> Column:
    return F.floor(x / side)


def _spread(points: DataFrame, side: float) -> DataFrame:
    """Each point in its own cell and the eight around it."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return points.withColumn("_s", F.explode(near)).withColumn("_cx", _cell(F.col("x"), side) + F.col("_s.a")).withColumn("_cy", _cell(F.col("y"), side) + F.col("_s.b")).drop("_s")


#: Pairs of rows that a task and a key of the join form at most, about; rows of a key's left side at least; rows of one place in a block.
TASK_PAIRS, KEY_PAIRS, KEY_ROWS, BLOCK_ROWS = 1 << 22, 1 << 20, 256, 256


def near_places(a: DataFrame, b: DataFrame, far: float, rows: tuple[str, str] = ("1", "1"), by: tuple[str, ...] = ()) -> DataFrame:
    """(ax, ay, bx, by, d and the other columns of both) of all pairs of places of a and b (x, y, ...) at most `far` apart that agree in the columns `by`; rows: SQL for how many rows a place stands for. Cells are as wide as the reach."""
    left = a.withColumnsRenamed({"x": "ax", "y": "ay"}).withColumns({"_cx": _cell(F.col("ax"), far), "_cy": _cell(F.col("ay"), far)})
    right = _spread(b, far).withColumnsRenamed({"x": "bx", "y": "by"})
    pairs = meeting(left, right, ["_cx", "_cy", *by], "ax, ay", rows)
    return pairs.withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("d") <= far).drop("_cx", "_cy")


def meeting(left: DataFrame, right: DataFrame, cell: list[str], apart: str, rows: tuple[str, str] = ("1", "1")) -> DataFrame:
    """The join of two tables by their cells. There may be few: the left side of a cell that would form many pairs is cut into several keys by a
    hash of `apart` (SQL), and the join is dealt to as many tasks as its pairs ask for, however few bytes the tables have."""
    size = lambda t, of, name: t.groupBy(*cell).agg(F.count("*").alias(f"{name}k"), F.sum(F.expr(of)).cast("double").alias(name))
    cells = size(left, rows[0], "_l").join(size(right, rows[1], "_r"), cell).withColumn("_n", F.col("_l") * F.col("_r"))
    cells = stored(cells.select(*cell, "_n", F.least(F.ceil(F.col("_n") / KEY_PAIRS), F.ceil(F.col("_lk") / KEY_ROWS)).cast("int").alias("_ways")), "cells")
    tasks = int(min(4096, max(1, (cells.agg(F.sum("_n")).first()[0] or 0) // TASK_PAIRS)))
    ways, keys = cells.select(*cell, "_ways"), [*cell, "_salt"]
    left = left.join(ways, cell).withColumn("_salt", F.expr(f"cast(pmod(xxhash64({apart}), _ways) as int)")).drop("_ways")
    right = right.join(ways, cell).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).drop("_salt")


#: Rows of either side that a task holds at once, and pairs of a task, both about.
GROUP_ROWS, GROUP_PAIRS = 1 << 19, 1 << 25


class Dealt(NamedTuple):
    """How the cells of two tables of places are dealt out: the parts of either side of a cell (none: one each), tasks, and whether what is held comes in parts."""

    ways: DataFrame | None
    tasks: int
    parted: bool


def dealt(asked: DataFrame, held: DataFrame, far: float) -> Dealt:
    """Cells as wide as the reach; a cell's rows are cut so that a task holds GROUP_ROWS of either side at most."""
    size = lambda t, name: t.groupBy("_cx", "_cy").agg(F.count("*").alias(name))
    left = asked.select(_cell(F.col("x"), far).alias("_cx"), _cell(F.col("y"), far).alias("_cy"))
    part = lambda n: F.ceil(F.col(n) / GROUP_ROWS).cast("int")
    cells = stored(size(left, "_l").join(size(_spread(held.select("x", "y"), far), "_r"), ["_cx", "_cy"]).withColumns({"_lw": part("_l"), "_rw": part("_r")}), "cells")
    of = cells.agg(F.sum(F.col("_l").cast("double") * F.col("_r")).alias("n"), F.max("_lw").alias("l"), F.max("_rw").alias("r"), F.sum(F.col("_lw") * F.col("_rw")).alias("groups")).first()
    parts = max(of["l"] or 1, of["r"] or 1) > 1
    return Dealt(cells.select("_cx", "_cy", "_lw", "_rw") if parts else None, int(max(1, min(4096, 2 * (of["groups"] or 0), (of["n"] or 0) // GROUP_PAIRS))), (of["r"] or 1) > 1)


def kernel_sums(asked: DataFrame, held: DataFrame, columns: list[str], widths: list[float], kind: str, by: str | None = None, apart: bool = False, deal: Dealt | None = None) -> DataFrame:
    """(x, y, by, the columns, with the number of the width behind the name if there are several) of the different places asked (x, y): the sums of the held columns (x, y, by, doubles) around a place, weighed by the kernel.
    Places (and values of `by`) without any weight are left out; apart: what is held at the very place doesn't count. A task holds a cell's places and what lies around, and goes through their pairs block by block; no pair is a row."""
    far = max(reach(w, kind) for w in widths)
    deal = deal or dealt(asked, held, far)
    known = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    left = asked.where(known).select(F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), _cell(F.col("x"), far).alias("_cx"), _cell(F.col("y"), far).alias("_cy"))
    right = _spread(held.where(known).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *([by] if by else []), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]), far)
    keys = ["_cx", "_cy"]
    if deal.ways is not None:
        salt = lambda t, own, other: t.join(deal.ways, keys).withColumns({f"_{own}": F.expr(f"cast(pmod(xxhash64({'ax, ay' if own == 'l' else 'x, y'}), _{own}w) as int)"), f"_{other}": F.explode(F.sequence(F.lit(0), F.col(f"_{other}w") - 1))}).drop("_lw", "_rw")
        left, right, keys = salt(left, "l", "r"), salt(right, "r", "l"), [*keys, "_l", "_r"]
    names = [f"{c}{n}" if len(widths) > 1 else c for n in range(len(widths)) for c in columns]
    fields = [("x", "double"), ("y", "double"), *([(by, held.schema[by].dataType.simpleString())] if by else []), *[(n, "double") for n in names]]
    nothing = pa.table({n: pa.array([], to_arrow_type(held.schema[by].dataType) if n == by else pa.float64()) for n, _ in fields})

    def around(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return nothing
        coded = b.column(by).combine_chunks().dictionary_encode(null_encoding="encode") if by else None
        kinds = len(coded.dictionary) if by else 1
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if by else np.zeros(len(b), np.int64)
        asked_, held_ = (tuple(t.column(c).to_numpy() for c in at) for t, at in ((a, ("ax", "ay")), (b, ("x", "y"))))
        values = np.stack([b.column(c).to_numpy().astype(float) for c in columns], axis=1)
        found = weighed_sums(asked_, held_, codes, kinds, values, widths, kind, apart)
        row, kept = np.nonzero((found[..., 0] > 0).any(axis=2))
        got = found[row, kept]
        own = {"x": asked_[0][row], "y": asked_[1][row]} | ({by: coded.dictionary.take(pa.array(kept))} if by else {})
        return pa.table(own | {names[n * len(columns) + c]: got[:, n, 1 + c] for n in range(len(widths)) for c in range(len(columns))})

    spread = lambda t: t.repartition(deal.tasks, *keys).groupBy(*keys)
    found = spread(left).cogroup(spread(right)).applyInArrow(around, ", ".join(f"{n} {of}" for n, of in fields))
    return found.groupBy("x", "y", *([by] if by else [])).agg(*[F.sum(n).alias(n) for n in names]) if deal.parted else found


def blocks(rows: DataFrame, by: list[str], name: str, columns: list[Column]) -> DataFrame:
    """(by, name: an array of the columns of rows (id, by, ...) alike in `by`, BLOCK_ROWS about at most)."""
    n = F.count("*").over(Window.partitionBy(*by))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK_ROWS)).alias("_block")
    return rows.withColumn("_n", n).groupBy(*by, block).agg(F.collect_list(F.struct(*columns)).alias(name)).drop("_block")


def within_distance(a: DataFrame, b: DataFrame, d: float, weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """(i, j, d, b's v as vj, and w if a weight of d is given) of all pairs of a (id, x, y) and b (id, x, y, v) at most d apart. Places meet once, with all their rows."""
    left = blocks(a.select("id", "x", "y"), ["x", "y"], "_left", [F.col("id").alias("i")])
    right = blocks(b.select("id", "x", "y", "v"), ["x", "y"], "_right", [F.col("id").alias("j"), F.col("v").alias("vj")])
    near = near_places(left, right, d, ("size(_left)", "size(_right)"))
    near = near.select("_left", "_right", "d", *([] if weight is None else [weight(F.col("d")).alias("w")]))
    each = near.withColumn("_left", F.explode("_left")).withColumn("_right", F.explode("_right"))
    return each.select("_left.i", "_right.j", "d", "_right.vj", *([] if weight is None else ["w"]))


#: Levels of cells that are tried at once, halving their sides; points that a cell should hold at most, and the finest level.
LEVELS, CELL_POINTS, FINEST = 10, 512, 40


def nearest(a: DataFrame, b: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(i, j, d, rank) of the k rows of b nearest to each row of a, ties to the smaller id; same: a and b are one table, and a row isn't its own neighbour. Rows without a place take no part.

    Places that several rows share are looked up once, and of each place of b only the first rows count. Cells are those of a
    quadtree over both tables. A place of a takes the finest cell around it that holds enough points of b: they lie no farther than that cell's
    farthest corner, so it meets the cells of that level which reach as near, and no others. Places so far from most of b that no such cell
    is near its size go down the tree from the root instead, with the cells that may hold one of their nearest, until these hold few points.
    What is written between the steps is one row a place, or a few.
    """
    known = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    place = lambda t: t.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(known)
    a, b = place(a), place(b)
    extent = lambda t: (F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y"))
    n, *box = b.agg(*extent(b)).first()
    _, *other = (n, *box) if same else a.agg(*extent(a)).first()
    keep = min(k + same, n)
    if keep < 1 + same or other[0] is None:
        kind = {c: t for c, t in b.dtypes}["id"]
        return a.select(F.col("id").alias("i"), F.lit(None).cast(kind).alias("j"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
    x0, y0 = min(box[0], other[0]), min(box[2], other[2])
    wide = max(max(box[1], other[1]) - x0, max(box[3], other[3]) - y0) * (1 + 1e-9) or 1.0
    cell = lambda c, at, level: F.floor((F.col(c) - at) / (F.lit(wide) / F.pow(F.lit(2.0), level))).cast("long")
    first = Window.partitionBy("x", "y").orderBy("id")
    b = stored(b.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).drop("r"), "points")
    places = a.select("x", "y").distinct()
    # the level at which cells hold about as many as are sought, and what lies around it
    middle = max(0, math.floor(math.log(max(1.0, n / (2 * keep)), 4)))
    low = max(0, middle - LEVELS // 2)
    levels, wanting, placed, used = list(range(low, low + LEVELS)), places, None, set()
    while True:
        spread = lambda t: t.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cx": cell("x", x0, F.col("level")), "cy": cell("y", y0, F.col("level"))})
        full = spread(b).groupBy("level", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") >= keep)
        found = spread(wanting).join(full, ["level", "cx", "cy"], "left").groupBy("x", "y").agg(F.max(F.when(F.col("n").isNotNull(), F.struct("level", "n"))).alias("at"))
        found = stored(found.select("x", "y", "at.*"), "placed")
        dense = (F.col("level") == levels[-1]) & (F.col("n") > CELL_POINTS) & F.lit(levels[-1] < FINEST)
        kept = found.where(F.coalesce(~dense, F.lit(True))) if levels[0] == low else found.where(F.coalesce(~dense, F.lit(True)) & F.col("level").isNotNull())
        placed = kept if placed is None else placed.unionByName(kept)
        counts = {r["level"]: (r["dense"], r["count"]) for r in found.groupBy("level").agg(F.count_if(dense).alias("dense"), F.count("*").alias("count")).collect()}  # a row a level
        used |= {level for level in counts if level is not None}
        if not counts.get(levels[-1], (0, 0))[0]:
            break
        wanting, levels = found.where(dense).select("x", "y"), list(range(levels[-1], min(FINEST, levels[-1] + LEVELS) + 1))
    far = placed.where("level is null").select("x", "y")
    side = F.lit(wide) / F.pow(F.lit(2.0), F.col("level"))
    corner = lambda c, at: F.greatest(F.col(c) - at - F.col(f"c{c}") * side, (F.col(f"c{c}") + 1) * side - F.col(c) + at)  # noqa: E731  the farther side of a cell
    gap = lambda c, at: F.greatest(F.lit(0.0), F.lit(at) + F.col(f"c{c}") * side - F.col(c), F.col(c) - at - (F.col(f"c{c}") + 1) * side)  # noqa: E731  the nearer one
    length = lambda u, v: F.sqrt(u * u + v * v)
    near = placed.where("level is not null").withColumns({"cx": cell("x", x0, F.col("level")), "cy": cell("y", y0, F.col("level"))}).withColumn("reach", length(corner("x", x0), corner("y", y0)) * (1 + 1e-9))
    around = lambda c, at: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach") - at) / side).cast("long"), F.floor((F.col(c) + F.col("reach") - at) / side).cast("long")))
    near = near.withColumn("cx", around("x", x0)).withColumn("cy", around("y", y0)).where(length(gap("x", x0), gap("y", y0)) <= F.col("reach"))
    asked = near.select("x", "y", "reach", "level", "cx", "cy")
    if not far.isEmpty():
        level, front, ends = 0, far.select("x", "y", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(n).cast("long").alias("n")), None
        while True:
            large = (F.col("n") > CELL_POINTS) & F.lit(level < FINEST)
            ends = front.where(~large) if ends is None else ends.unionByName(front.where(~large))
            wide_ones = front.where(large)
            if wide_ones.isEmpty():
                break
            up = wide_ones.select("cx", "cy").distinct()
            parent = {"cx": cell("x", x0, F.lit(level)), "cy": cell("y", y0, F.lit(level))}
            level += 2
            parts = b.withColumns(parent).join(up, ["cx", "cy"], "left_semi").groupBy("cx", "cy", cell("x", x0, F.lit(level)).alias("nx"), cell("y", y0, F.lit(level)).alias("ny")).agg(F.count("*").alias("m"))
            down = wide_ones.drop("n", "level").join(parts, ["cx", "cy"]).select("x", "y", F.lit(level).alias("level"), F.col("nx").alias("cx"), F.col("ny").alias("cy"), F.col("m").alias("n"))
            every = down.unionByName(ends).withColumns({"most": length(corner("x", x0), corner("y", y0)), "least": length(gap("x", x0), gap("y", y0))})
            # the bound: so many points surely lie that near
            sure = Window.partitionBy("x", "y").orderBy("most").rowsBetween(Window.unboundedPreceding, 0)
            bound = every.withColumn("sure", F.sum("n").over(sure)).groupBy("x", "y").agg((F.min(F.when(F.col("sure") >= keep, F.col("most"))) * (1 + 1e-9)).alias("reach"))
            every = stored(every.join(bound, ["x", "y"]).where(F.col("least") <= F.col("reach")).select("x", "y", "reach", "level", "cx", "cy", "n"), "front")
            front, ends = every.where(F.col("level") == level).drop("reach"), every.where(F.col("level") < level).drop("reach")
        used |= set(range(0, level + 1, 2))
        last = ends.withColumns({"most": length(corner("x", x0), corner("y", y0))})
        sure = Window.partitionBy("x", "y").orderBy("most").rowsBetween(Window.unboundedPreceding, 0)
        bound = last.withColumn("sure", F.sum("n").over(sure)).groupBy("x", "y").agg((F.min(F.when(F.col("sure") >= keep, F.col("most"))) * (1 + 1e-9)).alias("reach"))
        asked = asked.unionByName(last.join(bound, ["x", "y"]).select("x", "y", "reach", "level", "cx", "cy"))
    held = b.select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.array(*map(F.lit, sorted(used))) if used else F.array(F.lit(0))).alias("level"))
    held = held.withColumns({"cx": F.floor((F.col("bx") - x0) / (F.lit(wide) / F.pow(F.lit(2.0), F.col("level")))).cast("long"), "cy": F.floor((F.col("by") - y0) / (F.lit(wide) / F.pow(F.lit(2.0), F.col("level")))).cast("long")})
    pairs = asked.join(held, ["level", "cx", "cy"]).withColumn("d", distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).where("d <= reach")
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("d", "j"))).where(F.col("r") <= keep).select("x", "y", "j", "d", "r")
    joined = a.select(F.col("id").alias("i"), "x", "y").join(best, ["x", "y"])
    if not same:
        return joined.select("i", "j", "d", F.col("r").alias("rank"))
    return joined.where("i <> j").withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("r"))).where(F.col("rank") <= k).select("i", "j", "d", "rank")


def points_in_boxes(points: DataFrame, boxes: DataFrame, side: float) -> DataFrame:
    """(point, box) of points (id, x, y) inside boxes (id, x0, y0, x1, y1; low sides are inside, high ones are not). A box stands in every cell it meets; a point lies in one cell, so no pair comes twice."""
    cells = lambda low, high: F.sequence(_cell(F.col(low), side), _cell(F.col(high), side))
    spread = boxes.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1"))).withColumnRenamed("id", "box")
    placed = points.select(F.col("id").alias("point"), "x", "y", _cell(F.col("x"), side).alias("_cx"), _cell(F.col("y"), side).alias("_cy"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return placed.join(spread, ["_cx", "_cy"]).where(inside).select("point", "box")


def touching(polygons: DataFrame) -> DataFrame:
    """(i, j) of polygons (id, ring of points) that share a corner: queen contiguity of a gap-free map."""
    corners = polygons.select("id", F.explode(F.array_distinct("ring")).alias("c")).select("id", "c.x", "c.y")
    other = corners.withColumnRenamed("id", "j")
    return corners.withColumnRenamed("id", "i").join(other, ["x", "y"]).where("i <> j").select("i", "j").distinct()


def styled(pairs: DataFrame, style: str = "W") -> DataFrame:
    """Weights of neighbour pairs (i, j): W row-standardised, B binary, C globally standardised (sum n), U (sum 1)."""
    if style == "B":
        return pairs.select("i", "j", F.lit(1.0).alias("w"))
    if style == "W":
        n = pairs.groupBy("i").agg(F.count("*").alias("n"))
        return pairs.join(n, "i").select("i", "j", (1.0 / F.col("n")).alias("w"))
    total = pairs.agg(F.count("*"), F.count_distinct("i")).first()
    return pairs.select("i", "j", F.lit((total[1] if style == "C" else 1.0) / max(1, total[0])).cast("double").alias("w"))


def kernel_weights(points: DataFrame, width: float, kind: str, reach: float | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, d, w) by a fixed width. Gaussian and exponential kernels don't end; `reach` says how far they are followed (8 widths unless given). digits: weights are rounded, each once a pair of places, which costs more than a pair of rows."""
    far = width if kind in ("bisquare", "tricube", "boxcar") else (reach or 8 * width)
    weight = lambda d: kernel(d, width, kind) if digits is None else F.round(kernel(d, width, kind), digits)
    return within_distance(points, points, far, weight).select("i", "j", "d", "w", "vj")


def adaptive_weights(points: DataFrame, k: int, kind: str) -> DataFrame:
    """(i, j, d, w): the width is the distance of the k-th nearest, the point itself counted; where k points share a place it is zero, and no weight is a number."""
    pairs = nearest(points, points.withColumn("v", F.lit(0.0)), k)
    width = pairs.groupBy("i").agg(F.max("d").alias("width"))
    weight = F.when(F.col("width") > 0, kernel(F.col("d"), F.nullif("width", F.lit(0.0)), kind)).otherwise(float("nan"))
    return pairs.join(width, "i").select("i", "j", "d", weight.alias("w"))

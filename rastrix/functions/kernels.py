"""Distance and kernel weights as columns, and weighed sums over arrays of places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def space_time_distance(space: Column, time: Column, share: float) -> Column:
    """share*s + (1 - share)*t + 2*sqrt(share*(1 - share)*s*t)"""
    return share * space + (1 - share) * time + 2 * F.sqrt(share * (1 - share) * space * time)


def kernel(d: Column, width: Column | float, kind: str) -> Column:
    """Weight of a neighbour at distance d. bisquare, tricube and boxcar end at the width, which is still inside."""
    w = F.lit(width).cast("double") if isinstance(width, (int, float)) else width
    r = d / w
    shapes = {
        "gaussian": F.exp(-0.5 * r * r),
        "exponential": F.exp(-r),
        "bisquare": F.when(d <= w, (1 - r * r) * (1 - r * r)).otherwise(0.0),
        "tricube": F.when(d <= w, (1 - r * r * r) * (1 - r * r * r) * (1 - r * r * r)).otherwise(0.0),
        "boxcar": F.when(d <= w, 1.0).otherwise(0.0),
    }
    return shapes[kind]


def reach(width: float, kind: str) -> float:
    """How far a kernel is followed."""
    return width if kind in ("bisquare", "tricube", "boxcar") else 8 * width


#: Parts that a reach is cut into at most, for boxes of places, and places that a box of a group should have; rows of one and of the other side whose distances are held at once.
PARTS, BOX_PLACES, LEFT_ROWS, RIGHT_ROWS = 16, 16, 64, 512
#: Share of a width up to which a box's places are told by their moments; beyond it weights are too small for that.
WITHIN = 0.98


def _weights(square: np.ndarray, width: float, kind: str) -> np.ndarray:
    """kernel() of squared distances, and nothing beyond its reach."""
    far = reach(width, kind)
    if kind == "bisquare":
        w = square * (-1 / width**2)
        w += 1
        np.maximum(w, 0, out=w)
        return np.multiply(w, w, out=w)
    r = np.sqrt(square)
    w = {"gaussian": lambda: np.exp(square * (-0.5 / width**2)), "exponential": lambda: np.exp(r * (-1 / width)), "tricube": lambda: np.maximum(1 - (r / width) ** 3, 0) ** 3, "boxcar": lambda: np.ones_like(square)}[kind]()
    w[r > far] = 0
    return w


def block_order(x: np.ndarray, y: np.ndarray, side: float, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by `first` and by square cells, and where each cell's rows begin in it, with their number at the end."""
    keys = [np.floor((y - y.min()) / side), np.floor((x - x.min()) / side), *([] if first is None else [first])]
    order = np.lexsort(keys)
    new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return order, np.concatenate([[0], np.flatnonzero(new) + 1, [len(x)]])


def apart_by(box: tuple[float, ...], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squares of the least and largest distances from a box to boxes (rows of x0, x1, y0, y1)."""
    least = [np.maximum(np.maximum(boxes[k] - box[k + 1], box[k] - boxes[k + 1]), 0) for k in (0, 2)]
    most = [np.maximum(boxes[k + 1] - box[k], box[k + 1] - boxes[k]) for k in (0, 2)]
    return least[0] ** 2 + least[1] ** 2, most[0] ** 2 + most[1] ** 2


def box_of(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.array([f.reduceat(v, starts[:-1]) for v in (x, y) for f in (np.minimum, np.maximum)])


def _powers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The powers of a held place that its bisquare weights are made of, one a column."""
    r = x * x + y * y
    return np.stack([np.ones_like(x), x, y, x * x, x * y, y * y, x * r, y * r, r * r], axis=1)


def _of_powers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The factors of these powers in (1 - d * d) ** 2 at places asked, one a column."""
    r = x * x + y * y
    return np.stack([(1 - r) ** 2, 4 * x * (1 - r), 4 * y * (1 - r), 2 * r - 2 + 4 * x * x, 8 * x * y, 2 * r - 2 + 4 * y * y, -4 * x, -4 * y, np.ones_like(x)], axis=1)


def weighed_sums(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], group: np.ndarray, groups: int, values: np.ndarray, widths: list[float], kind: str, apart: bool) -> np.ndarray:
    """[asked, group, width, 1 + column]: the sum of weights and the weighed sums of the held places' values around each place asked; apart: not those at the very place.

    Boxes of places out of reach are left out. A bisquare weight is a polynomial of both places within the width, so boxes that lie within it as a whole count by their moments."""
    out = np.zeros((len(asked[0]), groups, len(widths), 1 + values.shape[1]))
    if not len(asked[0]) or not len(held[0]):
        return out
    far = max(reach(w, kind) for w in widths)
    side = far / min(PARTS, max(1, int((len(held[0]) / groups / 9 / BOX_PLACES) ** 0.5)))
    order, starts = block_order(*held, side, group)
    x, y, group = held[0][order], held[1][order], group[order]
    values = np.concatenate([np.ones((len(order), 1)), values[order]], axis=1)
    boxes, sizes, first = box_of(x, y, starts), np.diff(starts), np.searchsorted(group[starts[:-1]], np.arange(groups + 1))
    whole = kind == "bisquare" and len(widths) == 1 and not apart
    if whole:
        middle = [(v.min() + v.max()) / 2 for v in asked]
        powers = _powers((x - middle[0]) / far, (y - middle[1]) / far)
        moments = np.add.reduceat(powers[:, :, None] * values[:, None, :], starts[:-1], axis=0).reshape(len(sizes), -1)
    own, cells = block_order(*asked, side)
    blocks = [(low, min(low + LEFT_ROWS, end)) for start, end in zip(cells[:-1], cells[1:], strict=True) for low in range(start, end, LEFT_ROWS)]
    for low, end in blocks:
        rows = own[low:end]
        ax, ay = asked[0][rows][:, None], asked[1][rows][:, None]
        least, most = apart_by((ax.min(), ax.max(), ay.min(), ay.max()), boxes)
        near = least <= far * far * (1 + 1e-9)
        if whole and (within := most <= (WITHIN * far) ** 2).any():
            factors = _of_powers((ax[:, 0] - middle[0]) / far, (ay[:, 0] - middle[1]) / far)
            for g in range(groups):
                of = slice(first[g], first[g + 1])
                if (mine := within[of]).any():
                    out[rows, g, 0] += factors @ (mine.astype(float) @ moments[of]).reshape(factors.shape[1], -1)
            near &= ~within
        n = sizes[near]
        at = np.repeat(starts[:-1][near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hx, hy, hv = x[at], y[at], values[at]
        bounds = np.searchsorted(group[at], np.arange(groups + 1))
        for g in range(groups):
            for a in range(bounds[g], bounds[g + 1], RIGHT_ROWS):
                b = min(a + RIGHT_ROWS, bounds[g + 1])
                square = ax - hx[a:b]
                square *= square
                dy = ay - hy[a:b]
                dy *= dy
                square += dy
                for k, width in enumerate(widths):
                    w = _weights(square, width, kind)
                    if apart:
                        w[square == 0] = 0
                    out[rows, g, k] += w @ hv[a:b]
    return out


def counts_apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], step: float, steps: int) -> np.ndarray:
    """How many pairs of a place of a and one of b lie in each of `steps` ranges of distances, `step` wide. Boxes of places that lie too far apart are left out."""
    out, far = np.zeros(steps + 1, np.int64), step * steps
    side = far / min(PARTS, max(1, int((len(b[0]) / 16 / BOX_PLACES) ** 0.5)))
    (other, starts), (own, cells) = block_order(*b, side), block_order(*a, side)
    x, y = b[0][other], b[1][other]
    boxes, sizes = box_of(x, y, starts), np.diff(starts)
    for low, end in ((low, min(low + LEFT_ROWS, end)) for start, end in zip(cells[:-1], cells[1:], strict=True) for low in range(start, end, LEFT_ROWS)):
        ax, ay = a[0][own[low:end]][:, None], a[1][own[low:end]][:, None]
        near = apart_by((ax.min(), ax.max(), ay.min(), ay.max()), boxes)[0] <= far * far * (1 + 1e-9)
        n = sizes[near]
        at = np.repeat(starts[:-1][near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        for k in range(0, len(at), 4 * RIGHT_ROWS):
            d, dy = ax - x[at[k : k + 4 * RIGHT_ROWS]], ay - y[at[k : k + 4 * RIGHT_ROWS]]
            d *= d
            dy *= dy
            d += dy
            np.sqrt(d, out=d)
            d /= step
            np.minimum(d, steps, out=d)
            out += np.bincount(d.astype(np.int8 if steps < 127 else np.int64).ravel(), minlength=steps + 1)
    return out[:steps]

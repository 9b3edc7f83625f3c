"""Union, intersection, difference and symmetric difference of polygons of any shape, with holes and several parts.

A geometry is an array of closed rings; a point lies inside if a ray from it meets the rings an odd number of times, so holes and parts need no
order and no orientation. Boundaries are cut against each other and put together again:

1. Edges are dealt out to the grid cells they run through; edges of different polygons that share a cell are cut where they meet, also where
   they lie upon each other.
2. Each piece gets, for either of its sides and each polygon, whether it lies inside: a ray from the piece's middle counts the other pieces, which meet it
   by bands. A piece belongs to the result's boundary if the operation holds on one side only; it is turned so that the inside lies on its left.
3. Pieces are linked to rings: at a corner the next piece is the first one clockwise from where one came. Rings that turn left are parts, others are holes of
   the smallest part around them.

Points are rounded to `digits` decimals, so that what meets in a point has the same one. Only the last step takes a result's boundary into one task, as a result is one row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import atan2, pi

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored

#: Inside the result, by whether a place is inside the first polygon and inside any other.
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: a != b,
}
RESULT = "array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>"


def edges_of(polygons: DataFrame, digits: int) -> DataFrame:
    """(id, s, px, py, qx, qy) of polygons (id, s, rings): their edges, rounded, without those that are points."""
    at = lambda p, c: F.round(p[c].cast("double"), digits).alias(c)
    each = polygons.select("id", "s", F.explode("rings").alias("ring")).select("id", "s", F.transform("ring", lambda p: F.struct(at(p, "x"), at(p, "y"))).alias("ring"))
    pairs = F.zip_with(F.slice("ring", 1, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    found = each.select("id", "s", F.explode(pairs).alias("e")).select("id", "s", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))
    return found.where("px <> qx or py <> qy")


def _cells(edges: DataFrame, side: float) -> DataFrame:
    """Edges in the cells they run through: of each row those between where they enter and leave it."""
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    slope = F.when(F.col("qy") != F.col("py"), (F.col("qx") - F.col("px")) / (F.col("qy") - F.col("py")))
    x = lambda y: F.when(slope.isNull(), None).otherwise(F.col("px") + (F.least(F.greatest(y, low), high) - F.col("py")) * slope)
    ends = [F.coalesce(x(F.col("cy") * side), F.col("px")), F.coalesce(x((F.col("cy") + 1) * side), F.col("qx"))]
    rim = side * 1e-9  # a point on a cell's border is met on either side
    return rows.withColumn("cx", F.explode(F.sequence(F.floor((F.least(*ends) - rim) / side), F.floor((F.greatest(*ends) + rim) / side))))


def pieces_of(edges: DataFrame, side: float, digits: int) -> DataFrame:
    """(id, s, px, py, qx, qy) of the edges cut where edges of other polygons of the same id meet them; s holds `only`, the polygon if there is but one."""
    dealt = _cells(edges, side)
    one, two = (dealt.select("id", "cx", "cy", F.col("s").alias(f"s{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("px", "py", "qx", "qy")]) for k in (1, 2))
    # edges that share several cells are cut in each of them alike
    pairs = one.join(two, ["id", "cx", "cy"]).where((F.col("s1") < F.col("s2")) & ~F.col("s1.only").eqNullSafe(F.col("s2.only")) | (F.col("s1") < F.col("s2")) & F.col("s1.only").isNull()).select("id", "s1", "px1", "py1", "qx1", "qy1", "s2", "px2", "py2", "qx2", "qy2")
    c = F.col
    ax, ay, bx, by = c("qx1") - c("px1"), c("qy1") - c("py1"), c("qx2") - c("px2"), c("qy2") - c("py2")
    wx, wy = c("px2") - c("px1"), c("py2") - c("py1")
    turn = ax * by - ay * bx
    flat = F.abs(turn) <= 1e-12 * F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    t, u, near = (wx * by - wy * bx) / turn, (wx * ay - wy * ax) / turn, 1e-12
    point = lambda x, y: F.struct(F.round(x, digits).alias("x"), F.round(y, digits).alias("y"))
    ends = [point(c(f"{k}x{n}"), c(f"{k}y{n}")) for n in (1, 2) for k in ("p", "q")]
    cut = F.when(F.abs(u) <= near, ends[2]).when(F.abs(u - 1) <= near, ends[3]).when(F.abs(t) <= near, ends[0]).when(F.abs(t - 1) <= near, ends[1]).otherwise(point(c("px1") + t * ax, c("py1") + t * ay))
    met = (t >= -near) & (t <= 1 + near) & (u >= -near) & (u <= 1 + near)

    def on(x: str, y: str, n: int) -> Column:
        """Whether a point lies on the n-th edge."""
        dx, dy = (ax, ay) if n == 1 else (bx, by)
        vx, vy = c(x) - c(f"px{n}"), c(y) - c(f"py{n}")
        along, length = vx * dx + vy * dy, dx * dx + dy * dy
        return (F.abs(vx * dy - vy * dx) <= 10.0**-digits * F.sqrt(length)) & (along >= 0) & (along <= length)

    upon = F.filter(F.array(*[F.when(on(f"{k}x{n}", f"{k}y{n}", 3 - n), ends[2 * (n - 1) + "pq".index(k)]) for n in (1, 2) for k in ("p", "q")]), lambda p: p.isNotNull())
    points = F.when(flat, upon).otherwise(F.when(met, F.array(cut)))
    crossed = pairs.select("*", F.explode(points).alias("at"))
    own = crossed.select("id", F.col("s1").alias("s"), *[F.col(f"{k}1").alias(k) for k in ("px", "py", "qx", "qy")], "at").unionByName(crossed.select("id", F.col("s2").alias("s"), *[F.col(f"{k}2").alias(k) for k in ("px", "py", "qx", "qy")], "at"))
    return _split(edges, own)


def _split(edges: DataFrame, own: DataFrame) -> DataFrame:
    """The edges cut at points (the edge's columns, at)."""
    c, keys = F.col, ["id", "s", "px", "py", "qx", "qy"]
    found = edges.select(*keys, F.lit(None).cast("struct<x:double,y:double>").alias("at")).unionByName(own).groupBy(*keys).agg(F.collect_set("at").alias("cuts"))
    far = lambda p: (p.x - c("px")) * (c("qx") - c("px")) + (p.y - c("py")) * (c("qy") - c("py"))
    both = F.array_distinct(F.concat(F.array(F.struct(c("px").alias("x"), c("py").alias("y"))), F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(far(p).alias("t"), p.x.alias("x"), p.y.alias("y")))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))), F.array(F.struct(c("qx").alias("x"), c("qy").alias("y")))))
    line = found.select("id", "s", both.alias("line"))
    each = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return line.select("id", "s", F.explode(each).alias("e")).select("id", "s", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))


def _sides(pieces: DataFrame, side: float, flat: bool) -> DataFrame:
    """(id, piece, s, first, other) of the pieces that are level (flat) or not: whether the polygon s holds what lies right of them (above them, if flat), and what lies on the other side."""
    c = F.col
    u, v = ("x", "y") if not flat else ("y", "x")  # the ray runs along u
    lines = pieces.select("id", "s", *[c(f"{k}{u}").alias(f"{k}u") for k in "pq"], *[c(f"{k}{v}").alias(f"{k}v") for k in "pq"], "piece")
    asked = pieces.where((c("py") == c("qy")) if flat else (c("py") != c("qy"))).select("id", "piece", ((c(f"p{u}") + c(f"q{u}")) / 2).alias("mu"), ((c(f"p{v}") + c(f"q{v}")) / 2).alias("mv")).distinct().withColumn("band", F.floor(c("mv") / side))
    bands = lines.withColumn("band", F.explode(F.sequence(F.floor(F.least("pv", "qv") / side), F.floor(F.greatest("pv", "qv") / side)))).withColumnRenamed("piece", "line")
    meet = (F.least("pv", "qv") <= c("mv")) & (c("mv") < F.greatest("pv", "qv"))
    beyond = meet & (c("line") != c("piece")) & (c("pu") + (c("mv") - c("pv")) / (c("qv") - c("pv")) * (c("qu") - c("pu")) > c("mu"))
    same = c("line") == c("piece")
    found = bands.join(asked, ["id", "band"]).where(same | meet).groupBy("id", "piece", "s").agg(F.count_if(beyond).alias("n"), F.count_if(same).alias("own"))
    return found.select("id", "piece", "s", (c("n") % 2 == 1).alias("first"), ((c("n") + c("own")) % 2 == 1).alias("other"))


def _folded(pieces: DataFrame) -> DataFrame:
    """(id, s, px, py, qx, qy) of pieces (id, px, py, qx, qy, n1, n0, only): equal ones are one, with its numbers from the lower end along x to the other; those that cancel out go."""
    c = F.col
    p, q = F.struct(c("px").alias("x"), c("py").alias("y")), F.struct(c("qx").alias("x"), c("qy").alias("y"))
    way = F.when(p < q, 1).otherwise(-1)
    each = pieces.select("id", F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), (c("n1") * way).alias("n1"), (c("n0") * way).alias("n0"), "only")
    one = F.when(F.count("only") == F.count("*"), F.when(F.min("only") == F.max("only"), F.min("only"))).alias("only")
    sums = each.groupBy("id", "p", "q").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), one).where("n1 <> 0 or n0 <> 0")
    ends = [c("p.x").alias("px"), c("p.y").alias("py"), c("q.x").alias("qx"), c("q.y").alias("qy")]
    return sums.select("id", F.struct(*ends, "n1", "n0", "only").alias("s"), *ends)


def _turned(edges: DataFrame, side: float) -> DataFrame:
    """(id, px, py, qx, qy, n1, n0, only) of edges (id, s, ...): n1 (of s = 0) or n0 (of any other) is 1 if the polygon's inside lies on the left, else -1."""
    c = F.col
    end = lambda k: F.struct(c(f"{k}x").alias("x"), c(f"{k}y").alias("y"))
    each = edges.withColumn("piece", F.struct(F.least(end("p"), end("q")).alias("p"), F.greatest(end("p"), end("q")).alias("q"))).withColumn("id", F.struct("id", "s"))
    found = _sides(each, side, False).unionByName(_sides(each, side, True)).where("first <> other")
    left = F.when(c("piece.p.y") == c("piece.q.y"), c("first")).otherwise(c("first") == (c("piece.q.y") < c("piece.p.y")))
    n = F.when(left, 1).otherwise(-1)
    return found.select("id.id", *[c(f"piece.{k}.{v}").alias(f"{k}{v}") for k in "pq" for v in "xy"], F.when(c("s") == 0, n).otherwise(0).alias("n1"), F.when(c("s") == 0, 0).otherwise(n).alias("n0"), c("s").alias("only"))


def _at_corners(edges: DataFrame, side: float, digits: int) -> DataFrame:
    """The edges cut where corners of other polygons of the same id lie on them."""
    c = F.col
    ends = edges.select("id", c("s.only").alias("own"), F.explode(F.array(*[F.struct(c(f"{k}x").alias("x"), c(f"{k}y").alias("y")) for k in "pq"])).alias("at"))
    one = F.when(F.count("own") == F.count("*"), F.when(F.min("own") == F.max("own"), F.min("own"))).alias("own")
    points = ends.groupBy("id", "at").agg(one).withColumns({"cx": F.floor(c("at.x") / side), "cy": F.floor(c("at.y") / side)})
    dx, dy, vx, vy = c("qx") - c("px"), c("qy") - c("py"), c("at.x") - c("px"), c("at.y") - c("py")
    along, length = vx * dx + vy * dy, dx * dx + dy * dy
    on = (F.abs(vx * dy - vy * dx) <= 10.0**-digits * F.sqrt(length)) & (along > 0) & (along < length)
    other = c("own").isNull() | c("s.only").isNull() | (c("own") != c("s.only"))
    return _split(edges, _cells(edges, side).join(points, ["id", "cx", "cy"]).where(other & on).select("id", "s", "px", "py", "qx", "qy", "at"))


def _covers(pieces: DataFrame, side: float, flat: bool) -> DataFrame:
    """(id, piece, first1, first0, other1, other0) of the pieces that are level (flat) or not: whether the polygon s = 0 (any other one) holds what lies right of them (above them, if flat), and what lies on the other side."""
    c = F.col
    u, v = ("x", "y") if not flat else ("y", "x")  # the ray runs along u
    lines = pieces.select("id", "piece", "n1", "n0", *[c(f"{k}{u}").alias(f"{k}u") for k in "pq"], *[c(f"{k}{v}").alias(f"{k}v") for k in "pq"])
    asked = lines.where(((c("pu") == c("qu")) if flat else (c("pv") != c("qv")))).select("id", c("piece").alias("asked"), ((c("pu") + c("qu")) / 2).alias("mu"), ((c("pv") + c("qv")) / 2).alias("mv")).withColumn("band", F.floor(c("mv") / side))
    bands = lines.withColumn("band", F.explode(F.sequence(F.floor(F.least("pv", "qv") / side), F.floor(F.greatest("pv", "qv") / side))))
    meet = (F.least("pv", "qv") <= c("mv")) & (c("mv") < F.greatest("pv", "qv"))
    same = c("asked") == c("piece")
    beyond = meet & ~same & (c("pu") + (c("mv") - c("pv")) / (c("qv") - c("pv")) * (c("qu") - c("pu")) > c("mu"))
    more = F.signum(c("qv") - c("pv")).cast("int") * (-1 if flat else 1)  # what lies before a line is held by so many more than what lies beyond
    total = lambda n, which: F.coalesce(F.sum(F.when(which, more * c(n))), F.lit(0)) > 0
    sums = [total(n, which).alias(name + n[1]) for name, which in (("first", beyond), ("other", beyond | same)) for n in ("n1", "n0")]
    return bands.join(asked, ["id", "band"]).where(same | meet).groupBy("id", c("asked").alias("piece")).agg(*sums)


def combined(polygons: DataFrame, operation: str, side: float = 8.0, digits: int = 9) -> DataFrame:
    """(id, rings: RESULT) of polygons (id, s, rings): of each id the union of all, or the operation on the polygon of s = 0 and the union of the others. An id whose result is empty has no rings."""
    c = F.col
    parts = lambda t: t.select("id", "px", "py", "qx", "qy", "s.n1", "s.n0", "s.only")
    whole = _folded(_turned(edges_of(polygons, digits), side))
    short = stored(_folded(parts(_at_corners(whole, side, digits))), "edges")
    pieces = _folded(parts(pieces_of(short, side, digits))).select("id", "px", "py", "qx", "qy", "s.n1", "s.n0")
    end = lambda k: F.struct(c(f"{k}x").alias("x"), c(f"{k}y").alias("y"))
    pieces = stored(pieces.withColumn("piece", F.struct(end("p").alias("p"), end("q").alias("q"))), "pieces")
    known = _covers(pieces, side, False).unionByName(_covers(pieces, side, True))
    keep = OPERATIONS[operation]
    known = known.select("id", c("piece.p").alias("p"), c("piece.q").alias("q"), keep(c("first1"), c("first0")).alias("first"), keep(c("other1"), c("other0")).alias("other")).where("first <> other")
    # p is the lower end along x: of a piece that isn't level its right side is `first`, which is on the left if it runs down; of a level one, `first` is above, on the left if it runs to the right
    level = c("p.y") == c("q.y")
    ahead = F.when(level, c("first")).otherwise(c("first") == (c("q.y") < c("p.y")))
    turned = known.select("id", F.when(ahead, c("p")).otherwise(c("q")).alias("a"), F.when(ahead, c("q")).otherwise(c("p")).alias("b"))
    linked = turned.groupBy("id").agg(F.collect_list(F.struct(c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by"))).alias("pieces"))
    rings = _linked(linked)
    return polygons.select("id").distinct().join(rings, "id", "left").select("id", F.coalesce("rings", F.array().cast(RESULT)).alias("rings"))


def _linked(boundaries: DataFrame) -> DataFrame:
    """(id, rings) of boundaries (id, pieces)."""
    kind = boundaries.schema["id"].dataType.simpleString()
    ring = pa.list_(pa.struct([("part", pa.int32()), ("hole", pa.bool_()), ("ring", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [ringed([(p["ax"], p["ay"], p["bx"], p["by"]) for p in row]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, ring)], schema=pa.schema([batch.schema.field(0), ("rings", ring)]))

    return boundaries.mapInArrow(run, f"id {kind}, rings {RESULT}")


def ringed(pieces: list[tuple[float, float, float, float]]) -> list[dict]:
    """Rings of directed pieces with the inside on their left, parts before their holes; corners on straight lines go."""
    leaving: dict[tuple, list[tuple]] = defaultdict(list)
    for ax, ay, bx, by in pieces:
        leaving[ax, ay].append((atan2(by - ay, bx - ax), (bx, by)))
    left = set(pieces)
    rings = []
    for piece in sorted(pieces):
        if piece not in left:
            continue
        path, now = [], piece
        while now in left:
            left.discard(now)
            ax, ay, bx, by = now
            path.append((ax, ay))
            back = atan2(ay - by, ax - bx)
            ways = [((back - angle) % (2 * pi) or 2 * pi, to) for angle, to in leaving[bx, by] if (bx, by, *to) in left]
            if ways:
                now = (bx, by, *min(ways)[1])
        rings.append(path)
    rings = [r for path in rings if len(r := straightened(path)) > 2]
    size = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2
    parts = sorted((r for r in rings if size(r) > 0), key=lambda r: (min(r), size(r)))
    out = [{"part": k, "hole": False, "ring": r} for k, r in enumerate(parts)]
    for hole in (r for r in rings if size(r) < 0):
        around = [k for k, r in enumerate(parts) if size(r) > -size(hole) and holds(r, hole)]
        out.append({"part": min(around, key=lambda k: size(parts[k])) if around else 0, "hole": True, "ring": hole})
    closed = lambda r: [{"x": x, "y": y} for x, y in r + r[:1]]
    return [x | {"ring": closed(x["ring"])} for x in sorted(out, key=lambda x: (x["part"], x["hole"], min(x["ring"])))]


def straightened(path: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without the corners at which the line goes straight on."""
    bends = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])) > 1e-9 * max(abs(b[0] - a[0]) + abs(b[1] - a[1]), 1e-300) * max(abs(c[0] - b[0]) + abs(c[1] - b[1]), 1e-300)
    return [b for k, b in enumerate(path) if bends(path[k - 1], b, path[(k + 1) % len(path)])]


def holds(ring: list[tuple[float, float]], other: list[tuple[float, float]]) -> bool:
    """Whether a ring lies around another that doesn't cross it: by the first of the other's edge middles that isn't on it."""
    x, y = (other[0][0] + other[1][0]) / 2, (other[0][1] + other[1][1]) / 2
    return sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > x for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def paired(pairs: DataFrame, operation: str, **options) -> DataFrame:
    """(id, rings) of pairs (id, a, b), both arrays of rings."""
    both = pairs.select("id", F.lit(0).alias("s"), F.col("a").alias("rings")).unionByName(pairs.select("id", F.lit(1).alias("s"), F.col("b").alias("rings")))
    return combined(both, operation, **options)


def dissolved(features: DataFrame, group: str, **options) -> DataFrame:
    """(group, rings) of features (group, id: a whole number, rings): the union of each group's polygons, whatever their edges."""
    found = combined(features.select(F.col(group).alias("id"), F.col("id").alias("s"), "rings"), "union", **options)
    return found.withColumnRenamed("id", group)


def area_of(rings: Column) -> Column:
    """The area of a result: holes have a negative one."""
    cross = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda t, k: t + F.get(r, k - 1).x * F.get(r, k).y - F.get(r, k).x * F.get(r, k - 1).y) / 2
    return F.aggregate(rings, F.lit(0.0), lambda t, r: t + cross(r.ring))


def length_of(rings: Column) -> Column:
    """The length of a result's boundary."""
    step = lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))
    return F.aggregate(rings, F.lit(0.0), lambda t, r: t + F.aggregate(F.sequence(F.lit(1), F.size(r.ring) - 1), F.lit(0.0), lambda u, k: u + step(F.get(r.ring, k - 1), F.get(r.ring, k))))

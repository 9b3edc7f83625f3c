"""The engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grid
from .operators import autoregression, boundary, composite, coverage, cube, feature, image, interpolation, multiscale, overlay, permutation, regression, sight, spatial, splines, statistics, terrain, triangulation, warp, zonal
from .plans import catalogue
from .plans.expression import Place, compile_graph
from .sources import files
from .sources import fixtures as fx
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def halves(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded by multiplying, as SQL's round does: F.round goes by the shortest decimal number, which differs where a value lies a last bit off the middle."""
    def of(c: str):
        x = F.col(c) * F.lit(10.0**digits)
        whole = F.rint(F.abs(x))
        return (F.when(F.abs(x) - whole == 0.5, whole + 1).otherwise(whole) * F.signum(x) / F.lit(10.0**digits)).alias(c)

    return df.select(*[of(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None, build: Callable[[SparkSession, str], DataFrame], round_: Callable[[DataFrame], DataFrame] = rounded) -> None:
    QUERIES[name] = lambda spark, sf_dir: round_(build(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def year(spark: SparkSession, sf_dir: str, at: int) -> DataFrame:
    return fx.cube(spark, sf_dir).where(F.col("instant") == at).drop("instant")


def every_year(spark: SparkSession, sf_dir: str, ahead: int = 0) -> DataFrame:
    """All years of the cube, each a set of bands of its own; with ahead=1 each year has the next one's values."""
    return fx.cube(spark, sf_dir).select(F.concat_ws("-", "band", F.col("instant") - ahead).alias("band"), "px", "py", "value")


def whole(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.floor("value").cast("long"))


W = f"WITH {fx.CUBE}"
AB = f"{W}, a AS (SELECT * FROM cube WHERE instant = 1995), b AS (SELECT * FROM cube WHERE instant = 1996)"
#: The whole cube: bands are named by band and year; `b` has each year's next one under its name.
ALL = f"{W}, a AS (SELECT band || '-' || instant AS band, px, py, value FROM cube), b AS (SELECT band || '-' || (instant - 1) AS band, px, py, value FROM cube)"
SQL_BINARY = {"add": "a.value + b.value", "subtract": "a.value - b.value", "multiply": "a.value * b.value", "divide": "a.value / nullif(b.value, 0)", "pow": "pow(a.value, b.value / 32)", "mini": "least(a.value, b.value)", "maxi": "greatest(a.value, b.value)", "atan2": "atan2(a.value, b.value)"}
SQL_WHOLE = {"eq": "CAST(a.v = b.v AS INT)", "neq": "CAST(a.v <> b.v AS INT)", "gt": "CAST(a.v > b.v AS INT)", "gte": "CAST(a.v >= b.v AS INT)", "lt": "CAST(a.v < b.v AS INT)", "lte": "CAST(a.v <= b.v AS INT)", "and": "a.v & b.v", "or": "a.v | b.v"}
SQL_UNARY = {**{n: f"{n}(v)" for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "abs", "cbrt")}, "ceil": "CAST(ceil(v) AS BIGINT)", "floor": "CAST(floor(v) AS BIGINT)", "signum": "CAST(sign(v) AS DOUBLE)", "asin": "CASE WHEN abs(v) <= 1 THEN asin(v) END", "acos": "CASE WHEN abs(v) <= 1 THEN acos(v) END", "log": "CASE WHEN v > 0 THEN ln(v) END", "log10": "CASE WHEN v > 0 THEN log10(v) END", "sqrt": "CASE WHEN v >= 0 THEN sqrt(v) END", "round": "CAST(floor(v + 0.5) AS BIGINT)", "not": "~CAST(trunc(v) AS BIGINT)"}
SQL_CAST = {"toInt8": "(CAST(trunc(v) AS BIGINT) + 128 + 256) % 256 - 128", "toUint8": "CAST(trunc(v) AS BIGINT) % 256", "toInt16": "(CAST(trunc(v) AS BIGINT) + 32768) % 65536 - 32768", "toUint16": "CAST(trunc(v) AS BIGINT) % 65536", "toInt32": "CAST(trunc(v) AS INT)", "toFloat": "round(CAST(v AS FLOAT), 3)", "toDouble": "v"}
SQL_REDUCE = {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "median": "median(value)"}


def _r(x: str) -> str:
    return f"round({x}, 6)"


for _op in coverage.BINARY:
    if _op in SQL_BINARY:
        query(f"cov_{_op}", f"{ALL} SELECT a.band, a.px, a.py, {_r(SQL_BINARY[_op])} AS value FROM a JOIN b USING (band, px, py)", lambda s, d, op=_op: coverage.binary(every_year(s, d), every_year(s, d, 1).withColumn("value", F.col("value") / (32 if op == "pow" else 1)), op))
    else:
        query(f"cov_{_op}", f"{ALL}, af AS (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM a), bf AS (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM b) SELECT a.band, a.px, a.py, {SQL_WHOLE[_op]} AS value FROM af a JOIN bf b USING (band, px, py)", lambda s, d, op=_op: coverage.binary(whole(every_year(s, d)), whole(every_year(s, d, 1)), op))
for _op in coverage.UNARY:
    _sql = SQL_UNARY[_op]
    query(f"cov_{_op}", f"{ALL}, c AS (SELECT band, px, py, value / 8 - 0.25 AS v FROM a) SELECT band, px, py, {_r(_sql) if 'BIGINT' not in _sql else _sql} AS value FROM c", lambda s, d, op=_op: coverage.unary(every_year(s, d).withColumn("value", F.col("value") / 8 - 0.25), op))
for _op in coverage.CASTS:
    query(f"cov_{_op}", f"{ALL}, c AS (SELECT band, px, py, value * 7 AS v FROM a) SELECT band, px, py, {_r(SQL_CAST[_op]) if _op == 'toDouble' else SQL_CAST[_op]} AS value FROM c", lambda s, d, op=_op: coverage.cast(every_year(s, d).withColumn("value", F.col("value") * 7), op).withColumn("value", F.round("value", 3) if op == "toFloat" else F.col("value")))
for _op, _sql in SQL_REDUCE.items():
    query(f"mosaic_{_op}", f"{W} SELECT band, px, py, {_r(_sql)} AS value FROM cube GROUP BY ALL", lambda s, d, op=_op: coverage.mosaic(fx.cube(s, d), op))
    query(f"cov_focal_{_op}", f"{ALL} SELECT c.band, c.px, c.py, {_r(_sql.replace('value', 'n.value'))} AS value FROM a c JOIN a n ON c.band = n.band AND abs(c.px - n.px) <= 1 AND abs(c.py - n.py) <= 1 GROUP BY ALL", lambda s, d, op=_op: coverage.focal(every_year(s, d), op))
query("mosaic_mode", f"{W}, k AS (SELECT band, px, py, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM cube GROUP BY ALL) SELECT band, px, py, v AS value FROM k QUALIFY row_number() OVER (PARTITION BY band, px, py ORDER BY n DESC, v) = 1", lambda s, d: coverage.mosaic(whole(fx.cube(s, d)), "mode"))
for _op in ("or", "and"):
    query(f"mosaic_{_op}", f"{W} SELECT band, px, py, bit_{_op}(CAST(floor(value) AS BIGINT)) AS value FROM cube GROUP BY ALL", lambda s, d, op=_op: coverage.mosaic(whole(fx.cube(s, d)), op))
query("cov_select_bands", f"{AB} SELECT band, px, py, {_r('value')} AS value FROM a WHERE band IN ('NIR', 'Red')", lambda s, d: coverage.select_bands(year(s, d, 1995), ["NIR", "Red"]))
query("cov_binarization", f"{ALL} SELECT band, px, py, CASE WHEN value > 25 THEN 255 ELSE 0 END AS value FROM a", lambda s, d: coverage.binarization(every_year(s, d), 25))
query("cov_clamp", f"{ALL} SELECT band, px, py, {_r('least(greatest(value, 5), 30)')} AS value FROM a", lambda s, d: coverage.clamp(every_year(s, d), 5, 30))
query("cov_remap", f"{ALL} SELECT band, px, py, CAST(CASE floor(value) WHEN 4 THEN 1 WHEN 5 THEN 2 END AS DOUBLE) AS value FROM a", lambda s, d: coverage.remap(every_year(s, d).withColumn("value", F.floor("value")), {4: 1, 5: 2}))
query("cov_histogram", f"{ALL} SELECT band, CAST(floor(value / 2) AS BIGINT) AS bin, count(*) AS n FROM a GROUP BY ALL", lambda s, d: coverage.histogram(every_year(s, d), 2.0))
for _k, _rows in coverage.KERNELS.items():
    _terms = " ".join(f"WHEN n.px - c.px = {x - 1} AND n.py - c.py = {y - 1} THEN {w}" for y, r in enumerate(_rows) for x, w in enumerate(r))
    query(f"cov_convolve_{_k}", f"{ALL} SELECT c.band, c.px, c.py, {_r(f'sum(n.value * CASE {_terms} END)')} AS value FROM a c JOIN a n ON c.band = n.band AND abs(c.px - n.px) <= 1 AND abs(c.py - n.py) <= 1 GROUP BY ALL", lambda s, d, k=_k: coverage.convolve(every_year(s, d), coverage.KERNELS[k]))
query("terrain_slope", f"{ALL}, g AS (SELECT c.band, c.px, c.py, sum(n.value * (n.px - c.px) * (2 - abs(n.py - c.py))) AS gx, sum(n.value * (n.py - c.py) * (2 - abs(n.px - c.px))) AS gy FROM a c JOIN a n ON c.band = n.band AND abs(c.px - n.px) <= 1 AND abs(c.py - n.py) <= 1 GROUP BY ALL) SELECT band, px, py, {_r('degrees(atan(sqrt(gx * gx + gy * gy) / 8))')} AS value FROM g", lambda s, d: coverage.slope(every_year(s, d)))

_wide = f"{W}, w AS (SELECT * FROM wide)"
_thr = "CASE WHEN v > {t} THEN 255 WHEN v >= -1 THEN 0 END"
for _n, _f, _e in (("ndvi", cube.ndvi, "(NIR - Red) / nullif(NIR + Red, 0)"), ("ndwi", cube.ndwi, "(Green - NIR) / nullif(Green + NIR, 0)"), ("ndbi", cube.ndbi, "(SWIR1 - NIR) / nullif(SWIR1 + NIR, 0)")):
    query(f"idx_{_n}", f"{_wide} SELECT instant, px, py, {_r(_e)} AS value FROM w WHERE {_e} IS NOT NULL", lambda s, d, f=_f: f(fx.cube(s, d)))
query("idx_mndwi", f"{_wide}, i AS (SELECT instant, px, py, (Green - SWIR1) / nullif(Green + SWIR1, 0) AS v FROM w) SELECT instant, px, py, {_thr.format(t='0.1')} AS value FROM i WHERE v IS NOT NULL", lambda s, d: cube.mndwi(fx.cube(s, d), 0.1))
query("idx_savi", f"{_wide}, i AS (SELECT instant, px, py, 1.5 * (NIR - Red) / nullif(NIR + Red + 0.5, 0) AS v FROM w) SELECT instant, px, py, {_thr.format(t='0.2')} AS value FROM i WHERE v IS NOT NULL", lambda s, d: cube.savi(fx.cube(s, d), 0.2))
_ndwi = "ndwi AS (SELECT instant, px, py, (Green - NIR) / nullif(Green + NIR, 0) AS v FROM wide)"
query("change_water", f"{W}, {_ndwi} SELECT a.px, a.py, {_r('b.v - a.v')} AS value FROM ndwi a JOIN ndwi b USING (px, py) WHERE a.instant = 1995 AND b.instant = 1996 AND a.v IS NOT NULL AND b.v IS NOT NULL", lambda s, d: cube.change(cube.ndwi(fx.cube(s, d)), 1995, 1996))
query("wofs", f"{W}, {_ndwi} SELECT px, py, count(v) AS n_valid, count(*) FILTER (WHERE v > -0.8) AS n_water, {_r('count(*) FILTER (WHERE v > -0.8) / count(v)')} AS share FROM ndwi WHERE v IS NOT NULL GROUP BY ALL", lambda s, d: cube.water_share(cube.ndwi(fx.cube(s, d)), -0.8))
for _a in cube.AGGREGATES:
    query(f"dapa_area_{_a}", f"{W} SELECT band, px, py, {_r(f'{_a}(value)')} AS value FROM cube WHERE instant BETWEEN 1994 AND 1996 AND px BETWEEN 2 AND 9 AND py BETWEEN 0 AND 7 GROUP BY ALL", lambda s, d, a=_a: cube.area_raster(cube.subset(fx.cube(s, d), None, 1994, 1996, (2, 0, 9, 7)), a))
    query(f"dapa_timeseries_area_{_a}", f"{W} SELECT band, instant, {_r(f'{_a}(value)')} AS value FROM cube GROUP BY ALL", lambda s, d, a=_a: cube.area_series(fx.cube(s, d), a))
    query(f"dapa_value_area_{_a}", f"{W}, t AS (SELECT band, instant, {_a}(value) AS v FROM cube GROUP BY ALL) SELECT band, {_r(f'{_a}(v)')} AS value FROM t GROUP BY ALL", lambda s, d, a=_a: cube.area_value(fx.cube(s, d), a))
    query(f"dapa_value_position_{_a}", f"{W} SELECT band, {_r(f'{_a}(value)')} AS value FROM cube WHERE px = 3 AND py = 5 GROUP BY ALL", lambda s, d, a=_a: cube.position_value(fx.cube(s, d), 3, 5, a))
query("dapa_timeseries_position", f"{W} SELECT band, instant, {_r('value')} AS value FROM cube WHERE px = 3 AND py = 5", lambda s, d: cube.position_series(fx.cube(s, d), 3, 5))
query("cube_subset", f"{W} SELECT band, instant, px, py, {_r('value')} AS value FROM cube WHERE band IN ('NIR', 'Red') AND instant BETWEEN 1993 AND 1994 AND px BETWEEN 0 AND 3 AND py BETWEEN 4 AND 9", lambda s, d: cube.subset(fx.cube(s, d), ["NIR", "Red"], 1993, 1994, (0, 4, 3, 9)))

_bi = "bi AS (SELECT c_nationkey AS nation, month(o_orderdate) AS month, o_orderpriority AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey)"


def bi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


query("olap_rollup", f"WITH {_bi} SELECT nation, priority, sum(cents)::BIGINT AS total, count(*) AS n FROM bi GROUP BY ROLLUP (nation, priority)", lambda s, d: cube.rollup(bi(s, d), ["nation", "priority"], "cents"))
query("olap_cube", f"WITH {_bi} SELECT month, priority, sum(cents)::BIGINT AS total, count(*) AS n FROM bi GROUP BY CUBE (month, priority)", lambda s, d: cube.data_cube(bi(s, d), ["month", "priority"], "cents"))
query("star_query", f"WITH {_bi} SELECT n_name, r_name, sum(cents)::BIGINT AS total FROM bi JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE month BETWEEN 3 AND 6 AND priority IN ('1-URGENT', '2-HIGH') GROUP BY ALL", lambda s, d: bi(s, d).where("month between 3 and 6 and priority in ('1-URGENT', '2-HIGH')").join(fx.table(s, d, "nation"), F.col("nation") == F.col("n_nationkey")).join(fx.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.sum("cents").alias("total")))

P, C, N = f"WITH {fx.SUPPLIERS}", f"WITH {fx.CUSTOMERS}", f"WITH {fx.NATIONS}"
_d = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_all = f"{P}, pairs AS (SELECT a.id AS i, b.id AS j, {_d} AS d, b.v AS vj FROM pts a, pts b)"
_knn = f"{_all}, knn AS (SELECT i, j, d FROM pairs WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 4)"
query("within_distance_join", f"{_all} SELECT i, j, {_r('d')} AS d FROM pairs WHERE d <= 12", lambda s, d: spatial.within_distance(fx.suppliers(s, d), fx.suppliers(s, d), 12.0).drop("vj"))
query("grid_spatial_join", f"{C} SELECT p.id AS point, b.k AS box FROM pts p JOIN (SELECT unnest(range(40)) AS k) b ON p.x >= b.k * 200 AND p.x < b.k * 200 + 350 AND p.y >= b.k * 150 AND p.y < b.k * 150 + 420", lambda s, d: spatial.points_in_boxes(fx.customers(s, d), s.range(40).select("id", (F.col("id") * 200.0).alias("x0"), (F.col("id") * 150.0).alias("y0"), (F.col("id") * 200 + 350.0).alias("x1"), (F.col("id") * 150 + 420.0).alias("y1")), 300.0))
query("overlap_semi_join", f"{C} SELECT p.id FROM pts p WHERE EXISTS (SELECT 1 FROM range(40) b(k) WHERE p.x >= b.k * 200 AND p.x < b.k * 200 + 350 AND p.y >= b.k * 150 AND p.y < b.k * 150 + 420)", lambda s, d: spatial.points_in_boxes(fx.customers(s, d), s.range(40).select("id", (F.col("id") * 200.0).alias("x0"), (F.col("id") * 150.0).alias("y0"), (F.col("id") * 200 + 350.0).alias("x1"), (F.col("id") * 150 + 420.0).alias("y1")), 300.0).select(F.col("point").alias("id")).distinct())


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = fx.suppliers(spark, sf_dir)
    return spatial.nearest(pts, pts, 4, same=True)


for _s, _w in (("W", "1.0 / count(*) OVER (PARTITION BY i)"), ("B", "1.0"), ("C", "(SELECT count(DISTINCT i) FROM {t}) / (SELECT count(*) FROM {t})"), ("U", "1.0 / (SELECT count(*) FROM {t})")):
    query(f"knn_weights_{_s}", f"{_knn} SELECT i, j, {_r('CAST(' + _w.format(t='knn') + ' AS DOUBLE)')} AS w FROM knn", lambda s, d, st=_s: spatial.styled(knn(s, d).select("i", "j"), st))
    query(f"contiguity_{_s}", f"{N}, nb AS (SELECT a.id AS i, b.id AS j FROM poly a JOIN poly b ON a.id <> b.id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1) SELECT i, j, {_r('CAST(' + _w.format(t='nb') + ' AS DOUBLE)')} AS w FROM nb", lambda s, d, st=_s: spatial.styled(spatial.touching(fx.nations(s, d)), st))
for _k, _w in (("gaussian", "exp(-0.5 * d * d / 100)"), ("exponential", "exp(-d / 10)"), ("bisquare", "CASE WHEN d <= 10 THEN pow(1 - d * d / 100, 2) ELSE 0 END"), ("tricube", "CASE WHEN d <= 10 THEN pow(1 - d * d * d / 1000, 3) ELSE 0 END"), ("boxcar", "CASE WHEN d <= 10 THEN 1.0 ELSE 0 END")):
    query(f"kernel_weights_{_k}", f"{_all} SELECT i, j, {_r(f'CAST({_w} AS DOUBLE)')} AS w FROM pairs WHERE d <= {80 if _k in ('gaussian', 'exponential') else 10}", lambda s, d, k=_k: spatial.kernel_weights(fx.suppliers(s, d), 10.0, k, digits=6).select("i", "j", "w"), lambda df: df)
query("adaptive_weights", f"{_all}, near AS (SELECT i, j, d FROM pairs QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 6), width AS (SELECT i, max(d) AS m FROM near GROUP BY i) SELECT i, j, {_r('pow(1 - d * d / (m * m), 2)')} AS w FROM near JOIN width USING (i)", lambda s, d: spatial.adaptive_weights(fx.suppliers(s, d), 6, "bisquare").select("i", "j", "w"))

_z = f"{_knn}, z AS (SELECT id, v - avg(v) OVER () AS z, var_pop(v) OVER () AS s2, count(*) OVER () AS n FROM pts), wz AS (SELECT k.i, k.j, 0.25 AS w, a.z AS zi, b.z AS zj, a.s2, a.n FROM knn k JOIN z a ON a.id = k.i JOIN z b ON b.id = k.j)"
weights = lambda s, d: spatial.styled(knn(s, d).select("i", "j"), "W")
values = lambda s, d: fx.suppliers(s, d).select("id", "v")
query("moran_global", f"{_z}, one AS (SELECT sum(w) AS s0, sum(w * zi * zj) AS c, max(s2) AS s2, max(n) AS n FROM wz), both_ways AS (SELECT i, j, w FROM wz UNION ALL SELECT j, i, w FROM wz), s1 AS (SELECT sum(q) / 2 AS s1 FROM (SELECT sum(w) * sum(w) AS q FROM both_ways GROUP BY i, j)), s2x AS (SELECT sum(q) AS s2x FROM (SELECT sum(w) * sum(w) AS q FROM both_ways GROUP BY i)), r AS (SELECT c / s0 / s2 AS i, -1.0 / (n - 1) AS expected, (n * n * s1 - n * s2x + 3 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - 1.0 / ((n - 1.0) * (n - 1.0)) AS variance FROM one, s1, s2x) SELECT {_r('i')} AS i, {_r('CAST(expected AS DOUBLE)')} AS expected, {_r('variance')} AS variance, {_r('(i - expected) / sqrt(variance)')} AS z FROM r", lambda s, d: statistics.moran_global(values(s, d), weights(s, d)))
query("moran_local", f"{_z} SELECT i AS id, {_r('any_value(zi) / any_value(s2) * sum(w * zj)')} AS i FROM wz GROUP BY wz.i", lambda s, d: statistics.moran_local(values(s, d), weights(s, d)))
query("geary_global", f"{_z} SELECT {_r('(max(n) - 1) / (2 * max(n) * max(s2)) * sum(w * (zi - zj) * (zi - zj)) / sum(w)')} AS c FROM wz", lambda s, d: statistics.geary_global(values(s, d), weights(s, d)))
query("geary_local", f"{_z} SELECT i AS id, {_r('sum(w * (zi - zj) * (zi - zj)) / any_value(s2)')} AS c FROM wz GROUP BY wz.i", lambda s, d: statistics.geary_local(values(s, d), weights(s, d)))
query("getis_g", f"{_knn}, m AS (SELECT count(*) - 1.0 AS n, sum(v) AS s, sum(v * v) AS q FROM pts), l AS (SELECT i, sum(0.25 * v) AS lag, 1.0 AS w, 0.25 AS w2 FROM knn JOIN pts ON id = j GROUP BY i), e AS (SELECT i, lag, w, w2, n, (s - v) / n AS mean, (q - v * v) / n AS q FROM l JOIN pts ON id = i, m) SELECT i AS id, {_r('(lag - mean * w) / (sqrt(q - mean * mean) * sqrt((n * w2 - w * w) / (n - 1)))')} AS g FROM e", lambda s, d: statistics.getis_ord(values(s, d), weights(s, d)))
query("ann", f"{_all}, o AS (SELECT avg(d) AS observed FROM (SELECT min(d) AS d FROM pairs WHERE i <> j GROUP BY i)), b AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM pts), e AS (SELECT *, 0.5 / sqrt(n / area) AS expected FROM o, b) SELECT {_r('observed')} AS observed, {_r('expected')} AS expected, {_r('observed / expected')} AS ratio, {_r('(observed - expected) / (0.26136 / sqrt(n * n / area))')} AS z FROM e", lambda s, d: statistics.average_nearest_neighbour(fx.suppliers(s, d)))
query("ripley_k", f"{_all}, b AS (SELECT count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS h FROM pts), st AS (SELECT k, k * (greatest(w, h) / 4 / 10) AS r, w * h AS area, n FROM b, range(1, 11) t(k)) SELECT {_r('r')} AS d, {_r('sqrt(area * (SELECT count(*) FROM pairs WHERE i <> j AND d < r) / (pi() * n * (n - 1)))')} AS l FROM st", lambda s, d: statistics.ripley(fx.suppliers(s, d)))
query("describe", f"{P}, l AS (SELECT 'x' AS name, x AS v FROM pts UNION ALL SELECT 'v', v FROM pts) SELECT name, count(v) AS n, {_r('sum(v)')} AS total, {_r('stddev_pop(v)')} AS stdev, {_r('var_pop(v)')} AS variance, max(v) AS largest, min(v) AS smallest FROM l GROUP BY name", lambda s, d: statistics.describe(fx.suppliers(s, d), ["x", "v"]))
query("pearson", "WITH c AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem), m AS (SELECT corr(q, p) AS qp, corr(q, d) AS qd, corr(p, d) AS pd FROM c) SELECT a, b, round(r, 6) AS r FROM (SELECT unnest(['q', 'q', 'p', 'p', 'd', 'd', 'q', 'p', 'd']) AS a, unnest(['p', 'd', 'q', 'd', 'q', 'p', 'q', 'p', 'd']) AS b, unnest([qp, qd, qp, pd, qd, pd, 1, 1, 1]) AS r FROM m)", lambda s, d: statistics.correlations(fx.table(s, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d")), ["q", "p", "d"]))
query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r", lambda s, d: statistics.spearman(fx.table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))
query("acf", "WITH t AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS t, avg(value) AS x FROM events GROUP BY ALL), z AS (SELECT t, x - (SELECT avg(x) FROM t) AS z FROM t) SELECT CAST(k AS INT) AS lag, round(sum(a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS acf FROM range(0, 11) r(k), z a JOIN z b ON b.t = a.t + k GROUP BY k", lambda s, d: statistics.autocorrelation(fx.table(s, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t")).agg(F.avg("value").alias("x")), 10))
_q = "SELECT 1 - sum(n * s2) / (SELECT count(*) * var_pop(l_extendedprice) FROM lineitem) AS q FROM (SELECT count(*) AS n, var_pop(l_extendedprice) AS s2 FROM lineitem GROUP BY {k})"
query("geodetector_factor", "SELECT 'l_returnflag' AS factor, round(q, 6) AS q FROM (" + _q.format(k="l_returnflag") + ") UNION ALL SELECT 'l_linenumber', round(q, 6) FROM (" + _q.format(k="l_linenumber") + ")", lambda s, d: statistics.factor_detector(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linenumber"]))
query("geodetector_interaction", "WITH a AS (" + _q.format(k="l_returnflag") + "), b AS (" + _q.format(k="l_linenumber") + "), c AS (" + _q.format(k="l_returnflag, l_linenumber") + ") SELECT 'l_returnflag' AS a, 'l_linenumber' AS b, round(c.q, 6) AS q, CASE WHEN c.q < least(a.q, b.q) THEN 'weaken, nonlinear' WHEN c.q < greatest(a.q, b.q) THEN 'weaken, uni-' WHEN c.q = a.q + b.q THEN 'independent' WHEN c.q > a.q + b.q THEN 'enhance, nonlinear' ELSE 'enhance, bi-' END AS kind FROM a, b, c", lambda s, d: statistics.interaction_detector(fx.table(s, d, "lineitem"), "l_extendedprice", "l_returnflag", "l_linenumber"))
query("geodetector_risk", "WITH s AS (SELECT l_returnflag AS f, avg(l_quantity) AS m, var_samp(l_quantity) AS s2, count(*) AS n FROM lineitem GROUP BY 1) SELECT a.f AS a, b.f AS b, round(a.m - b.m, 6) AS difference, round((a.m - b.m) / sqrt(a.s2 / a.n + b.s2 / b.n), 6) AS t FROM s a JOIN s b ON a.f < b.f", lambda s, d: statistics.risk_detector(fx.table(s, d, "lineitem"), "l_quantity", "l_returnflag"))
query("sample_stratified", f"{C} SELECT g, id FROM pts QUALIFY row_number() OVER (PARTITION BY g ORDER BY id * 7919 % 10007, id) <= 5", lambda s, d: statistics.stratified_sample(fx.customers(s, d), "g", 5, "id * 7919 % 10007"))
query("sample_regular", f"{C} SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, min(id) AS id FROM pts GROUP BY ALL", lambda s, d: statistics.regular_sample(fx.customers(s, d), 1000.0))

_grid = f"{P}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), cells AS (SELECT k AS id, x0 + (k % 20 + 0.5) * ((x1 - x0) / 20) AS x, y0 + (k // 20 + 0.5) * ((y1 - y0) / 20) AS y FROM b, range(400) r(k)), near AS (SELECT a.id, b.id AS j, {_d} AS d, b.v FROM cells a, pts b)"
cells = lambda s, d: statistics.grid(fx.suppliers(s, d), 20, 20)
query("nearest_interpolation", f"{_grid} SELECT id, v FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, j) = 1", lambda s, d: statistics.nearest_interpolation(fx.suppliers(s, d), cells(s, d)))
query("idw", f"{_grid} SELECT id, {_r('coalesce(avg(v) FILTER (WHERE d = 0), sum(v / (d * d)) FILTER (WHERE d > 0) / sum(1 / (d * d)) FILTER (WHERE d > 0))')} AS v FROM near WHERE d <= 15 GROUP BY id", lambda s, d: statistics.inverse_distance(fx.suppliers(s, d), cells(s, d), 15.0))
query("kde", f"{_grid} SELECT id, {_r('sum(pow(1 - d * d / 225, 2)) / (SELECT count(*) FROM pts)')} AS v FROM near WHERE d <= 15 GROUP BY id", lambda s, d: statistics.density(fx.suppliers(s, d), cells(s, d), 15.0))

query("ols_1", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem) SELECT 'intercept' AS term, round(a, 3) AS coefficient, round(r2, 6) AS r2 FROM m UNION ALL SELECT 'l_quantity', round(b, 3), round(r2, 6) FROM m", lambda s, d: regression.linear(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]).drop("aic").withColumn("coefficient", F.round("coefficient", 3)))
query("ols_2", None, lambda s, d: regression.linear(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))
query("logistic", None, lambda s, d: regression.generalised(fx.table(s, d, "lineitem").withColumn("late", (F.col("l_returnflag") == "R").cast("int")), "late", ["l_quantity", "l_discount"], "logistic"))
query("poisson", None, lambda s, d: regression.generalised(fx.table(s, d, "lineitem"), "l_linenumber", ["l_quantity", "l_discount"], "poisson"))
_gw = f"{P}, p AS (SELECT a.id, a.v AS y0, a.x AS x0, b.v AS y, b.x AS x, pow(1 - pow({_d} / 40, 2), 2) AS w FROM pts a, pts b WHERE {_d} < 40), s AS (SELECT id, any_value(y0) AS y0, any_value(x0) AS x0, sum(w) AS s, sum(w * w) AS q, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM p GROUP BY id)"
query("gwr_1var", f"{_gw}, f AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b FROM s) SELECT id, round(b, 4) AS slope, round((sy - b * sx) / s + b * x0, 4) AS yhat FROM f", lambda s, d: regression.weighted_regression(fx.suppliers(s, d), "v", ["x"], 40.0).select("id", F.round(F.col("beta")[1], 4).alias("slope"), F.round("yhat", 4).alias("yhat")))
query("gw_average", f"{_gw} SELECT id, {_r('sy / s')} AS mean, round(syy / s - sy / s * sy / s, 3) AS variance FROM s", lambda s, d: regression.weighted_average(fx.suppliers(s, d), "v", 40.0).select("id", "mean", F.round("variance", 3).alias("variance")))
query("gw_corr", f"{_gw} SELECT id, round((sxy / s - sx / s * sy / s) / sqrt((sxx / s - sx / s * sx / s) * (syy / s - sy / s * sy / s)), 6) AS r FROM s", lambda s, d: regression.weighted_correlation(fx.suppliers(s, d), "x", "v", 40.0).select("id", "r"))

_poly = f"{N}"
query("feat_measures", f"{_poly} SELECT id, 1.0::DOUBLE AS area, 4.0::DOUBLE AS length, cx + 0.5::DOUBLE AS x, cy + 0.5::DOUBLE AS y, cx::DOUBLE AS x0, cy + 1::DOUBLE AS y1 FROM poly", lambda s, d: fx.nations(s, d).select("id", feature.area(F.col("ring")).alias("area"), feature.length(F.col("ring")).alias("length"), feature.centroid(F.col("ring")).alias("c"), feature.bounds(F.col("ring")).alias("b")).select("id", "area", "length", "c.x", "c.y", "b.x0", "b.y1"))
query("feat_contains", f"{_poly} SELECT id, cx = 2 AND cy = 1 AS inside FROM poly", lambda s, d: fx.nations(s, d).select("id", feature.contains(F.col("ring"), F.lit(2.25), F.lit(1.5)).alias("inside")))
query("feat_reproject", f"{_poly} SELECT id, {_r('radians(cx) * 6378137')} AS x, {_r('ln(tan(pi() / 4 + radians(cy) / 2)) * 6378137')} AS y FROM poly", lambda s, d: fx.nations(s, d).select("id", feature.reproject(F.col("ring"), "EPSG:3857")[0].alias("p")).select("id", "p.x", "p.y"))
props = lambda s, d: fx.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("props"))
query("feat_props_get", "SELECT n_nationkey AS id, CAST(n_regionkey AS DOUBLE) AS region FROM nation", lambda s, d: feature.get_property(props(s, d), "region", "double"))
query("feat_props_set", "SELECT n_nationkey AS id, 'z' AS name FROM nation", lambda s, d: feature.get_property(feature.set_properties(props(s, d), {"name": "z"}), "name"))
query("feat_props_keys", "SELECT n_nationkey AS id, 'name,region' AS names FROM nation", lambda s, d: feature.property_names(props(s, d)))
query("tms_zcurve", f"{C}, l AS (SELECT id, x / 10007 * 360 - 180 AS lon, y / 9973 * 160 - 80 AS lat FROM pts), t AS (SELECT id, CAST(floor((lon + 180) / 360 * 256) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256) AS BIGINT) AS ty FROM l) SELECT id, tx, ty, {' + '.join(f'(((tx >> {k}) & 1) << {2 * k}) + (((ty >> {k}) & 1) << {2 * k + 1})' for k in range(8))} AS z FROM t", lambda s, d: fx.customers(s, d).select("id", grid.tile_x(F.col("x") / 10007 * 360 - 180, 8).alias("tx"), grid.tile_y(F.col("y") / 9973 * 160 - 80, 8).alias("ty")).select("id", "tx", "ty", grid.z_curve(F.col("tx"), F.col("ty"), 8).alias("z")))
query("event_windows", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", lambda s, d: windows.tumbling(fx.table(s, d, "events"), "6 hours").withColumn("total", F.round("total", 4)))

#: The normalised-difference request: both bands of every year's coverage, as doubles, subtracted, added and divided.
NDVI_GRAPH = """{"0": {"functionInvocationValue": {"functionName": "Coverage.divide", "arguments": {"a": {"valueReference": "1"}, "b": {"valueReference": "2"}}}},
"1": {"functionInvocationValue": {"functionName": "Coverage.subtract", "arguments": {"a": {"valueReference": "3"}, "b": {"valueReference": "4"}}}},
"2": {"functionInvocationValue": {"functionName": "Coverage.add", "arguments": {"a": {"valueReference": "3"}, "b": {"valueReference": "4"}}}},
"3": {"functionInvocationValue": {"functionName": "Coverage.toDouble", "arguments": {"a": {"functionInvocationValue": {"functionName": "Service.getCoverage", "arguments": {"id": {"constantValue": "one"}}}}}}},
"4": {"functionInvocationValue": {"functionName": "Coverage.toDouble", "arguments": {"a": {"functionInvocationValue": {"functionName": "Service.getCoverage", "arguments": {"id": {"constantValue": "two"}}}}}}}}"""
query("dag_normalised", f"{AB} SELECT a.band, a.px, a.py, {_r('(a.value - b.value) / nullif(a.value + b.value, 0)')} AS value FROM a JOIN b USING (band, px, py)", lambda s, d: compile_graph(NDVI_GRAPH, {"one": year(s, d, 1995), "two": year(s, d, 1996)}))
query("flagship_ndvi", f"{W} SELECT px, py, round(avg((NIR - Red) / nullif(NIR + Red, 0)), 6) AS value FROM wide GROUP BY ALL", lambda s, d: cube.ndvi(fx.cube(s, d)).groupBy("px", "py").agg(F.avg("value").alias("value")))

_win = "c.band = n.band AND abs(c.px - n.px) <= 1 AND abs(c.py - n.py) <= 1"
_g = f"{ALL}, f AS (SELECT band, px, py, floor(value) AS value FROM a), g AS (SELECT c.band, c.px, c.py, sum(n.value * (n.px - c.px) * (2 - abs(n.py - c.py))) / 8 AS gx, sum(n.value * (n.py - c.py) * (2 - abs(n.px - c.px))) / 8 AS gy FROM f c JOIN f n ON {_win} GROUP BY ALL)"
query("terrain_aspect", f"{_g}, t AS (SELECT band, px, py, CASE WHEN gx <> 0 OR gy <> 0 THEN degrees(atan2(-gx, gy)) END AS v FROM g) SELECT band, px, py, {_r('CASE WHEN v < 0 THEN v + 360 ELSE abs(v) END')} AS value FROM t", lambda s, d: terrain.aspect(whole(every_year(s, d))))
query("terrain_hillshade", f"{_g}, l AS (SELECT band, px, py, (sin(radians(45)) + cos(radians(45)) * (gy * cos(radians(315)) - gx * sin(radians(315)))) / sqrt(1 + gx * gx + gy * gy) AS v FROM g) SELECT band, px, py, {_r('CASE WHEN v > 0 THEN 1 + 254 * v ELSE 1.0 END')} AS value FROM l", lambda s, d: terrain.hillshade(whole(every_year(s, d))))
for _n, _f, _e in (("ruggedness", terrain.ruggedness, "avg(abs(n.value - c.value))"), ("position", terrain.position_index, "any_value(c.value) - avg(n.value)"), ("roughness", terrain.roughness, "greatest(max(n.value), any_value(c.value)) - least(min(n.value), any_value(c.value))")):
    query(f"terrain_{_n}", f"{ALL} SELECT c.band, c.px, c.py, {_r(_e)} AS value FROM a c JOIN a n ON {_win} AND (c.px <> n.px OR c.py <> n.py) GROUP BY ALL", lambda s, d, f=_f: f(every_year(s, d)))
query("resample_coarser", f"{ALL} SELECT band, px // 4 AS px, py // 4 AS py, {_r('avg(value)')} AS value FROM a GROUP BY ALL", lambda s, d: terrain.coarser(every_year(s, d), 4))
query("resample_finer", f"{ALL} SELECT band, px * 2 + i AS px, py * 2 + j AS py, {_r('value')} AS value FROM a, range(2) t(i), range(2) u(j)", lambda s, d: terrain.finer(every_year(s, d), 2))
query("map_patch", f"{ALL}, e AS (SELECT * FROM a WHERE px % 2 = 0) SELECT band, px, py, {_r('coalesce(e.value, b.value)')} AS value FROM e FULL JOIN b USING (band, px, py)", lambda s, d: terrain.patch(every_year(s, d).where("px % 2 = 0"), every_year(s, d, 1)))
query("map_cross", f"{ALL} SELECT a.band, px, py, dense_rank() OVER (ORDER BY floor(a.value), floor(b.value)) - 1 AS value FROM a JOIN b USING (band, px, py)", lambda s, d: terrain.cross(whole(every_year(s, d)), whole(every_year(s, d, 1))))
query("map_blend", f"{ALL} SELECT a.band, px, py, {_r('a.value * 0.25 + b.value * (1 - 0.25)')} AS value FROM a JOIN b USING (band, px, py)", lambda s, d: terrain.blend(every_year(s, d), every_year(s, d, 1), 25))
query("map_shade", f"{ALL} SELECT a.band, px, py, {_r('least(255, greatest(0, a.value / 255 * b.value * 1.2))')} AS value FROM a JOIN b USING (band, px, py)", lambda s, d: halves(terrain.shade(every_year(s, d), every_year(s, d, 1), 20)))
query("map_rgb", f"{AB}, l AS (SELECT px, py, band, floor(least(255, greatest(0, value)) * 32 / 256) AS v FROM a) SELECT px, py, CAST(max(v) FILTER (WHERE band = 'Red') * 1024 + max(v) FILTER (WHERE band = 'NIR') * 32 + max(v) FILTER (WHERE band = 'Green') AS BIGINT) AS value FROM l GROUP BY ALL", lambda s, d: terrain.rgb(year(s, d, 1995), ["Red", "NIR", "Green"]))
query("cov_add_bands", f"{AB} SELECT band, px, py, {_r('value')} AS value FROM a WHERE band IN ('NIR', 'Red') UNION ALL SELECT band, px, py, {_r('value')} FROM b WHERE band = 'Green'", lambda s, d: terrain.add_bands(year(s, d, 1995).where("band in ('NIR', 'Red')"), year(s, d, 1996), ["Red", "Green"]))
query("cov_rename_bands", f"{AB} SELECT CASE band WHEN 'Red' THEN 'B4' WHEN 'NIR' THEN 'B5' ELSE band END AS band, px, py, {_r('value')} AS value FROM a", lambda s, d: terrain.rename_bands(year(s, d, 1995), {"Red": "B4", "NIR": "B5"}))
query("ard_reflectance", f"{ALL} SELECT band, px, py, {_r('(CASE WHEN value <> 0 THEN value * 0.5 - 1.5 END - 0.25) * (pi() * 0.98 * 0.98 / (150.0 * cos(radians(35))))')} AS value FROM a", lambda s, d: terrain.reflectance(every_year(s, d), 0.5, -1.5, 150.0, 35.0, 0.98, 0.25))
_scenes = f"{W}, sc AS (SELECT * FROM wide WHERE Red IS NOT NULL AND NIR IS NOT NULL AND Green IS NOT NULL)"
query("composite_medoid", f"{_scenes}, t AS (SELECT p.px, p.py, p.instant, any_value(p.Red) AS Red, any_value(p.NIR) AS NIR, any_value(p.Green) AS Green, round(sum(sqrt((p.Red - q.Red) * (p.Red - q.Red) + (p.NIR - q.NIR) * (p.NIR - q.NIR) + (p.Green - q.Green) * (p.Green - q.Green))), 9) AS total FROM sc p JOIN sc q ON p.px = q.px AND p.py = q.py GROUP BY ALL) SELECT px, py, instant, {_r('Red')} AS Red, {_r('NIR')} AS NIR, {_r('Green')} AS Green FROM t QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY total, instant) = 1", lambda s, d: composite.medoid(fx.cube(s, d), ["Red", "NIR", "Green"]))
query("composite_geomedian", None, lambda s, d: composite.geometric_median(fx.cube(s, d), ["Red", "NIR", "Green"]))
quality = lambda s, d: fx.cube(s, d).where("band = 'Green'").select("instant", "px", "py", F.floor("value").alias("code"))
query("cloud_free_median", f"{W} SELECT band, px, py, {_r('median(value) FILTER (WHERE floor(wide.Green) NOT IN (5, 6))')} AS value FROM cube JOIN wide USING (instant, px, py) GROUP BY ALL", lambda s, d: coverage.mosaic(composite.masked(fx.cube(s, d), quality(s, d), [5, 6]), "median"))

query("variogram", f"{_all} SELECT CAST(least(floor(d / 2.0), 9) AS BIGINT) AS bin, count(*) AS n, {_r('avg(d)')} AS d, round(avg((b.v - a.v) * (b.v - a.v)) / 2, 2) AS gamma FROM pairs JOIN pts a ON a.id = i JOIN pts b ON b.id = j WHERE i < j AND d <= 20 GROUP BY 1", lambda s, d: interpolation.variogram(fx.suppliers(s, d), 20.0, 10).withColumn("gamma", F.round("gamma", 2)))


def kriged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = fx.suppliers(spark, sf_dir)
    found = interpolation.fitted_variogram(pts, 40.0)
    return interpolation.kriging(pts, cells(spark, sf_dir), 16, "Sph", found["nugget"], found["sill"], found["range"])


query("kriging", None, kriged)
query("thin_plate", None, lambda s, d: interpolation.thin_plate(fx.suppliers(s, d), cells(s, d)))
query("spatial_lag_model", None, lambda s, d: autoregression.lag_model(fx.suppliers(s, d), weights(s, d), "v", ["x"]))
query("spatial_error_model", None, lambda s, d: autoregression.error_model(fx.suppliers(s, d), weights(s, d), "v", ["x"]))
query("gw_quantiles", f"{_gw}, g AS (SELECT id, y, sum(w) AS w FROM p GROUP BY ALL), u AS (SELECT id, y, sum(w) OVER (PARTITION BY id ORDER BY y) AS upto, sum(w) OVER (PARTITION BY id) AS total FROM g) SELECT id, {', '.join(f'round(min(y) FILTER (WHERE upto >= total * {q / 100} - 1e-12), 6) AS q{q}' for q in (25, 50, 75))} FROM u GROUP BY id", lambda s, d: regression.weighted_quantiles(fx.suppliers(s, d), "v", 40.0))
query("gw_components", f"{P}, p AS (SELECT a.id, b.x, b.y, pow(1 - pow({_d} / 40, 2), 2) AS w FROM pts a, pts b WHERE {_d} < 40), m AS (SELECT id, count(*) AS n, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS a, sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2) AS c, sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w) AS b FROM p GROUP BY id), e AS (SELECT id, CASE WHEN n > 5 THEN (a + c) / 2 ELSE 0 END AS h, CASE WHEN n > 5 THEN sqrt((a - c) * (a - c) / 4 + b * b) ELSE 0 END AS r FROM m) SELECT id, round(h + r, 4) AS largest, round(h - r, 4) AS smallest FROM e", lambda s, d: regression.weighted_components(fx.suppliers(s, d), ["x", "y"], 40.0).select("id", F.round(F.col("variances")[0], 4).alias("largest"), F.round(F.col("variances")[1], 4).alias("smallest")))
query("gw_discriminant", f"{C}, p AS (SELECT a.id, a.v AS here, b.g, b.v, pow(1 - pow({_d} / 800, 2), 2) AS w FROM pts a JOIN pts b ON abs(a.x - b.x) < 800 AND abs(a.y - b.y) < 800 WHERE {_d} < 800), k AS (SELECT id, g, any_value(here) AS here, sum(w) AS s, sum(w * v) / sum(w) AS m, sum(w * v * v) / sum(w) AS q FROM p GROUP BY ALL), c AS (SELECT *, s / sum(s) OVER i AS share, sum(s * (q - m * m)) OVER i / sum(s) OVER i + 1e-6 * greatest(1, sum(s * q) OVER i / sum(s) OVER i) AS s2 FROM k WINDOW i AS (PARTITION BY id)), l AS (SELECT id, g, ln(share) - (here - m) * (here - m) / s2 / 2 AS score FROM c), z AS (SELECT id, g, score, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM l) SELECT id, g AS predicted, round(e / sum(e) OVER (PARTITION BY id), 4) AS share FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, g) = 1", lambda s, d: regression.weighted_discriminant(fx.customers(s, d), "g", ["v"], 800.0).select("id", "predicted", F.round("share", 4).alias("share")))
query("gw_poisson", None, lambda s, d: regression.weighted_generalised(fx.suppliers(s, d).withColumn("n", F.col("id") % 5), "n", ["x"], 40.0))
query("gw_logistic", None, lambda s, d: regression.weighted_generalised(fx.suppliers(s, d).withColumn("n", F.col("id") % 2), "n", ["x"], 40.0, "logistic"))
_ev = "pts AS (SELECT event_id AS id, CAST(user_id * 37 % 101 AS DOUBLE) AS x, CAST(event_id * 53 % 97 AS DOUBLE) AS y, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, value AS v FROM events)"


def space_time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, t, v"""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 37 % 101).cast("double").alias("x"), (F.col("event_id") * 53 % 97).cast("double").alias("y"), day.alias("t"), F.col("value").alias("v"))


query("gtwr_level", f"WITH {_ev}, p AS (SELECT a.id, b.v, 0.5 * {_d} + 0.5 * (a.t - b.t) + 2 * sqrt(0.25 * {_d} * (a.t - b.t)) AS d FROM pts a JOIN pts b ON b.t <= a.t AND a.t - b.t <= 8 AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8) SELECT id, round(sum(v * pow(1 - d * d / 16, 2)) / sum(pow(1 - d * d / 16, 2)), 4) AS yhat FROM p WHERE d < 4 GROUP BY id", lambda s, d: regression.space_time_regression(space_time_events(s, d), "v", [], "t", 4.0, 0.5).select("id", F.round("yhat", 4).alias("yhat")))
query("gtwr_1var", None, lambda s, d: regression.space_time_regression(space_time_events(s, d), "v", ["x"], "t", 8.0, 0.5))


# polygons: slanted triangles at the suppliers' places

T = f"WITH {fx.TRIANGLES}"
_cross = "EXISTS (SELECT 1 FROM edges e JOIN edges f ON e.id = a.id AND f.id = b.id WHERE sign((e.bx - e.ax) * (f.ay - e.ay) - (e.b_y - e.ay) * (f.ax - e.ax)) * sign((e.bx - e.ax) * (f.b_y - e.ay) - (e.b_y - e.ay) * (f.bx - e.ax)) < 0 AND sign((f.bx - f.ax) * (e.ay - f.ay) - (f.b_y - f.ay) * (e.ax - f.ax)) * sign((f.bx - f.ax) * (e.b_y - f.ay) - (f.b_y - f.ay) * (e.bx - f.ax)) < 0)"
# the triangles' corners run against the clock, so a point is inside where it lies left of (or on) all three edges
_holds = "(SELECT min((e.bx - e.ax) * ({q}.ay - e.ay) - (e.b_y - e.ay) * ({q}.ax - e.ax)) FROM edges e WHERE e.id = {t}.id) >= 0"
_corner = "EXISTS (SELECT 1 FROM edges q WHERE q.id = {o}.id AND " + _holds.format(q="q", t="{t}") + ")"
_meet = f"({_cross} OR {_corner.format(o='b', t='a')} OR {_corner.format(o='a', t='b')})"
_near = "tri a JOIN tri b ON abs(a.x1 - b.x1) <= 9 AND abs(a.y1 - b.y1) <= 9"
_every = "NOT EXISTS (SELECT 1 FROM edges q WHERE q.id = b.id AND NOT " + _holds.format(q="q", t="a") + ")"
query("poly_intersects", f"{T} SELECT a.id AS i, b.id AS j FROM {_near} WHERE {_meet}", lambda s, d: overlay.polygon_join(fx.triangles(s, d), fx.triangles(s, d), 10.0))
query("poly_covers", f"{T} SELECT a.id AS i, b.id AS j FROM {_near} WHERE {_every}", lambda s, d: overlay.polygon_join(fx.triangles(s, d), fx.triangles(s, d), 10.0, overlay.covers))
query("poly_overlaps", f"{T} SELECT a.id AS i, b.id AS j FROM {_near} WHERE {_cross}", lambda s, d: overlay.polygon_join(fx.triangles(s, d), fx.triangles(s, d), 10.0, lambda a, b: overlay.overlaps(a, b) & overlay._any_cross(a, b)))
_probe = "x0 AS (SELECT 50.5 AS px, 40.25 AS p_y)"
query("poly_edge_distance", f"{T}, {_probe}, t AS (SELECT e.id, greatest(0, least(1, ((px - ax) * (bx - ax) + (p_y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t, ax, ay, bx, b_y, px, p_y FROM edges e, x0) SELECT id, {_r('min(sqrt(pow(ax + t * (bx - ax) - px, 2) + pow(ay + t * (b_y - ay) - p_y, 2)))')} AS d FROM t GROUP BY id", lambda s, d: fx.triangles(s, d).select("id", F.array_min(F.transform(overlay.edges(F.col("ring")), lambda e: overlay._to_edge(e, F.struct(F.lit(50.5).alias("x"), F.lit(40.25).alias("y"))))).alias("d")))
query("feat_irregular", f"{T} SELECT id, {_r('abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2')} AS area, {_r('sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) + sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) + sqrt(pow(x1 - x3, 2) + pow(y1 - y3, 2))')} AS length, {_r('(x1 + x2 + x3) / 3')} AS x, {_r('(y1 + y2 + y3) / 3')} AS y, x1 AS x0, least(y1, y2, y3) AS y0 FROM tri", lambda s, d: fx.triangles(s, d).select("id", feature.area(F.col("ring")).alias("area"), feature.length(F.col("ring")).alias("length"), feature.centroid(F.col("ring")).alias("c"), feature.bounds(F.col("ring")).alias("b")).select("id", "area", "length", "c.x", "c.y", "b.x0", "b.y0"))
query("feat_buffer", f"{P} SELECT id, round(16 * 25 * sin(radians(360.0 / 32)), 6) AS area, round(x, 6) AS x, round(y, 6) AS y FROM pts", lambda s, d: fx.suppliers(s, d).select("id", overlay.buffer(F.col("x"), F.col("y"), 5.0).alias("ring")).select("id", feature.area(F.col("ring")).alias("area"), feature.centroid(F.col("ring")).alias("c")).select("id", "area", "c.x", "c.y"))
query("feat_clip_box", f"{N} SELECT id, CAST(greatest(0, least(cx + 1, 3.25) - greatest(cx, 0.5)) * greatest(0, least(cy + 1, 2.75) - greatest(cy, 1.5)) AS DOUBLE) AS area FROM poly", lambda s, d: fx.nations(s, d).select("id", overlay.clipped_area(F.col("ring"), 0.5, 1.5, 3.25, 2.75).alias("area")))
query("feat_convex_hull", None, lambda s, d: overlay.convex_hull(fx.customers(s, d), "g").select("g", feature.area(F.col("ring")).alias("area"), (F.size("ring") - 1).alias("corners")))
query("feat_wkt", f"{T} SELECT id, 'POLYGON' AS kind, 4 AS n, {_r('abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2')} AS area FROM tri", lambda s, d: fx.triangles(s, d).select("id", files.to_wkt(F.col("ring")).alias("wkt")).select("id", files.geometry_type(F.col("wkt")).alias("kind"), F.size(files.from_wkt(F.col("wkt"))).alias("n"), feature.area(files.from_wkt(F.col("wkt"))).alias("area")))
query("feat_geojson", f"{T} SELECT CAST(id AS VARCHAR) AS id, 'red' AS colour, {_r('abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2')} AS area FROM tri", lambda s, d: fx.triangles(s, d).select(files.from_geojson(files.to_geojson(F.col("id"), F.col("ring"), F.create_map(F.lit("colour"), F.lit("red")))).alias("f")).select("f.id", F.col("f.props")["colour"].alias("colour"), feature.area(F.col("f.ring")).alias("area")))

# catalogue: orders as images of products

images = lambda s, d: fx.table(s, d, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("product_key"), F.col("o_orderdate").alias("time"), (F.col("o_custkey") % 360 - 180).cast("double").alias("x0"), (F.col("o_custkey") % 170 - 85).cast("double").alias("y0"), (F.col("o_custkey") % 360 - 178).cast("double").alias("x1"), (F.col("o_custkey") % 170 - 83).cast("double").alias("y1"))
products = lambda s, d: fx.table(s, d, "orders").select(F.col("o_orderpriority").alias("product_key")).distinct().withColumn("product", F.substring("product_key", 1, 1)).withColumn("sensor", F.when(F.col("product") < "3", "OLI").otherwise("ETM"))
_img = "WITH img AS (SELECT o_orderkey AS image, o_orderpriority AS product_key, o_orderdate AS time, o_custkey % 360 - 180.0 AS x0, o_custkey % 170 - 85.0 AS y0 FROM orders)"
query("catalogue_collection", f"{_img} SELECT image, product_key FROM img WHERE substring(product_key, 1, 1) = '2' AND time BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30' AND x0 <= 20 AND x0 + 2 >= -30 AND y0 <= 40 AND y0 + 2 >= 0", lambda s, d: catalogue.collection(images(s, d), products(s, d), product="2", sensor="OLI", start="1994-01-01", end="1995-06-30", box=(-30.0, 0.0, 20.0, 40.0)).select("image", "product_key"))
query("catalogue_filter", f"{_img} SELECT image FROM img WHERE product_key <> '1-URGENT' AND (x0 > 100 OR NOT y0 < 0) AND product_key IN ('2-HIGH', '5-LOW', '1-URGENT')", lambda s, d: catalogue.filtered(images(s, d), {"and": [{"notEquals": ["product_key", "1-URGENT"]}, {"or": [{"greaterThan": ["x0", 100.0]}, {"not": {"lessThan": ["y0", 0.0]}}]}, {"inList": ["product_key", ["2-HIGH", "5-LOW", "1-URGENT"]]}]}).select("image"))
#: The collection requests: two filters joined by "and", arguments by name in any order, and a style.
FILTER_GRAPH = """{"0": {"functionInvocationValue": {"functionName": "CoverageCollection.addStyles", "arguments": {"coverageCollection": {"valueReference": "1"}, "min": {"constantValue": 0}, "max": {"constantValue": 255}}}},
"1": {"functionInvocationValue": {"functionName": "CoverageCollection.filter", "arguments": {"filter": {"functionInvocationValue": {"functionName": "Filter.and", "arguments": {"filters": {"arrayValue": {"values": [{"valueReference": "2"}, {"valueReference": "3"}]}}}}}, "collection": {"functionInvocationValue": {"functionName": "Service.getCoverageCollection", "arguments": {"productID": {"constantValue": "all"}}}}}}},
"2": {"functionInvocationValue": {"functionName": "Filter.equals", "arguments": {"rightValue": {"constantValue": "5-LOW"}, "leftField": {"constantValue": "product_key"}}}},
"3": {"functionInvocationValue": {"functionName": "Filter.lessThan", "arguments": {"leftField": {"constantValue": "x0"}, "rightValue": {"constantValue": -100.0}}}}}"""
query("dag_collection_filter", f"{_img} SELECT image FROM img WHERE product_key = '5-LOW' AND x0 < -100", lambda s, d: compile_graph(FILTER_GRAPH, {"all": images(s, d)}).select("image"))
SWAPPED_GRAPH = """{"0": {"functionInvocationValue": {"functionName": "Coverage.subtract", "arguments": {"b": {"functionInvocationValue": {"functionName": "Service.getCoverage", "arguments": {"id": {"constantValue": "two"}}}}, "a": {"functionInvocationValue": {"functionName": "Service.getCoverage", "arguments": {"id": {"constantValue": "one"}}}}}}}}"""
query("dag_named_arguments", f"{AB} SELECT a.band, a.px, a.py, {_r('a.value - b.value')} AS value FROM a JOIN b USING (band, px, py)", lambda s, d: compile_graph(SWAPPED_GRAPH, {"one": year(s, d, 1995), "two": year(s, d, 1996)}))

# colours, masks, distances, gaps, resolutions

_rgb = f"{ALL}, c AS (SELECT px, py, Red / 255 AS r, NIR / 255 AS g, Green / 255 AS b FROM wide WHERE instant = 1995), h AS (SELECT px, py, r, g, b, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS df FROM c), v AS (SELECT px, py, CASE WHEN df = 0 THEN 0.0 WHEN mx = r THEN CASE WHEN g >= b THEN 60 * (g - b) / df ELSE 60 * (g - b) / df + 360 END WHEN mx = g THEN 60 * (b - r) / df + 120 ELSE 60 * (r - g) / df + 240 END AS hue, CASE WHEN mx = 0 THEN 0.0 ELSE df / mx END AS saturation, mx AS value FROM h)"
hsv = lambda s, d: image.rgb_to_hsv(year(s, d, 1995), "Red", "NIR", "Green")
query("cov_rgb_to_hsv", f"{_rgb} SELECT px, py, 'hue' AS band, {_r('hue')} AS value FROM v UNION ALL SELECT px, py, 'saturation', {_r('saturation')} FROM v UNION ALL SELECT px, py, 'value', {_r('value')} FROM v", hsv)
query("cov_hsv_to_rgb", f"{AB} SELECT px, py, CASE band WHEN 'Red' THEN 'red' WHEN 'NIR' THEN 'green' ELSE 'blue' END AS band, {_r('value')} AS value FROM a WHERE band IN ('Red', 'NIR', 'Green')", lambda s, d: image.hsv_to_rgb(hsv(s, d)))
query("cov_entropy", f"{ALL}, k AS (SELECT band, floor(value / 2) AS bin, count(*) AS n FROM a GROUP BY ALL) SELECT band, {_r('log2(sum(n)) - sum(n * log2(n)) / sum(n)')} AS entropy FROM k GROUP BY band", lambda s, d: image.entropy(every_year(s, d), 2.0))
query("cov_focal_mode", f"{ALL}, f AS (SELECT band, px, py, CAST(floor(value) AS BIGINT) AS value FROM a), k AS (SELECT c.band, c.px, c.py, n.value, count(*) AS n FROM f c JOIN f n ON {_win} GROUP BY ALL) SELECT band, px, py, value FROM k QUALIFY row_number() OVER (PARTITION BY band, px, py ORDER BY n DESC, value) = 1", lambda s, d: image.focal_mode(whole(every_year(s, d))))
query("cov_gradient", f"{ALL}, g AS (SELECT c.band, c.px, c.py, sum(n.value * (n.px - c.px) * (2 - abs(n.py - c.py))) AS gx, sum(n.value * (n.py - c.py) * (2 - abs(n.px - c.px))) AS gy FROM a c JOIN a n ON {_win} GROUP BY ALL) SELECT band, px, py, {_r('sqrt(gx * gx + gy * gy)')} AS value FROM g", lambda s, d: image.gradient(every_year(s, d)))
query("cov_near_black", f"{ALL} SELECT band, px, py, {_r('CASE WHEN abs(value) <= 4 THEN 0 ELSE value END')} AS value FROM a", lambda s, d: image.near_black(every_year(s, d), 4.0))
_ring = lambda: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 1.0), (14.0, 3.0), (4.0, 13.0), (1.0, 1.0))])
query("cov_clip_polygon", f"{ALL} SELECT band, px, py, {_r('value')} AS value FROM a WHERE 13 * (py - 0.5) - 2 * (px - 0.5) > 0 AND -10 * (py - 2.5) - 10 * (px - 13.5) > 0 AND -3 * (py - 12.5) + 12 * (px - 3.5) > 0", lambda s, d: image.clip(every_year(s, d), _ring()))
_tgt = "t AS (SELECT DISTINCT px, py FROM a WHERE band = 'Red' AND value > 27), u AS (SELECT DISTINCT px, py FROM a), p AS (SELECT u.px, u.py, min(sqrt((u.px - t.px) * (u.px - t.px) + (u.py - t.py) * (u.py - t.py))) AS d FROM u, t GROUP BY ALL)"
targets = lambda s, d: year(s, d, 1995).where("band = 'Red' and value > 27")
query("cov_proximity", f"{AB}, {_tgt} SELECT px, py, {_r('d')} AS value FROM p", lambda s, d: image.proximity(year(s, d, 1995), targets(s, d)))
query("map_buffer", f"{AB}, {_tgt} SELECT px, py, CASE WHEN d = 0 THEN 1 WHEN d <= 1 THEN 2 WHEN d <= 2.5 THEN 3 END AS value FROM p WHERE d <= 2.5", lambda s, d: image.buffered(year(s, d, 1995), targets(s, d), [1.0, 2.5]))
query("cov_fill_gaps", f"{AB}, e AS (SELECT * FROM a WHERE (px + 2 * py) % 5 <> 0), gaps AS (SELECT DISTINCT e.band, a.px, a.py FROM a, (SELECT DISTINCT band FROM e) e ANTI JOIN e f ON f.band = e.band AND f.px = a.px AND f.py = a.py), near AS (SELECT g.band, g.px, g.py, e.value, sqrt((g.px - e.px) * (g.px - e.px) + (g.py - e.py) * (g.py - e.py)) AS d FROM gaps g JOIN e ON e.band = g.band AND abs(g.px - e.px) <= 2 AND abs(g.py - e.py) <= 2) SELECT band, px, py, {_r('value')} AS value FROM e UNION ALL SELECT band, px, py, {_r('sum(value / (d * d)) / sum(1 / (d * d))')} FROM near WHERE d <= 2 GROUP BY ALL", lambda s, d: image.filled(year(s, d, 1995).where("(px + 2 * py) % 5 <> 0"), year(s, d, 1995), 2.0))
query("cov_add_aligned", f"{ALL}, c AS (SELECT band, px // 2 AS px, py // 2 AS py, avg(value) AS value FROM a GROUP BY ALL) SELECT b.band, b.px, b.py, {_r('c.value + b.value')} AS value FROM b JOIN c ON c.band = b.band AND c.px = b.px // 2 AND c.py = b.py // 2", lambda s, d: coverage.binary(*image.aligned(image.to_resolution(every_year(s, d), 1, 2), 2, every_year(s, d, 1), 1), "add"))
query("cov_metadata", f"{ALL} SELECT band, min(px) AS px0, min(py) AS py0, max(px) AS px1, max(py) AS py1, count(value) AS n, {_r('min(value)')} AS least, {_r('max(value)')} AS most FROM a GROUP BY band", lambda s, d: image.metadata(every_year(s, d)))

# detectors, samples, components, model output

_ss = "(SELECT sum(n * s2) AS ss FROM (SELECT count(*) AS n, var_pop(l_extendedprice) AS s2 FROM lineitem GROUP BY {k}))"
query("geodetector_ecological", f"SELECT 'l_linenumber' AS a, 'l_returnflag' AS b, round({_ss.format(k='l_linenumber')} / {_ss.format(k='l_returnflag')}, 6) AS f", lambda s, d: statistics.ecological_detector(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linenumber"]))
query("sample_random", f"{C} SELECT id FROM pts ORDER BY id * 7919 % 10007, id LIMIT 40", lambda s, d: statistics.random_sample(fx.customers(s, d), 40, "id * 7919 % 10007"))
query("sample_sandwich", f"{C}, z AS (SELECT g AS zone, avg(v) AS m, var_samp(v) / count(v) AS s2 FROM pts GROUP BY g), o AS (SELECT CAST(floor(x / 2500) AS BIGINT) AS unit, g AS zone, CAST(count(*) AS DOUBLE) AS share FROM pts GROUP BY ALL) SELECT unit, {_r('sum(share * m) / sum(share)')} AS mean, {_r('sum(share * share * s2) / pow(sum(share), 2)')} AS variance FROM o JOIN z USING (zone) GROUP BY unit", lambda s, d: statistics.sandwich(fx.customers(s, d).select(F.col("g").alias("zone"), "v"), fx.customers(s, d).groupBy(F.floor(F.col("x") / 2500).alias("unit"), F.col("g").alias("zone")).agg(F.count("*").cast("double").alias("share"))))
query("pca", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 1 AS component, round(1 + abs(r), 6) AS value, round((1 + abs(r)) / 2, 6) AS share FROM r UNION ALL SELECT 2, round(1 - abs(r), 6), round((1 - abs(r)) / 2, 6) FROM r", lambda s, d: statistics.principal_components(fx.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("component", "value", "share"))
_lm = "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_avgx(l_extendedprice, l_quantity) AS mx, count(*) AS n FROM lineitem), e AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM m)"
query("ols_diagnostics", f"{_lm} SELECT 'intercept' AS term, round(a, 3) AS coefficient, round(sqrt(s2 * (1 / n + mx * mx / sxx)), 3) AS error, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted FROM e UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(s2 / sxx), 3), round(r2, 6), round(1 - (1 - r2) * (n - 1) / (n - 2), 6) FROM e", lambda s, d: regression.linear_diagnostics(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("coefficient", 3).alias("coefficient"), F.round("error", 3).alias("error"), "r2", "adjusted"))
query("ols_predict", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT p_partkey AS id, round(a + b * p_size, 2) AS yhat FROM part, m", lambda s, d: regression.predicted(fx.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("l_quantity")), ["l_quantity"], regression.linear(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]), "id").select("id", F.round("yhat", 2).alias("yhat")))
query("logistic_deviance", None, lambda s, d: _logistic(s, d))
_gwp = f"{_grid}, w AS (SELECT near.id, c.x AS x0, pts.v AS y, pts.x, pow(1 - pow(d / 40, 2), 2) AS w FROM near JOIN pts ON pts.id = near.j JOIN cells c ON c.id = near.id WHERE d < 40), s AS (SELECT id, any_value(x0) AS x0, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY id), f AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b FROM s)"
query("gwr_predict", f"{_gwp} SELECT id, round((sy - b * sx) / s + b * x0, 3) AS yhat FROM f", lambda s, d: regression.weighted_prediction(fx.suppliers(s, d), cells(s, d), "v", ["x"], 40.0).select("id", F.round("yhat", 3).alias("yhat")))
_cv = " UNION ALL ".join(f"SELECT {w}.0::DOUBLE AS width, round(sum(pow(y0 - ((sy - b * sx) / s + b * x0), 2)), 0) AS cv FROM (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b FROM (SELECT a.id, any_value(a.v) AS y0, any_value(a.x) AS x0, sum(w) AS s, sum(w * bx) AS sx, sum(w * bv) AS sy, sum(w * bx * bx) AS sxx, sum(w * bx * bv) AS sxy FROM (SELECT a.*, b.x AS bx, b.v AS bv, pow(1 - pow({_d} / {w}, 2), 2) AS w FROM pts a JOIN pts b ON a.id <> b.id AND {_d} < {w}) a GROUP BY a.id))" for w in (70, 90, 120))
query("gwr_bandwidth_cv", f"{P} {_cv}", lambda s, d: regression.bandwidth_scores(fx.suppliers(s, d), "v", ["x"], [70.0, 90.0, 120.0]).select("width", F.round("cv", 0).alias("cv")))


def _logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem").withColumn("late", (F.col("l_returnflag") == "R").cast("int"))
    fit = regression.generalised(rows, "late", ["l_quantity", "l_discount"], "logistic")
    return regression.deviance(regression.scored(rows, ["l_quantity", "l_discount"], fit, "logistic"), "late", "logistic", 3)


query("moran_local_test", f"{_z}, b AS (SELECT avg(pow(z, 4)) / pow(any_value(s2), 2) AS b2 FROM z), m AS (SELECT i AS id, any_value(zi) / any_value(s2) * sum(w * zj) AS i, sum(w) AS w, sum(w * w) AS w2, any_value(n) AS n FROM wz GROUP BY wz.i), v AS (SELECT m.*, -w / (n - 1) AS e, w2 * (n - b2) / (n - 1) + (w * w - w2) * (2 * b2 - n) / ((n - 1) * (n - 2)) - pow(w / (n - 1), 2) AS var FROM m, b) SELECT id, {_r('i')} AS i, {_r('e')} AS expected, {_r('var')} AS variance, {_r('(i - e) / sqrt(var)')} AS z FROM v", lambda s, d: statistics.moran_local_test(values(s, d), weights(s, d)))

query("poly_shared_area", f"{N} SELECT a.id AS i, b.id AS j, {_r('CAST(greatest(0, least(a.cx + 1, b.cx + 1.3) - greatest(a.cx, b.cx + 0.3)) * greatest(0, least(a.cy + 1, b.cy + 1.4) - greatest(a.cy, b.cy + 0.4)) AS DOUBLE)')} AS area FROM poly a JOIN poly b ON a.cx >= b.cx AND a.cx <= b.cx + 1 AND a.cy >= b.cy AND a.cy <= b.cy + 1", lambda s, d: shared_areas(s, d))
query("poly_dissolve", f"{N}, e AS (SELECT p.id, n_regionkey AS region, unnest([[cx, cy, cx + 1, cy], [cx + 1, cy, cx + 1, cy + 1], [cx, cy + 1, cx + 1, cy + 1], [cx, cy, cx, cy + 1]]) AS e FROM poly p JOIN nation ON n_nationkey = p.id), o AS (SELECT region, e FROM e GROUP BY ALL HAVING count(*) = 1) SELECT region, count(*) AS n FROM o GROUP BY region", lambda s, d: overlay.dissolved(fx.nations(s, d).join(fx.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")), "id"), "region").groupBy("region").agg(F.count("*").alias("n")))
query("poly_points_along", f"{T} SELECT id, {_r('ax + (bx - ax) * k / 4')} AS x, {_r('ay + (b_y - ay) * k / 4')} AS y FROM edges, range(4) r(k)", lambda s, d: fx.triangles(s, d).select("id", F.explode(overlay.along(F.col("ring"), 4)).alias("p")).select("id", "p.x", "p.y"))
query("poly_rasterise", f"{T}, t2 AS (SELECT id, x1 + 0.137 AS x1, y1 + 0.211 AS y1, x2 + 0.137 AS x2, y2 + 0.211 AS y2, x3 + 0.137 AS x3, y3 + 0.211 AS y3 FROM tri), c AS (SELECT id, px, py FROM t2, range(110) a(px), range(110) b(py) WHERE px >= x1 - 1 AND px <= x1 + 10 AND py >= y1 - 1 AND py <= y1 + 10 AND (x2 - x1) * (py + 0.5 - y1) - (y2 - y1) * (px + 0.5 - x1) > 0 AND (x3 - x2) * (py + 0.5 - y2) - (y3 - y2) * (px + 0.5 - x2) > 0 AND (x1 - x3) * (py + 0.5 - y3) - (y1 - y3) * (px + 0.5 - x3) > 0) SELECT px, py, max(id) * 2.0::DOUBLE AS value FROM c GROUP BY ALL", lambda s, d: overlay.rasterised(fx.triangles(s, d).select("id", F.transform("ring", lambda p: F.struct((p.x + 0.137).alias("x"), (p.y + 0.211).alias("y"))).alias("ring"), (F.col("id") * 2.0).alias("v")), 1.0))
query("cov_texture", f"{ALL}, p AS (SELECT a.band, floor(a.value) AS x, floor(n.value) AS y, count(*) AS n FROM a JOIN a n ON a.band = n.band AND n.px = a.px + 1 AND n.py = a.py GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY band) AS p FROM p) SELECT band, {_r('sum(p * (x - y) * (x - y))')} AS contrast, {_r('sum(p * p)')} AS energy, {_r('sum(p / (1 + (x - y) * (x - y)))')} AS homogeneity, {_r('-sum(p * log2(p))')} AS entropy FROM q GROUP BY band", lambda s, d: image.texture(every_year(s, d)))
query("cov_latitude", f"{ALL} SELECT band, px, py, {_r('60 - (py + 0.5) * 0.25::DOUBLE')} AS value FROM a", lambda s, d: image.latitude(every_year(s, d), 60.0, 0.25))
query("cube_facts", f"{W} SELECT 'Green,NIR,Red,SWIR1' AS bands, count(DISTINCT instant) AS instants, min(instant) AS first, max(instant) AS last, min(px) AS px0, min(py) AS py0, max(px) AS px1, max(py) AS py1, max(px) - min(px) + 1 AS columns, max(py) - min(py) + 1 AS rows FROM cube", lambda s, d: image.cube_facts(fx.cube(s, d)))
query("mosaic_latest", f"{W} SELECT band, px, py, {_r('arg_max(value, instant)')} AS value FROM cube GROUP BY ALL", lambda s, d: image.mosaic_latest(fx.cube(s, d)))
query("grid_metrics", f"{_grid} SELECT id, count(*) AS n, {_r('avg(v)')} AS mean, {_r('min(v)')} AS least, {_r('max(v)')} AS most, {_r('max(v) - min(v)')} AS spread, {_r('avg(d)')} AS distance FROM near WHERE d <= 15 GROUP BY id", lambda s, d: statistics.grid_metrics(fx.suppliers(s, d), cells(s, d), 15.0))
_gwd = f"{P}, p AS (SELECT a.id, a.v AS y0, a.x AS x0, b.v AS y, b.x AS x, pow(1 - pow({_d} / 90, 2), 2) AS w FROM pts a, pts b WHERE {_d} < 90), s AS (SELECT id, any_value(y0) AS y0, any_value(x0) AS x0, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM p GROUP BY id), f AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b, (sxx - 2 * x0 * sx + x0 * x0 * s) / (s * sxx - sx * sx) AS hat FROM s), g AS (SELECT count(*) AS n, sum(pow(y0 - ((sy - b * sx) / s + b * x0), 2)) AS rss, sum(hat) AS tr, var_pop(y0) * count(*) AS tss FROM f)"
query("gwr_diagnostics", f"{_gwd} SELECT round(rss, 0) AS rss, round(tr, 6) AS trace, round(n * ln(rss / n) + n * ln(2 * pi()) + n * (n + tr) / (n - 2 - tr), 4) AS aicc, round(1 - rss / tss, 6) AS r2 FROM g", lambda s, d: regression.weighted_diagnostics(fx.suppliers(s, d), "v", ["x"], 90.0).select(F.round("rss", 0).alias("rss"), "trace", F.round("aicc", 4).alias("aicc"), "r2"))
query("gwr_forward", None, lambda s, d: regression.forward_selection(fx.suppliers(s, d).withColumn("east", F.col("x")).withColumn("north", F.col("y")), "v", ["east", "north"], 90.0))
query("spatial_durbin_model", None, lambda s, d: autoregression.durbin_model(fx.suppliers(s, d), weights(s, d), "v", ["x"]))


def shared_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation's square shares with the squares moved by (0.3, 0.4)."""
    own = fx.nations(spark, sf_dir)
    moved = own.select("id", F.transform("ring", lambda p: F.struct((p.x + 0.3).alias("x"), (p.y + 0.4).alias("y"))).alias("ring"))
    pairs = overlay.polygon_join(own, moved, 2.0)
    laid = pairs.join(own.select(F.col("id").alias("i"), F.col("ring").alias("a")), "i").join(moved.select(F.col("id").alias("j"), F.col("ring").alias("b")), "j")
    return laid.select("i", "j", overlay.shared_area(F.col("a"), F.col("b")).alias("area"))


# requests by their own argument names, in whatever order these stand


def call(name: str, **arguments) -> dict:
    return {"functionInvocationValue": {"functionName": name, "arguments": {k: v if isinstance(v, dict) else {"constantValue": v} for k, v in arguments.items()}}}


ref = lambda node: {"valueReference": node}
#: The vegetation index mapped over a collection, within the map's range.
NDVI_REQUEST = {
    "layerName": "ndvi",
    "isBatch": "0",
    "map": {"level": 8, "spatialRange": [2.5, 3.5, 9.2, 12.0]},
    "3": call("Coverage.toDouble", coverage={"argumentReference": "_MAPPING_VAR_0_0"}),
    "2": call("Coverage.selectBands", bands=["NIR"], coverage=ref("3")),
    "4": call("Coverage.selectBands", bands="[Red]", coverage=ref("3")),
    "1": call("Coverage.divide", coverage2=call("Coverage.add", coverage1=ref("2"), coverage2=ref("4")), coverage1=call("Coverage.subtract", coverage2=ref("4"), coverage1=ref("2"))),
    "0": call("CoverageCollection.addStyles", coverageCollection=call("Collection.map", baseAlgorithm={"functionDefinitionValue": {"argumentNames": ["_MAPPING_VAR_0_0"], "body": "1"}}, collection=call("Service.getCoverageCollection", baseUrl="-", bbox=[0.0, 0.0, 16.0, 16.0], datetime=["1992-01-01 00:00:00", "1998-12-31 00:00:00"], productID="cube"))),
}
query("dag_request_ndvi", f"{_wide} SELECT 'NIR' AS band, instant, px, py, {_r('(NIR - Red) / nullif(NIR + Red, 0)')} AS value FROM w WHERE px < 9.2 AND px + 1 > 2.5 AND py < 12 AND py + 1 > 3.5", lambda s, d: compile_graph(json.dumps(NDVI_REQUEST), {"cube": fx.cube(s, d)}, place=Place(0.0, 0.0, 1.0)).select("band", "instant", "px", "py", "value"))
WATER_REQUEST = {"map": {"level": 7, "spatialRange": [0, 0, 16, 16]}, "0": call("Coverage.addStyles", max=255, min=0, input=call("Coverage.binarization", threshold=0, coverage=call("Coverage.normalizedDifference", bandNames=["Green", "SWIR1"], coverage=call("Service.getCoverage", productID="p", baseUrl="-", coverageID="one"))))}
query("dag_request_water", f"{AB}, w AS (PIVOT (SELECT * FROM a) ON band IN ('Green', 'SWIR1') USING max(value) GROUP BY px, py) SELECT px, py, CASE WHEN (Green - SWIR1) / nullif(Green + SWIR1, 0) > 0 THEN 255 ELSE 0 END AS value FROM w WHERE (Green - SWIR1) / nullif(Green + SWIR1, 0) IS NOT NULL", lambda s, d: compile_graph(json.dumps(WATER_REQUEST), {"one": year(s, d, 1995)}))
query("dag_request_swapped", f"{AB} SELECT a.band, a.px, a.py, {_r('a.value - b.value')} AS value FROM a JOIN b USING (band, px, py)", lambda s, d: compile_graph(json.dumps({"0": call("Coverage.subtract", coverage2=call("Service.getCoverage", coverageID="two"), coverage1=call("Service.getCoverage", coverageID="one"))}), {"one": year(s, d, 1995), "two": year(s, d, 1996)}))
query("dag_request_sum", f"{W} SELECT band, px, py, {_r('sum(value)')} AS value FROM cube GROUP BY ALL", lambda s, d: compile_graph(json.dumps({"0": call("Coverage.addStyles", coverage=call("CoverageCollection.sum", coverageCollection=call("Service.getCoverageCollection", productID="cube")), min=0, max=99)}), {"cube": fx.cube(s, d)}))
KERNEL_REQUEST = {"0": call("Coverage.convolve", kernel=call("Kernel.add", kernel2=call("Kernel.square", radius=2, normalize="false", value=0.25), kernel1=call("Kernel.fixed", weights="[[0,1,0],[1,2,1],[0,1,0]]")), coverage=call("Service.getCoverage", coverageID="one"))}
query("dag_request_kernel", f"{ALL} SELECT c.band, c.px, c.py, {_r('sum(n.value * (0.25 + CASE abs(c.px - n.px) + abs(c.py - n.py) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END))')} AS value FROM a c JOIN a n ON c.band = n.band AND abs(c.px - n.px) <= 2 AND abs(c.py - n.py) <= 2 GROUP BY ALL", lambda s, d: compile_graph(json.dumps(KERNEL_REQUEST), {"one": every_year(s, d)}))

# a larger raster, of many tiles

R = f"WITH {fx.RELIEF}"
_near = "abs(c.px - n.px) <= {0} AND abs(c.py - n.py) <= {0}"
relief_query = lambda name, radius, value, f: query(f"relief_{name}", f"{R} SELECT c.band, c.px, c.py, {_r(value)} AS value FROM relief c JOIN relief n ON {_near.format(radius)} GROUP BY ALL", lambda s, d: f(fx.relief(s, d)))
relief_query("focal_mean", 2, "avg(n.value)", lambda r: coverage.focal(r, "mean", 2))
relief_query("focal_median", 1, "median(n.value)", lambda r: coverage.focal(r, "median"))
relief_query("laplacian", 1, "sum(n.value * CASE WHEN c.px = n.px AND c.py = n.py THEN -8 ELSE 1 END)", lambda r: coverage.convolve(r, coverage.KERNELS["laplacian8"]))

# polygons with holes: boundaries cut and put together, and rasters under them

E = f"WITH {fx.ELLS}"
_measured = "sized AS (SELECT g, count(*) AS n FROM cells GROUP BY g), beside AS (SELECT a.g, count(*) AS n FROM cells a JOIN cells b ON a.g = b.g AND ((b.cx = a.cx + 1 AND b.cy = a.cy) OR (b.cx = a.cx AND b.cy = a.cy + 1)) GROUP BY a.g)"
_measures = "CAST(coalesce(s.n, 0) AS DOUBLE) AS area, CAST(4 * coalesce(s.n, 0) - 2 * coalesce(b.n, 0) AS DOUBLE) AS length"
measured = lambda df, key: df.select(F.col(key).alias("g"), boundary.area_of(F.col("rings")).alias("area"), boundary.length_of(F.col("rings")).alias("length"))
ring_pairs = lambda s, d: fx.ells(s, d).select("id", F.col("rings").alias("a")).join(fx.frames(s, d).select("id", F.col("rings").alias("b")), "id")
for _op, _set in (("union", "SELECT * FROM ells UNION SELECT * FROM frames"), ("intersection", "SELECT * FROM ells INTERSECT SELECT * FROM frames"), ("difference", "SELECT * FROM ells EXCEPT SELECT * FROM frames"), ("symmetric_difference", "(SELECT * FROM ells UNION SELECT * FROM frames) EXCEPT (SELECT * FROM ells INTERSECT SELECT * FROM frames)")):
    query(f"poly_{_op}", f"{E}, cells AS (SELECT id AS g, cx, cy FROM ({_set})), {_measured} SELECT p.id AS g, {_measures} FROM places p LEFT JOIN sized s ON s.g = p.id LEFT JOIN beside b ON b.g = p.id", lambda s, d, op=_op: measured(boundary.paired(ring_pairs(s, d), op), "id"))
query("poly_union_groups", f"{E}, cells AS (SELECT DISTINCT id % 7 AS g, cx, cy FROM (SELECT * FROM ells UNION ALL SELECT * FROM frames)), {_measured} SELECT s.g, {_measures} FROM sized s LEFT JOIN beside b USING (g)", lambda s, d: measured(boundary.dissolved(fx.ells(s, d).withColumn("id", F.col("id") * 2).unionByName(fx.frames(s, d).withColumn("id", F.col("id") * 2 + 1)).withColumn("g", F.floor(F.col("id") / 2) % 7), "g"), "g"))
_under = f"{E}, {fx.RELIEF}"
frames = lambda s, d: fx.frames(s, d)
query("zonal_statistics", f"{_under} SELECT band, id, count(*) AS n, {_r('sum(value)')} AS total, {_r('min(value)')} AS least, {_r('max(value)')} AS most, {_r('avg(value)')} AS mean FROM frames JOIN relief ON cx = px AND cy = py GROUP BY ALL", lambda s, d: zonal.zonal(fx.relief(s, d), frames(s, d)))
query("zonal_mask", f"{_under} SELECT band, id, px, py, {_r('value')} AS value FROM ells JOIN relief ON cx = px AND cy = py", lambda s, d: zonal.masked(fx.relief(s, d), fx.ells(s, d)))
query("zonal_histogram", f"{_under} SELECT band, id, CAST(floor(value / 50) AS BIGINT) AS bin, count(*) AS n FROM frames JOIN relief ON cx = px AND cy = py GROUP BY ALL", lambda s, d: zonal.histogram(fx.relief(s, d), frames(s, d), 50.0))
query("zonal_facts", f"{_under}, zone AS (SELECT id, sum(value) AS total FROM frames JOIN relief ON cx = px AND cy = py GROUP BY id), fact AS (SELECT ps AS id, count(*) AS parts FROM (SELECT l_suppkey AS ps FROM lineitem) GROUP BY ps) SELECT id, parts, {_r('total / parts')} AS rate FROM zone JOIN fact USING (id)", lambda s, d: zonal.with_facts(zonal.zonal(fx.relief(s, d), frames(s, d)), fx.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("parts")), "parts").select("id", "parts", "rate"))
query("zonal_rasterise", f"{E} SELECT cx AS px, cy AS py, max(id) AS value FROM frames GROUP BY ALL", lambda s, d: zonal.rasterised(frames(s, d).withColumn("v", F.col("id")), 1.0))

# inference by permutation and simulation, with the same whole-number hashes in SQL

_mixed = lambda x, k: permutation.MIXED_SQL.format(x=x, k=k)
_perm = f"{_knn}, numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, v - avg(v) OVER () AS z, var_pop(v) OVER () AS s2, count(*) OVER () AS n FROM pts), p AS (SELECT t, a.id, 0.25 AS w, a.r AS ri, b.r AS rj, a.z AS zi, a.n, a.s2, row_number() OVER (PARTITION BY t, i ORDER BY j) - 1 AS m FROM knn JOIN numbered a ON a.id = i JOIN numbered b ON b.id = j, range(0, 20) x(t))"
_moved = lambda row, t, n: permutation.MOVED_SQL.format(row=row, n=n, keys=permutation.KEYS_SQL.format(t=t))
_pseudo = "count(*) FILTER (t > 0 AND value >= own) AS above, count(*) FILTER (t > 0) AS k, max(own) AS observed, avg(value) FILTER (t > 0) AS mean, stddev_samp(value) FILTER (t > 0) AS sd"
query("moran_permutation", f"{_perm}, e AS (SELECT t, w, s2, CASE WHEN t = 0 THEN ri ELSE {_moved('ri', 't', 'n')} END AS a, CASE WHEN t = 0 THEN rj ELSE {_moved('rj', 't', 'n')} END AS b FROM p), st AS (SELECT t, sum(w * za.z * zb.z) / sum(w) / any_value(e.s2) AS value FROM e JOIN numbered za ON za.r = a JOIN numbered zb ON zb.r = b GROUP BY t), o AS (SELECT *, max(value) FILTER (t = 0) OVER () AS own FROM st), f AS (SELECT {_pseudo} FROM o) SELECT {_r('observed')} AS observed, {_r('mean')} AS mean, {_r('sd')} AS sd, {_r('(least(above, k - above) + 1) / (k + 1)')} AS p FROM f", lambda s, d: permutation.moran_permuted(fx.suppliers(s, d), weights(s, d), 19))
query("moran_local_permutation", f"{_perm}, e AS (SELECT t, id, w, s2, zi, CASE WHEN t = 0 THEN rj ELSE o + CAST(o >= ri AS INT) END AS r FROM (SELECT *, {_moved('m', '(t * n + ri)', '(n - 1)')} AS o FROM p)), st AS (SELECT e.id, t, max(zi) * sum(w * z) / any_value(e.s2) AS value FROM e JOIN numbered USING (r) GROUP BY ALL), o AS (SELECT *, max(value) FILTER (t = 0) OVER (PARTITION BY id) AS own FROM st), f AS (SELECT id, {_pseudo} FROM o GROUP BY id) SELECT id, {_r('observed')} AS observed, {_r('mean')} AS mean, {_r('sd')} AS sd, {_r('(least(above, k - above) + 1) / (k + 1)')} AS p FROM f", lambda s, d: permutation.moran_local_permuted(fx.suppliers(s, d), weights(s, d), 19))
_draw = lambda k: f"{_mixed(_mixed('i', f't * 2 + {k}'), str(k + 11))} / 2147483647.0::DOUBLE"
query("ripley_envelope", f"{P}, b AS (SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM pts), every AS (SELECT 0 AS t, id AS i, x - x0 AS x, y - y0 AS y FROM pts, b UNION ALL SELECT t, i, {_draw(0)} * w, {_draw(1)} * h FROM b, range(n) r(i), range(1, 10) q(t)), pairs AS (SELECT a.t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM every a JOIN every b ON a.t = b.t AND a.i <> b.i), st AS (SELECT k, t, greatest(w, h) / 4 / 10 * k AS r, sqrt(w * h * (SELECT count(*) FROM pairs p WHERE p.t = q.t AND p.d < greatest(w, h) / 4 / 10 * k) / (pi() * n * (n - 1))) AS l FROM b, range(1, 11) x(k), range(10) q(t)) SELECT {_r('r')} AS d, {_r('max(l) FILTER (t = 0)')} AS l, {_r('min(l) FILTER (t > 0)')} AS low, {_r('max(l) FILTER (t > 0)')} AS high FROM st GROUP BY k, r", lambda s, d: permutation.ripley_envelope(fx.suppliers(s, d), 10, 9))
query("geodetector_test", None, lambda s, d: statistics.factor_test(fx.table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linenumber"]))
query("multiscale_regression", None, lambda s, d: multiscale.multiscale_regression(fx.suppliers(s, d).withColumns({"a": F.col("x"), "b": (F.col("id") * 29 % 31).cast("double")}), "v", ["a", "b"], [20.0, 40.0, 90.0])[0])

# surfaces of splines


def _spline_sql(levels: int, first: int) -> str:
    at = "least(greatest(({c} - {c}0) / ({c}1 - {c}0) * {n}, 0), {n})"
    parts = ["pow(1 - {t}, 3) / 6", "(3 * pow({t}, 3) - 6 * pow({t}, 2) + 4) / 6", "(-3 * pow({t}, 3) + 3 * pow({t}, 2) + 3 * {t} + 1) / 6", "pow({t}, 3) / 6"]
    around = lambda rows, n: f"SELECT r.*, i + p AS k, j + q AS l, a[p + 1] * b[q + 1] AS w, list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x)) AS squares FROM (SELECT s.*, [{', '.join(x.format(t='(u - i)') for x in parts)}] AS a, [{', '.join(x.format(t='(v2 - j)') for x in parts)}] AS b FROM (SELECT *, least(floor(u), {n} - 1) AS i, least(floor(v2), {n} - 1) AS j FROM (SELECT t.*, {at.format(c='x', n=n)} AS u, {at.format(c='y', n=n)} AS v2 FROM {rows} t, box)) s) r, range(4) f(p), range(4) g(q)"
    out = [f"{P}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), cells AS (SELECT c AS id, x0 + (c % 20 + 0.5) * ((x1 - x0) / 20) AS x, y0 + (c // 20 + 0.5) * ((y1 - y0) / 20) AS y FROM box, range(400) r(c)), left0 AS (SELECT id, x, y, CAST(v AS DOUBLE) AS v FROM pts)"]
    for k in range(levels):
        n = first << k
        out.append(f"lattice{k} AS (SELECT k, l, sum(pow(w, 3) * v / squares) / nullif(sum(w * w), 0) AS phi FROM ({around(f'left{k}', n)}) GROUP BY ALL), at{k} AS (SELECT id, sum(w * coalesce(phi, 0)) AS s FROM ({around(f'left{k}', n)}) JOIN lattice{k} USING (k, l) GROUP BY id), left{k + 1} AS (SELECT id, x, y, v - s AS v FROM left{k} JOIN at{k} USING (id)), cell{k} AS (SELECT id, sum(w * coalesce(phi, 0)) AS s FROM ({around('cells', n)}) JOIN lattice{k} USING (k, l) GROUP BY id)")
    every = " UNION ALL ".join(f"SELECT * FROM cell{k}" for k in range(levels))
    return ", ".join(out) + f" SELECT id, {_r('sum(s)')} AS v FROM ({every}) GROUP BY id"


query("spline_surface", _spline_sql(3, 2), lambda s, d: splines.spline_surface(fx.suppliers(s, d), cells(s, d), 3, 2))

# the triangle around each cell's middle; places are moved a little, so that no four lie on a circle

jittered = lambda s, d: fx.suppliers(s, d).withColumns({"x": F.col("x") + F.col("id") * F.col("id") % 89 / 1000.0, "y": F.col("y") + F.col("id") * F.col("id") * F.col("id") % 97 / 1000.0})
_tin = f"WITH pts AS (SELECT s_suppkey AS id, s_suppkey * 37 % 101 + s_suppkey * s_suppkey % 89 / 1000.0::DOUBLE AS x, s_suppkey * 53 % 97 + s_suppkey * s_suppkey * s_suppkey % 97 / 1000.0::DOUBLE AS y, s_acctbal AS v FROM supplier), box AS (SELECT min(s_suppkey * 37 % 101) AS x0, max(s_suppkey * 37 % 101) AS x1, min(s_suppkey * 53 % 97) AS y0, max(s_suppkey * 53 % 97) AS y1 FROM supplier), cells AS (SELECT c AS id, x0 + (c % 20 + 0.5) * ((x1 - x0) / 20) AS qx, y0 + (c // 20 + 0.5) * ((y1 - y0) / 20) AS qy FROM box, range(400) r(c)), tri AS (SELECT a.id AS i, b.id AS j, c.id AS k, a.x AS ax, a.y AS ay, a.v AS av, b.x - a.x AS bx, b.y - a.y AS b_y, b.v AS bv, c.x - a.x AS cx, c.y - a.y AS cy, c.v AS cv, (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS w FROM pts a JOIN pts b ON a.id < b.id JOIN pts c ON b.id < c.id), circ AS (SELECT *, (cy * (bx * bx + b_y * b_y) - b_y * (cx * cx + cy * cy)) / (2 * w) AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + b_y * b_y)) / (2 * w) AS uy FROM tri WHERE abs(w) > 1e-9), del AS (SELECT * FROM circ t WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.id <> t.i AND p.id <> t.j AND p.id <> t.k AND pow(p.x - t.ax - t.ux, 2) + pow(p.y - t.ay - t.uy, 2) < (t.ux * t.ux + t.uy * t.uy) * (1 - 1e-12))), hit AS (SELECT q.id, av + ((qx - ax) * cy - cx * (qy - ay)) / w * (bv - av) + (bx * (qy - ay) - (qx - ax) * b_y) / w * (cv - av) AS v FROM cells q JOIN del ON ((qx - ax) * cy - cx * (qy - ay)) / w >= 0 AND (bx * (qy - ay) - (qx - ax) * b_y) / w >= 0 AND ((qx - ax) * cy - cx * (qy - ay)) / w + (bx * (qy - ay) - (qx - ax) * b_y) / w <= 1)"
query("tin_interpolation", f"{_tin} SELECT cells.id, {_r('any_value(v)')} AS v FROM cells LEFT JOIN hit USING (id) GROUP BY cells.id", lambda s, d: triangulation.tin(jittered(s, d), cells(s, d)))

# other grids: cells half as large again, a quarter of a cell off, and the web's Mercator projection

_target = "tgt AS (SELECT px, py, {u} AS u, {v} AS v FROM range({x0}, {x1}) a(px), range({y0}, {y1}) b(py)), nb AS (SELECT t.px, t.py, t.u, t.v, floor(u - 0.5) + i AS nx, floor(v - 0.5) + j AS ny, (1 - abs(u - 0.5 - floor(u - 0.5) - i)) * (1 - abs(v - 0.5 - floor(v - 0.5) - j)) AS w FROM tgt t, range(2) c(i), range(2) d(j))"
_bilinear = f"SELECT a.band, nb.px, nb.py, {_r('sum(w * value) / sum(w)')} AS value FROM nb JOIN a ON a.px = nx AND a.py = ny GROUP BY a.band, nb.px, nb.py, nb.u, nb.v HAVING bool_or(nx = floor(u) AND ny = floor(v))"
_shifted = _target.format(u="0.25 + (px + 0.5) * 1.5", v="0.25 + (py + 0.5) * 1.5", x0=-2, x1=14, y0=-2, y1=14)
query("warp_bilinear", f"{ALL}, {_shifted} {_bilinear}", lambda s, d: warp.warped(every_year(s, d), warp.Grid(), warp.Grid(0.25, 0.25, 1.5, 1.5)))
query("warp_nearest", f"{ALL}, {_shifted} SELECT a.band, t.px, t.py, {_r('value')} AS value FROM tgt t JOIN a ON a.px = floor(u) AND a.py = floor(v)", lambda s, d: warp.warped(every_year(s, d), warp.Grid(), warp.Grid(0.25, 0.25, 1.5, 1.5), "nearest"))
_mercator = _target.format(u="degrees((px + 0.5) * 100000 / 6378137) / 1.0", v="degrees(atan(exp((py + 0.5) * 100000 / 6378137)) * 2 - pi() / 2)", x0=-1, x1=20, y0=-1, y1=20)
query("warp_mercator", f"{ALL}, {_mercator} {_bilinear}", lambda s, d: warp.warped(every_year(s, d), warp.Grid(), warp.Grid(0.0, 0.0, 100000.0, 100000.0, "EPSG:3857")))
query("warp_aligned_add", f"{ALL}, {_target.format(u='(px + 0.13) / 1.6::DOUBLE', v='(py + 0.13) / 1.6::DOUBLE', x0=-1, x1=28, y0=-1, y1=28)}, other AS ({_bilinear.replace('JOIN a ON', 'JOIN b a ON')}) SELECT a.band, a.px, a.py, {_r('a.value + o.value')} AS value FROM a JOIN other o USING (band, px, py)", lambda s, d: coverage.binary(*warp.aligned(every_year(s, d), warp.Grid(), every_year(s, d, 1), warp.Grid(0.37, 0.37, 1.6, 1.6)), "add"))

# SQL of regressions by Newton steps, one common table a step, solved by determinants


def _newton(family: str, y: str, steps: int = 12) -> str:
    mean = "1 / (1 + exp(-eta))" if family == "logistic" else "exp(eta)"
    weight = f"({mean}) * (1 - {mean})" if family == "logistic" else mean
    minor = {"a": "r0 * (s11 * s22 - s12 * s12) - s1 * (r1 * s22 - s12 * r2) + s2 * (r1 * s12 - s11 * r2)", "b": "s0 * (r1 * s22 - s12 * r2) - r0 * (s1 * s22 - s12 * s2) + s2 * (s1 * r2 - r1 * s2)", "e": "s0 * (s11 * r2 - r1 * s12) - s1 * (s1 * r2 - r1 * s2) + r0 * (s1 * s12 - s11 * s2)"}
    whole_ = "(s0 * (s11 * s22 - s12 * s12) - s1 * (s1 * s22 - s12 * s2) + s2 * (s1 * s12 - s11 * s2))"
    start = "ln(avg(t))" if family == "poisson" else "avg(t) * 0"
    out = [f"d AS MATERIALIZED (SELECT CAST({y} AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS c FROM lineitem)", f"b0 AS MATERIALIZED (SELECT {start} AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS e FROM d)"]
    for k in range(steps):
        sums = ", ".join(f"sum(w{''.join(' * ' + x for x in by)}) AS {name}" for name, by in (("s0", ""), ("s1", "q"), ("s2", "c"), ("s11", "qq"), ("s12", "qc"), ("s22", "cc"), ("r0", "z"), ("r1", "qz"), ("r2", "cz")))
        out.append(f"m{k} AS MATERIALIZED (SELECT {sums} FROM (SELECT q, c, w, eta + (t - m) / w AS z FROM (SELECT t, q, c, eta, {mean} AS m, {weight} AS w FROM (SELECT d.*, a + b * q + e * c AS eta FROM d, b{k}))))")
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT {', '.join(f'({v}) / {whole_} AS {n}' for n, v in minor.items())} FROM m{k})")
    return "WITH " + ", ".join(out) + f", fit AS (SELECT * FROM b{steps})"


_late = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
_terms = " UNION ALL ".join(f"SELECT '{t}' AS term, {_r(c)} AS coefficient FROM fit" for t, c in (("intercept", "a"), ("l_quantity", "b"), ("l_discount", "e")))
_scored = "f AS (SELECT t, 1 / (1 + exp(-(a + b * q + e * c))) AS m, avg(t) OVER () AS m0 FROM d, fit), g AS (SELECT sum(-2 * CASE WHEN t > 0 THEN ln(m) ELSE ln(1 - m) END) AS dev, sum(-2 * CASE WHEN t > 0 THEN ln(m0) ELSE ln(1 - m0) END) AS nul FROM f)"
_flat = "WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS c FROM lineitem), m AS (SELECT avg(q) AS mq, avg(c) AS mc, avg(p) AS mp, var_pop(p) AS vp, count(*) AS n, var_pop(q) AS vq, var_pop(c) AS vc, covar_pop(q, c) AS qc, covar_pop(q, p) AS qp, covar_pop(c, p) AS cp FROM d), s AS (SELECT *, (vc * qp - qc * cp) / (vq * vc - qc * qc) AS b, (vq * cp - qc * qp) / (vq * vc - qc * qc) AS e FROM m), fit AS (SELECT mp - b * mq - e * mc AS a, b, e, (b * qp + e * cp) / vp AS r2, n * (ln(2 * pi() * (vp - b * qp - e * cp)) + 1) + 8 AS aic FROM s)"
_turn = "((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x))"
ORACLE_SQL |= {
    "ols_2": f"{_flat} SELECT term, coefficient, {_r('r2')} AS r2, {_r('aic')} AS aic FROM ({_terms}) t, fit",
    "logistic": f"{_newton('logistic', _late)} {_terms}",
    "poisson": f"{_newton('poisson', 'l_linenumber')} {_terms}",
    "logistic_deviance": f"{_newton('logistic', _late)}, {_scored} SELECT {_r('dev')} AS deviance, {_r('nul')} AS null_deviance, {_r('1 - dev / nul')} AS pseudo_r2, {_r('dev + 6')} AS aic FROM g",
    # an edge of the hull has no point on its right, and none on its line beyond its ends
    "feat_convex_hull": f"{C}, e AS (SELECT a.g, a.x, a.y, b.x AS bx, b.y AS b_y FROM pts a JOIN pts b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.g = a.g AND ({_turn} < 0 OR ({_turn} = 0 AND ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y) < 0 OR (p.x - b.x) * (a.x - b.x) + (p.y - b.y) * (a.y - b.y) < 0))))) SELECT g, {_r('abs(sum(x * b_y - bx * y)) / 2')} AS area, count(*) AS corners FROM e GROUP BY g",
}


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem")
    fit = regression.generalised(rows, "l_linenumber", ["l_quantity", "l_discount"], "poisson")
    return regression.deviance(regression.scored(rows, ["l_quantity", "l_discount"], fit, "poisson"), "l_linenumber", "poisson", 3)


query("poisson_deviance", f"{_newton('poisson', 'l_linenumber')}, f AS (SELECT t, exp(a + b * q + e * c) AS m, avg(t) OVER () AS m0 FROM d, fit), g AS (SELECT sum(2 * (CASE WHEN t > 0 THEN t * ln(t / m) ELSE 0 END - t + m)) AS dev, sum(2 * (CASE WHEN t > 0 THEN t * ln(t / m0) ELSE 0 END - t + m0)) AS nul, sum(-2 * (t * ln(m) - m - lgamma(t + 1))) AS like2 FROM f) SELECT {_r('dev')} AS deviance, {_r('nul')} AS null_deviance, {_r('1 - dev / nul')} AS pseudo_r2, {_r('like2 + 6')} AS aic FROM g", _counted)

# horizons

_view = f"""{R}, ray AS (SELECT face * 41 + k + 20 AS ray, face, k, m, k * m / 20.0::DOUBLE AS off, CASE WHEN face % 2 = 0 THEN 1 ELSE -1 END AS ahead FROM range(4) f(face), range(-20, 21) t(k), range(1, 21) u(m)),
beside AS (SELECT ray, m, k, CASE WHEN face < 2 THEN 60 + ahead * m ELSE 60 + floor(off) + i END AS px, CASE WHEN face < 2 THEN 8 + floor(off) + i ELSE 8 + ahead * m END AS py, CASE WHEN i = 0 THEN 1 - (off - floor(off)) ELSE off - floor(off) END AS w FROM ray, range(2) s(i)),
h AS (SELECT ray, m, k, sum(w * value) / sum(w) AS h FROM beside JOIN relief USING (px, py) WHERE w > 0 GROUP BY ALL), eye AS (SELECT value + 30 AS eye FROM relief WHERE px = 60 AND py = 8),
horizon AS (SELECT ray, m, eye, max((h - eye) / (m * sqrt(1 + k * k / 400.0::DOUBLE))) OVER (PARTITION BY ray ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h, eye),
aim AS (SELECT ray, m, CASE WHEN face < 2 THEN 60 + ahead * m ELSE 60 + floor(off + 0.5) END AS px, CASE WHEN face < 2 THEN 8 + floor(off + 0.5) ELSE 8 + ahead * m END AS py, abs(off - floor(off + 0.5)) AS miss FROM ray),
near AS (SELECT r.band, r.px, r.py, r.value, ray, m FROM aim JOIN relief r ON r.px = aim.px AND r.py = aim.py QUALIFY row_number() OVER (PARTITION BY r.band, r.px, r.py ORDER BY miss, ray, m) = 1)
SELECT band, px, py, CAST(coalesce((value - eye) / sqrt((px - 60) * (px - 60) + (py - 8) * (py - 8)) >= top, true) AS INT) AS value FROM near JOIN horizon USING (ray, m) UNION ALL SELECT band, px, py, 1 FROM relief WHERE px = 60 AND py = 8 AND EXISTS (SELECT 1 FROM eye)"""
query("terrain_viewshed", _view, lambda s, d: sight.viewshed(fx.relief(s, d), 60, 8, 30.0, 20))
_sun = "tan(radians(50)) * sqrt(1 + pow(tan(radians(25)), 2)) * 20"
query("terrain_shadows", f"{R}, p AS (SELECT *, floor(py - px * tan(radians(25)) + 0.5) AS ray, value + px * {_sun} AS level FROM relief), q AS (SELECT *, max(level) OVER (PARTITION BY ray ORDER BY px ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p) SELECT band, px, py, CAST(coalesce(top > level + 1e-9, false) AS INT) AS value FROM q", lambda s, d: sight.shadows(fx.relief(s, d), 295.0, 50.0, 20.0))


query("gwr_auto_fit", None, lambda s, d: regression.auto_fit(fx.suppliers(s, d).withColumns({"east": F.col("x"), "north": F.col("y")}), "v", ["east", "north"], 50.0, 120.0, rounds=4)[0])
query("gtwr_predict", None, lambda s, d: regression.space_time_prediction(space_time_events(s, d), space_time_events(s, d).where("id % 3 = 0").drop("v").withColumn("x", F.col("x") + 1.0), "v", ["x"], "t", 8.0, 0.5))

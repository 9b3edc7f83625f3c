"""Rasters, points, polygons and cubes derived from the star-schema tables, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band, instant (year), px, py, value: a 16 x 16 raster of four bands a year, means rounded down to 64ths, so that sums are exact."""
    cents = lambda c, by: F.sum(F.round(F.col(c) * by).cast("long"))
    rows = table(spark, sf_dir, "lineitem").select("*", (F.col("l_partkey") % 16).alias("px"), (F.col("l_suppkey") % 16).alias("py"), F.year("l_shipdate").alias("instant"))
    sums = rows.groupBy("px", "py", "instant").agg(F.count("*").alias("n"), cents("l_quantity", 1).alias("Red"), cents("l_extendedprice", 100).alias("NIR"), cents("l_discount", 100).alias("Green"), cents("l_tax", 100).alias("SWIR1"))
    wide = sums.select("instant", "px", "py", *[F.expr(f"({b} * 64 div ({by} * n)) / 64d").alias(b) for b, by in (("Red", 1), ("NIR", 100000), ("Green", 1), ("SWIR1", 1))])
    return wide.unpivot(["instant", "px", "py"], ["Red", "NIR", "Green", "SWIR1"], "band", "value")


CUBE = """
wide AS (SELECT l_partkey % 16 AS px, l_suppkey % 16 AS py, year(l_shipdate) AS instant, sum(CAST(round(l_quantity) AS BIGINT)) * 64 // count(*) / 64 AS Red, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 64 // (100000 * count(*)) / 64 AS NIR, sum(CAST(round(l_discount * 100) AS BIGINT)) * 64 // count(*) / 64 AS Green, sum(CAST(round(l_tax * 100) AS BIGINT)) * 64 // count(*) / 64 AS SWIR1 FROM lineitem GROUP BY ALL),
cube AS (UNPIVOT (SELECT px, py, instant, Red::DOUBLE AS Red, NIR::DOUBLE AS NIR, Green::DOUBLE AS Green, SWIR1::DOUBLE AS SWIR1 FROM wide) ON Red, NIR, Green, SWIR1 INTO NAME band VALUE value)"""


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ring: a slanted triangle at each supplier's place, its size by the id."""
    k = F.col("id").cast("double")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    sized = suppliers(spark, sf_dir).withColumn("k", k % 4 + 3)
    a, b, c = corner(F.lit(0.0), F.lit(0.0)), corner(F.col("k") + 2, F.lit(1.0)), corner(F.lit(1.0), F.col("k"))
    return sized.select("id", F.array(a, b, c, a).alias("ring"))


TRIANGLES = f"""pts0 AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y, s_suppkey % 4 + 3 AS k FROM supplier),
tri AS (SELECT id, x AS x1, y AS y1, x + k + 2 AS x2, y + 1.0 AS y2, x + 1.0 AS x3, y + k AS y3 FROM pts0),
edges AS (SELECT id, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS b_y FROM tri UNION ALL SELECT id, x2, y2, x3, y3 FROM tri UNION ALL SELECT id, x3, y3, x1, y1 FROM tri)"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, v"""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"), F.col("s_acctbal").alias("v"))


SUPPLIERS = "pts AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y, s_acctbal AS v FROM supplier)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, v, g"""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 10007).cast("double").alias("x"), (k * 6101 % 9973).cast("double").alias("y"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("g"))


CUSTOMERS = "pts AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 10007 AS DOUBLE) AS x, CAST(c_custkey * 6101 % 9973 AS DOUBLE) AS y, c_acctbal AS v, c_mktsegment AS g FROM customer)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ring (array of x, y points of a unit square), v: 25 polygons."""
    total = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.sum("c_acctbal").alias("v"))
    square = F.expr("transform(array(array(0,0), array(1,0), array(1,1), array(0,1), array(0,0)), p -> named_struct('x', cast(id % 5 + p[0] as double), 'y', cast(id div 5 + p[1] as double)))")
    return total.select("id", square.alias("ring"), "v")


NATIONS = "poly AS (SELECT c_nationkey AS id, c_nationkey % 5 AS cx, c_nationkey // 5 AS cy, sum(c_acctbal) AS v FROM customer GROUP BY ALL)"


def relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band, px, py, value: one band, 200 columns wide and as many rows as the orders fill, with gaps."""
    k = F.col("l_orderkey")
    at = table(spark, sf_dir, "lineitem").groupBy(F.lit("height").alias("band"), (k % 200).alias("px"), F.floor(k / 200).alias("py"))
    return at.agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))


RELIEF = "relief AS (SELECT 'height' AS band, l_orderkey % 200 AS px, l_orderkey // 200 AS py, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def _ring(points: list[tuple]) -> Column:
    return F.array(*[F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in [*points, points[0]]])


def ells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rings: an L of arms one wide and k long at each supplier's place."""
    at = suppliers(spark, sf_dir).withColumn("k", F.col("id") % 4 + 3)
    return at.select("id", F.array(_ring([("x", "y"), ("x + k", "y"), ("x + k", "y + 1"), ("x + 1", "y + 1"), ("x + 1", "y + k"), ("x", "y + k")])).alias("rings"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rings: a square of side m with a square hole, one wide all around, that begins a step right of each supplier's place."""
    at = suppliers(spark, sf_dir).withColumn("m", F.col("id") % 3 + 3).withColumn("x", F.col("x") + 1).withColumn("y", F.col("y") + F.col("id") % 2)
    square = lambda a, b: _ring([(f"x + {a}", f"y + {a}"), (f"x + {b}", f"y + {a}"), (f"x + {b}", f"y + {b}"), (f"x + {a}", f"y + {b}")])
    return at.select("id", F.array(square("0", "m"), square("1", "m - 1")).alias("rings"))


#: The unit squares of both: (id, cx, cy).
ELLS = """places AS (SELECT s_suppkey AS id, s_suppkey * 37 % 101 AS x, s_suppkey * 53 % 97 AS y, s_suppkey % 4 + 3 AS k, s_suppkey % 3 + 3 AS m FROM supplier),
ells AS (SELECT id, x + i AS cx, y AS cy FROM places, range(7) t(i) WHERE i < k UNION SELECT id, x, y + i FROM places, range(7) t(i) WHERE i < k),
frames AS (SELECT id, x + 1 + i AS cx, y + id % 2 + j AS cy FROM places, range(5) t(i), range(5) u(j) WHERE i < m AND j < m AND (i = 0 OR j = 0 OR i = m - 1 OR j = m - 1))"""

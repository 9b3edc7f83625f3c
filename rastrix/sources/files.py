"""Features and tables from and to text files: CSV, WKT and GeoJSON, by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
#: A feature of a GeoJSON file with a polygon; properties as strings.
FEATURE = "type string, id string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties map<string,string>"


def read_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A CSV file with a header and a given schema; rows that don't fit have nulls."""
    return spark.read.options(header=True, mode="PERMISSIVE", **options).schema(schema).csv(path)


def point_rows(rows: DataFrame, x: str, y: str, value: str, id_col: str) -> DataFrame:
    """(id, x, y, v) of a table with coordinates as columns; rows without them go."""
    return rows.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v")).where("x is not null and y is not null")


def from_wkt(text: Column) -> Column:
    """The points of a POINT, LINESTRING or POLYGON (outer ring) as an array; null for anything else."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)", 1)
    points = F.transform(F.split(body, ","), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double")))
    return F.when(body != "", F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def to_wkt(ring: Column, kind: str = "POLYGON") -> Column:
    points = F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} (("), points, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), points, F.lit(")"))


def geometry_type(text: Column) -> Column:
    """The kind of geometry of a WKT text, upper-cased."""
    return F.nullif(F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def from_geojson(text: Column) -> Column:
    """A feature of GeoJSON text as (id, ring, props)."""
    f = F.from_json(text, FEATURE)
    ring = F.transform(f.geometry.coordinates[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.struct(f.id.alias("id"), ring.alias("ring"), f.properties.alias("props"))


def to_geojson(id_col: Column, ring: Column, props: Column) -> Column:
    """A feature with a polygon as GeoJSON text."""
    points = F.transform(ring, lambda p: F.array(p.x, p.y))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_col.cast("string").alias("id"), geometry.alias("geometry"), props.alias("properties")))


def write_lines(df: DataFrame, text: str, path: str) -> None:
    """A text column as lines of files under a path, a file for each partition."""
    df.select(F.col(text).alias("value")).write.text(path)

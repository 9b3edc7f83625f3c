"""Slippy tiles, Z-curve codes and web-mercator coordinates as columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of EPSG:3857 in metres; a fixed value.
RADIUS = 6378137.0


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * (1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / pi) / 2 * (1 << zoom)).cast("long")


def tile_lon(x: Column, zoom: int) -> Column:
    return x / F.lit(float(1 << zoom)) * 360.0 - 180.0


def tile_lat(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(pi * (1 - 2 * y / F.lit(float(1 << zoom))))))


def z_curve(x: Column, y: Column, zoom: int) -> Column:
    """Bits of x and y interleaved, x in the even places."""
    out = F.lit(0).cast("long")
    for k in range(zoom):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(1), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(1), 2 * k + 1)
    return out


def from_z_curve(code: Column, zoom: int) -> tuple[Column, Column]:
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(zoom):
        x = x + F.shiftleft(F.shiftright(code, 2 * k).bitwiseAND(1), k)
        y = y + F.shiftleft(F.shiftright(code, 2 * k + 1).bitwiseAND(1), k)
    return x, y


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * RADIUS, F.log(F.tan(pi / 4 + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - pi / 2)

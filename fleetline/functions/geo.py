"""Geometry on the sphere as columns, and grid keys that turn distance joins into equi joins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: metres of one degree of latitude
DEGREE_M = EARTH_M * math.pi / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # not least(), which would turn a missing point into the largest distance
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def bearing_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def cardinal8(bearing: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.floor((bearing + 22.5) / 45.0), F.lit(8)) + 1).cast("int"))


def cell_width(latitude: Column, metres: float) -> Column:
    """Degrees of longitude that are at least ``metres`` wide up to that latitude and ``metres`` beyond it.

    Near the poles (above 89 degrees) the width stays that of 89.
    """
    high = metres / DEGREE_M
    return high / F.cos(F.radians(F.least(F.lit(89.0), latitude + high)))


def grid_cell(x: Column, size: float | Column) -> Column:
    return F.floor(x / size).cast("long")


def neighbour_cells(lat: Column, lon: Column, lat_size: float | Column, lon_size: float | Column) -> Column:
    """The 3 x 3 cells around a point as an array of structs (cy, cx), to explode."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return F.array(*[F.struct((grid_cell(lat, lat_size) + dy).alias("cy"), (grid_cell(lon, lon_size) + dx).alias("cx")) for dy, dx in steps])


def wkt_linestring(points: Column) -> Column:
    """LINESTRING text of an array of structs with lon and lat."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")"))


def parse_wkt_linestring(text: Column) -> Column:
    """Array of structs (lon, lat) of LINESTRING text."""
    inner = F.regexp_extract(text, r"^LINESTRING\s*\((.*)\)$", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(inner, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("lon"), F.get(pair(p), F.lit(1)).try_cast("double").alias("lat")))

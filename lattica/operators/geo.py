"""Points on the earth: distances, directions, and a join on a grid of degree cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def direction(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The first bearing of the way from one point to another, in degrees from north."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.degrees(F.atan2(y, x)) + F.when(F.atan2(y, x) < 0, 360.0).otherwise(0.0)


def degree_cell(lat: Column, lon: Column, cell: float = 1.0) -> Column:
    """The key of the grid cell of a point."""
    wide = math.ceil(360 / cell)
    return (F.floor((lat + 90) / cell) * wide + F.pmod(F.floor((lon + 180) / cell), F.lit(wide))).cast("bigint")


def to_dms(degrees: Column) -> Column:
    """Degrees as struct of degrees, minutes and seconds."""
    size = F.abs(degrees)
    d, m = F.floor(size), F.floor((size - F.floor(size)) * 60)
    return F.struct((F.signum(degrees) * d).cast("int").alias("degrees"), m.cast("int").alias("minutes"), F.round(((size - d) * 60 - m) * 60, 6).alias("seconds"))


def from_dms(d: Column, m: Column, s: Column) -> Column:
    return F.signum(d) * (F.abs(d) + m / 60 + s / 3600)


def near(a: DataFrame, b: DataFrame, km: float, a_key: str, b_key: str) -> DataFrame:
    """Pairs of points (columns lat, lon) at most km apart. An equi-join on grid cells of that size: each point of a is in the nine
    cells around its own, so that no pair is missed. For km that span no more than a cell away from the poles."""
    cell = km / 111.0 * 1.01
    if cell > 30:
        raise ValueError("the radius is too large for a grid")
    left = a.select(F.col(a_key).alias("a_key"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    right = b.select(F.col(b_key).alias("b_key"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    # a cell is wider in longitude the farther from the equator: the band's factor keeps its width in km
    band = lambda lat: F.floor((lat + 90) / cell)
    wide = lambda b: F.greatest(F.lit(1), F.floor(F.lit(360.0 / cell) * F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs((b * cell) - 90), F.abs(((b + 1) * cell) - 90))))))).cast("bigint")
    column = lambda lon, b: F.floor((lon + 180) / 360 * wide(b))
    bands = left.withColumn("band", F.explode(F.array(*(band(F.col("a_lat")) + i for i in (-1, 0, 1)))))
    cells = F.array_distinct(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: F.pmod(column(F.col("a_lon"), F.col("band")) + i, wide(F.col("band")))))
    left = bands.withColumn("cell", F.explode(cells))
    right = right.withColumn("b_band", band(F.col("b_lat"))).withColumn("b_cell", F.pmod(column(F.col("b_lon"), F.col("b_band")), wide(F.col("b_band"))))
    joined = left.join(right, (F.col("band") == F.col("b_band")) & (F.col("cell") == F.col("b_cell")))
    d = distance_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return joined.where(d <= km).select("a_key", "b_key", d.alias("km")).distinct()

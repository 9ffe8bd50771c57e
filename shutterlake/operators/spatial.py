"""Map pins, viewports and the best city near a position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X
from shutterlake.operators.regions import EARTH_KM
from shutterlake.session import written

col = F.col
# Order of preference among kinds of places.
PRIORITY = {"PPLC": 0, "PPLA": 1, "PPLA2": 2, "PPLA3": 3, "PPLA4": 4, "PPLG": 5, "PPL": 6}
MAX_IDS = 500
#: Rows of city cells up to which they are broadcast.
MAX_BROADCAST_ROWS = 2_000_000


def cell_degrees(zoom: int) -> float:
    return 360.0 / 2 ** (min(zoom, 22) + 2)


def pins(photos: DataFrame, zoom: int) -> DataFrame:
    """(cy, cx, n, newest, lat, lon) per grid cell: number of photos, the newest one, the cell's centre."""
    c = cell_degrees(zoom)
    p = photos.where("lat is not null").withColumn("cy", F.floor(col("lat") / c)).withColumn("cx", F.floor(col("lon") / c))
    g = p.groupBy("cy", "cx").agg(F.count("*").alias("n"), F.max_by("photo_id", F.struct(col("taken").isNotNull(), "taken", "photo_id")).alias("newest"))
    return g.select("cy", "cx", "n", "newest", F.round((col("cy") + 0.5) * c, 6).alias("lat"), F.round((col("cx") + 0.5) * c, 6).alias("lon"))


def pin_ids(photos: DataFrame, zoom: int) -> DataFrame:
    """(cy, cx, ids): at most 500 photos of each cell, the smallest ids. Ranks are cut before they are collected."""
    from shutterlake.operators.timeline import top_per_group

    c = cell_degrees(zoom)
    p = photos.where("lat is not null").select("photo_id", F.floor(col("lat") / c).alias("cy"), F.floor(col("lon") / c).alias("cx"))
    t = top_per_group(p, ["cy", "cx"], [col("photo_id")], MAX_IDS)
    return t.groupBy("cy", "cx").agg(F.array_join(F.sort_array(F.collect_list("photo_id")).cast("array<string>"), ",").alias("ids"))


def merged_pins(photos: DataFrame, zoom: int, most: int) -> DataFrame:
    """(cy, cx, level, n, lat, lon): cells doubled until there are at most ``most``, with the mean position of their photos."""
    c = cell_degrees(zoom)
    p = photos.where("lat is not null").withColumn("cy", F.floor(col("lat") / c)).withColumn("cx", F.floor(col("lon") / c))
    g = written(p.groupBy("cy", "cx").agg(F.count("*").alias("n"), F.sum("lat").alias("sa"), F.sum("lon").alias("so")), "cells")
    level = 0
    while g.limit(most + 1).count() > most:
        level += 1
        half = lambda x: F.floor(col(x) / 2).alias(x)
        g = written(g.select(half("cy"), half("cx"), "n", "sa", "so").groupBy("cy", "cx").agg(*(F.sum(k).alias(k) for k in ("n", "sa", "so"))), "cells")
    return g.select("cy", "cx", F.lit(level).cast("long").alias("level"), "n", F.round(col("sa") / col("n") + 1e-7, 4).alias("lat"), F.round(col("so") / col("n") + 1e-7, 4).alias("lon"))


@dataclass(frozen=True)
class Viewport:
    """A map's window in degrees; west may exceed east across the antimeridian."""

    south: float
    north: float
    west: float
    east: float

    @staticmethod
    def of(south: float, north: float, west: float, east: float) -> Viewport:
        """Latitudes in order and within -90..90; longitudes wrapped, or all of them if the window is 360 degrees wide or more."""
        south, north = max(-90.0, min(south, north)), min(90.0, max(south, north))
        if east - west >= 360:
            return Viewport(south, north, -180.0, 180.0)
        wrap = lambda x: (x + 180.0) % 360.0 - 180.0 if not -180.0 <= x <= 180.0 else x
        return Viewport(south, north, wrap(west), wrap(east))

    def holds(self, lat: str = "lat", lon: str = "lon") -> Column:
        return X.in_box(lat, lon, self.south, self.north, self.west, self.east)


def wrapped_ranges(lon: float, width: float) -> list[tuple[float, float]]:
    """The longitudes within ``width`` of one, as one range or two on both sides of the antimeridian."""
    west, east = lon - width, lon + width
    if width >= 180:
        return [(-180.0, 180.0)]
    if west < -180:
        return [(west + 360, 180.0), (-180.0, east)]
    if east > 180:
        return [(west, 180.0), (-180.0, east - 360)]
    return [(west, east)]


def priority(code: str) -> Column:
    out = F.lit(7)
    for k, v in PRIORITY.items():
        out = F.when(col(code) == k, v).otherwise(out)
    return out


def best_city(points: DataFrame, cities: DataFrame, key: str, km: float = 100.0, people: int = 100_000) -> DataFrame:
    """(key, city_id, km): the best city of at least ``people`` within ``km`` of each point: in a box of 1 degree around it, else of 2 degrees;
    by kind of place, then distance, then id.

    Cities are copied to the 5 by 5 cells of one degree around theirs, so a point meets candidates by an equi-join; longitudes wrap.
    """
    c = cities.where((col("population") >= people) & col("latitude").between(-90, 90) & col("longitude").between(-180, 180))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    c = c.select(col("id").alias("city_id"), col("latitude").alias("_la"), col("longitude").alias("_lo"), priority("feature_code").alias("_pr"), F.explode(near).alias("_n"))
    c = c.withColumn("_y", F.floor("_la") + col("_n.a")).withColumn("_x", F.pmod(F.floor("_lo") + col("_n.b"), F.lit(360))).drop("_n")
    p = points.where("lat is not null").select(key, "lat", "lon").withColumn("_y", F.floor("lat")).withColumn("_x", F.pmod(F.floor("lon"), F.lit(360)))
    c = F.broadcast(c) if c.count() <= MAX_BROADCAST_ROWS else c
    gap = F.abs(col("lon") - col("_lo"))
    j = p.join(c, ["_y", "_x"]).withColumn("_dx", F.least(gap, F.lit(360.0) - gap)).withColumn("_dy", F.abs(col("lat") - col("_la")))
    j = j.where((col("_dx") <= 2) & (col("_dy") <= 2)).withColumn("km", X.haversine_km(col("lat"), col("lon"), col("_la"), col("_lo"), EARTH_KM)).where(col("km") <= km)
    rank = F.struct(((col("_dx") > 1) | (col("_dy") > 1)).alias("far"), "_pr", F.round("km", 6).alias("d"), "city_id")
    return j.groupBy(key).agg(F.min(rank).alias("r")).select(key, col("r.city_id").alias("city_id"), F.round(col("r.d") + 1e-7, 3).alias("km"))

"""Points in regions, by crossing parity over edges binned into latitude strips.

Regions are polygons in degrees, given as edges. Every edge lies in the latitude strips it touches, and in each of
them its region's edges stand in the longitude cells that the region's bounding box covers there, so a point meets
exactly the edges of the regions near it. A ray from the point towards the east crosses a polygon an odd number of
times if the point is inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Rows of binned edges up to which they are broadcast (about 100 MB); beyond it the join shuffles by strip and cell.
MAX_BROADCAST_ROWS = 400_000
SALTS = 16


def usable_position(lat: Column, lon: Column) -> Column:
    """Both finite, in range, not both 0. Null counts as unusable."""
    fine = lambda c, m: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= m)
    return fine(lat, 90.0) & fine(lon, 180.0) & ~((lat == 0) & (lon == 0))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of ``EARTH_KM``."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def circle_edges(centres: DataFrame, km: float, corners: int = 24) -> DataFrame:
    """(region, x1, y1, x2, y2): for (region, lat, lon) a polygon around each circle of radius ``km``.

    The polygon contains the whole circle: its corners lie far enough out, and by ``slack`` further, since an edge is
    straight in degrees and not a great circle. A circle that holds a pole becomes the belt of all longitudes
    from its lowest latitude to the pole. A polygon that leaves -180..180 appears once more, turned by 360 degrees.
    """
    slack = 1.02
    r = km / EARTH_KM
    out = math.degrees(r / math.cos(math.pi / corners)) * slack
    step = 2 * math.pi / corners
    polar = F.abs(F.col("lat")) + F.lit(out * 5) >= 90  # nearer to a pole no ellipse bounds a circle well
    # Half-width in longitude of a cap: asin(sin r / cos lat). It gives the ellipse that bounds the circle.
    wide = F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(out))) / F.cos(F.radians(F.least(F.abs(F.col("lat")) + F.lit(out * 0.1), F.lit(89.999)))), F.lit(1.0))))
    side = F.signum("lat")
    base = centres.where(usable_position(F.col("lat"), F.col("lon")))

    def belt() -> Column:
        low = side * (F.lit(90.0) - (F.lit(90.0) - F.abs(F.col("lat")) + F.lit(out)))
        pole = side * 90.5
        quad = [(F.lit(-181.0), low), (F.lit(181.0), low), (F.lit(181.0), pole), (F.lit(-181.0), pole)]
        return F.array(*[F.struct(quad[i][0].alias("x1"), quad[i][1].alias("y1"), quad[(i + 1) % 4][0].alias("x2"), quad[(i + 1) % 4][1].alias("y2")) for i in range(4)])

    def ring() -> Column:
        # Corners are taken at equal angles of the bounding ellipse, which is widened so that its edges stay outside.
        at = lambda i: ((F.col("lon") + F.col("wide") * math.cos(i * step) / math.cos(step / 2)), (F.col("lat") + out * math.sin(i * step) / math.cos(step / 2)))
        return F.array(*[F.struct(at(i)[0].alias("x1"), at(i)[1].alias("y1"), at(i + 1)[0].alias("x2"), at(i + 1)[1].alias("y2")) for i in range(corners)])

    edges = base.withColumn("wide", wide).select("region", F.explode(F.when(polar, belt()).otherwise(ring())).alias("e")).select("region", "e.*")
    spans = F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0))
    box = edges.groupBy("region").agg(F.min("x1").alias("west"), F.max("x1").alias("east"))
    turned = box.select("region", F.explode(spans).alias("by"), "west", "east").where((F.col("west") + F.col("by") <= 180) & (F.col("east") + F.col("by") >= -180)).where((F.col("by") == 0) | (F.col("east") - F.col("west") < 360))
    return edges.join(turned.select("region", "by"), "region").select(
        "region", F.col("by").cast("int").alias("turn"), (F.col("x1") + F.col("by")).alias("x1"), "y1", (F.col("x2") + F.col("by")).alias("x2"), "y2"
    )


def _binned(edges: DataFrame, strip: float, cell: float) -> DataFrame:
    """(strip, cell, region, turn, edges): each region's edges of a strip, in every cell of the region's box there."""
    e = edges.where(F.col("y1") != F.col("y2"))  # a level edge is never crossed by a level ray
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(lo / strip), F.floor(hi / strip))))
    box = edges.groupBy("region", "turn").agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
    per = e.groupBy("region", "turn", "strip").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    cells = F.sequence(F.floor(F.greatest("west", F.lit(-180.0)) / cell), F.floor(F.least("east", F.lit(180.0)) / cell))
    return per.join(box, ["region", "turn"]).select("strip", F.explode(cells).alias("cell"), "region", "turn", "edges")


def points_in_regions(points: DataFrame, edges: DataFrame, strip: float = 0.1, cell: float = 0.5) -> DataFrame:
    """All columns of ``points`` (which have lat and lon) with the region that holds them, one row per region and point.

    ``edges`` has region, turn, x1, y1, x2, y2. An edge counts where its lower end's latitude is at or below the point
    and its upper end's above it, so a corner is crossed once; a point on a boundary's western side counts as
    inside, on its eastern as outside. Points without a usable position are in no region. Columns of points named as those of edges are kept;
    the region is in ``region``.
    """
    b = _binned(edges, strip, cell)
    p = points.where(usable_position(F.col("lat"), F.col("lon"))).withColumn("_strip", F.floor(F.col("lat") / strip)).withColumn("_cell", F.floor(F.col("lon") / cell))
    b = b.select(F.col("strip").alias("_strip"), F.col("cell").alias("_cell"), F.col("region").alias("_region"), F.col("edges").alias("_edges"))
    if b.count() <= MAX_BROADCAST_ROWS:
        j = p.join(F.broadcast(b), ["_strip", "_cell"])
    else:  # a crowded cell is spread over SALTS tasks, its edges are copied to each
        p = p.withColumn("_salt", F.pmod(F.xxhash64("lat", "lon"), F.lit(SALTS)).cast("int"))
        j = p.join(b.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["_strip", "_cell", "_salt"]).drop("_salt")
    y, x = F.col("lat"), F.col("lon")

    def crosses(e: Column) -> Column:
        spans = (F.least(e.y1, e.y2) <= y) & (y < F.greatest(e.y1, e.y2))
        return spans & (x < e.x1 + (y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1))

    odd = F.size(F.filter("_edges", crosses)) % 2 == 1
    return j.where(odd).withColumnRenamed("_region", "region").drop("_strip", "_cell", "_edges")


def points_near(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(point_id, region) for each point (point_id, lat, lon) within ``km`` of a centre (region, lat, lon), each pair once.

    Candidates come from ``points_in_regions`` over polygons around the circles; the distance decides.
    """
    c = centres.select("region", "lat", "lon").dropDuplicates(["region", "lat", "lon"])
    c = c.where(usable_position(F.col("lat"), F.col("lon")))
    # Centres share a region id only if a record is repeated with another place; each place has its own polygon.
    c = c.withColumn("key", F.struct("region", "lat", "lon"))
    edges = circle_edges(c.select(F.col("key").alias("region"), "lat", "lon"), km)
    inside = points_in_regions(points.select("point_id", "lat", "lon"), edges)
    near = great_circle_km(F.col("lat"), F.col("lon"), F.col("region.lat"), F.col("region.lon")) <= km
    return inside.where(near).select("point_id", F.col("region.region").alias("region")).distinct()

"""Queries of the data-quality problems of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import orphans, regions, timestamps
from shutterlake.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    col = F.col
    zones = table(spark, d, "cities").groupBy(col("ascii_name").alias("location_city"), col("country_name").alias("location_country")).agg(F.min("timezone").alias("zone"), F.max("timezone").alias("_other"))
    zones = zones.select("location_city", "location_country", F.when(col("zone") == col("_other"), col("zone")).alias("zone"))
    photos = table(spark, d, "photos").join(zones, ["location_city", "location_country"], "left").select(
        F.lit("photos").alias("origin"), col("id").cast("string").alias("record_key"), col("date_taken_source").alias("source"), col("id").alias("ord"), col("date_taken").alias("value"), F.lit(False).alias("is_json"), "zone"
    )
    items = table(spark, d, "google_takeout_items").select(
        F.lit("google_takeout_items").alias("origin"), col("content_hash").alias("record_key"), F.lit("takeout_json").alias("source"), F.unix_micros(col("imported_at").cast("timestamp")).alias("ord"), col("metadata_json").alias("value"), F.lit(True).alias("is_json"), F.lit(None).cast("string").alias("zone")
    )
    return photos.unionByName(items)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.exact(_records(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Records per origin, source, notation and status, and per choice: which of a record's interpretations their order decided for."""
    return timestamps.normalised(_records(spark, d)).groupBy("origin", "source", "notation", "status", "choice").agg(F.count("*").alias("n"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    col = F.col
    to_photos = [
        orphans.References("trash", table(spark, d, "trash").select(col("id").alias("record_key"), col("photo_id").alias("ref"), col("trashed_at").alias("at"))),
        orphans.References("album_suggestions", table(spark, d, "album_suggestions").select(col("id").alias("record_key"), col("cover_photo_id").alias("ref"), col("created_at").alias("at"))),
    ]
    photos = table(spark, d, "photos").select(col("id").alias("key"), col("indexed_at").alias("known_at"))
    to_items = [
        orphans.References("google_takeout_albums", table(spark, d, "google_takeout_albums").select(col("row_id").alias("record_key"), orphans.norm_hash(col("content_hash")).alias("ref"), col("added_at").alias("at")))
    ]
    items = table(spark, d, "google_takeout_items").select(orphans.norm_hash(col("content_hash")).alias("key"), col("imported_at").alias("known_at"))
    return orphans.orphan_references(to_photos, photos).unionByName(orphans.orphan_references(to_items, items))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "photos").select(F.col("id").alias("point_id"), F.col("gps_latitude").alias("lat"), F.col("gps_longitude").alias("lon"))
    centres = table(spark, d, "cities").select(F.col("id").alias("region"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return regions.points_near(points, centres, 25.0).select(F.col("point_id").alias("photo_id"), F.col("region").alias("city_id"))


_P3 = """
WITH r AS (
  SELECT 'trash' AS src_table, CAST(id AS VARCHAR) AS record_key, CAST(photo_id AS VARCHAR) AS ref, trashed_at AS at FROM trash WHERE photo_id IS NOT NULL
  UNION SELECT 'album_suggestions', CAST(id AS VARCHAR), CAST(cover_photo_id AS VARCHAR), created_at FROM album_suggestions WHERE cover_photo_id IS NOT NULL
  UNION SELECT 'google_takeout_albums', CAST(row_id AS VARCHAR), lower(trim(content_hash, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), added_at FROM google_takeout_albums WHERE content_hash IS NOT NULL
), k AS (
  SELECT 'p' AS t, CAST(id AS VARCHAR) AS ref, min(indexed_at) AS known_at FROM photos GROUP BY ALL
  UNION ALL SELECT 'i', lower(trim(content_hash, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), min(imported_at) FROM google_takeout_items GROUP BY ALL
), j AS (
  SELECT r.src_table, r.record_key, coalesce(strftime(r.at, '%Y-%m'), 'unknown') AS period,
         CASE WHEN k.ref IS NULL THEN 'missing' WHEN k.known_at > r.at THEN 'late' END AS kind
  FROM r LEFT JOIN k ON r.ref = k.ref AND k.t = CASE WHEN r.src_table = 'google_takeout_albums' THEN 'i' ELSE 'p' END
)
"""

_P4 = """
SELECT DISTINCT p.id AS photo_id, c.id AS city_id FROM photos p JOIN cities c
  ON p.gps_latitude BETWEEN c.latitude - 0.23 AND c.latitude + 0.23
WHERE isfinite(p.gps_latitude) AND isfinite(p.gps_longitude) AND abs(p.gps_latitude) <= 90 AND abs(p.gps_longitude) <= 180
  AND NOT (p.gps_latitude = 0 AND p.gps_longitude = 0)
  AND 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(c.latitude - p.gps_latitude) / 2), 2)
      + cos(radians(p.gps_latitude)) * cos(radians(c.latitude)) * power(sin(radians(c.longitude - p.gps_longitude) / 2), 2)))) <= 25
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found}
SQL: dict[str, str] = {
    "p3_found": _P3 + "SELECT * FROM j WHERE kind IS NOT NULL",
    "p3_report": _P3 + "SELECT src_table, period, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": _P4,
}

"""The library's views over the tables, in Spark and as SQL for the oracle.

Each view has one row per record, without copies that were delivered again. The views of tables with copies are published once per session and state of
the files as a snapshot in the shared folder: deduplicated, derived columns stored, photos in ranges of ``taken``. So a query's filters and columns reach
the scan, row groups of other times are skipped, and no query shuffles a table to deduplicate it. ``taken`` is the wall clock of date_taken where it starts with a calendar date and
time; offsets are dropped, as the timeline shows what the camera's clock said. Positions out of range or within 0.001 degrees of (0, 0) count as missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.session import stamp, written
from shutterlake.sources.tables import table

_WALL = r"^\s*\d{4}[:-]\d{2}[:-]\d{2}[ T]\d{2}:\d{2}:\d{2}"


def wall_clock(text: Column) -> Column:
    """The leading calendar date and time of a text as a timestamp without zone, or null."""
    t = F.trim(F.regexp_extract(text, _WALL, 0))
    return F.concat(t.substr(1, 4), F.lit("-"), t.substr(6, 2), F.lit("-"), t.substr(9, 2), F.lit(" "), t.substr(12, 8)).try_cast("timestamp_ntz")


def valid_position(lat: Column, lon: Column) -> Column:
    """In range and not within 0.001 degrees of (0, 0)."""
    return (lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 0.001) & (F.abs(lon) < 0.001)) & ~F.isnan(lat) & ~F.isnan(lon)) & lat.isNotNull() & lon.isNotNull()


#: (application, name, state of the source's files) -> the snapshot published.
_PUBLISHED: dict[tuple[str, str, str], DataFrame] = {}


@dataclass(frozen=True)
class Library:
    """Named DataFrames of one library; nothing is read before it is used, and only the columns used."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def snapshot(self, name: str, source: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``build`` of a source table, published on first use; another state of the source's files is published anew."""
        key = (self.spark.sparkContext.applicationId, name, stamp(self.spark, f"{self.path}/{source}.parquet"))
        if key not in _PUBLISHED:
            _PUBLISHED[key] = written(build(self.table(source)), f"snapshot-{name}")
        return _PUBLISHED[key]

    def photos(self) -> DataFrame:
        def build(p: DataFrame) -> DataFrame:
            ok = valid_position(F.col("gps_latitude"), F.col("gps_longitude"))
            one = p.select(
                F.col("id").alias("photo_id"), "file_path", "file_name", "file_hash", "file_size", F.col("file_mtime").alias("mtime"),
                wall_clock(F.col("date_taken")).alias("taken"), F.when(ok, F.col("gps_latitude")).alias("lat"), F.when(ok, F.col("gps_longitude")).alias("lon"),
                F.col("location_city").alias("city"), F.col("location_country").alias("country"), F.col("camera_make").alias("make"), F.col("camera_model").alias("model"),
                "iso", "width", "height", F.coalesce("orientation", F.lit(1)).alias("orientation"), "media_type", "duration_ms", F.coalesce("is_favorite", F.lit(False)).alias("favorite"), F.coalesce("is_trashed", F.lit(False)).alias("trashed"), "trashed_at",
            ).dropDuplicates(["photo_id"])
            return one.repartitionByRange("taken", "photo_id").sortWithinPartitions("taken", "photo_id")

        return self.snapshot("photos", "photos", build)

    def live(self) -> DataFrame:
        return self.photos().where(~F.col("trashed"))

    def vectors(self) -> DataFrame:
        """Faces with their embedding, as delivered."""

        def build(c: DataFrame) -> DataFrame:
            i = F.col("face_id")
            return c.select("face_id", "photo_id", F.col("current_cluster_id").alias("cluster_id"), "embedding").dropDuplicates(["face_id"]).select(
                "face_id", "photo_id", "cluster_id", (F.lit(0.5) + (i % 50).cast("double") / 100).alias("confidence"),
                F.when(i % 7 == 0, 1).when(i % 11 == 0, -1).otherwise(0).alias("user_confirmed"), (F.lit(400) + (i * 37) % 9000).alias("area"), "embedding",
            )

        return self.snapshot("faces", "cluster_input", build)

    def faces(self) -> DataFrame:
        """Faces with their cluster, and a detector's confidence, the user's word and the box's size derived from the id."""
        return self.vectors().drop("embedding")

    def inferred(self) -> DataFrame:
        """(photo_id, cluster_id): identities that an earlier search inferred with a score of at least 0.95."""
        s = self.table("semantic_candidate").where((F.col("score").cast("double") >= 0.95) & (F.col("score").cast("double") <= 1.0)).select(F.col("query_face_id").alias("face_id"), F.col("photo_id").alias("at"))
        f = self.faces().select("face_id", "cluster_id").where(F.col("cluster_id").isNotNull())
        return s.join(f, "face_id").select(F.col("at").alias("photo_id"), "cluster_id").distinct()

    def candidates(self) -> DataFrame:
        """(photo_id, score) of an earlier search, without impossible scores."""
        s = self.table("semantic_candidate").select("photo_id", F.col("score").cast("double").alias("score"))
        return s.where(~F.isnan("score") & F.col("score").between(0, 1))

    def identities(self) -> DataFrame:
        """Direct and inferred identities, each once."""
        direct = self.faces().where(F.col("cluster_id").isNotNull()).select("photo_id", "cluster_id")
        return direct.unionByName(self.inferred()).distinct()

    def clusters(self) -> DataFrame:
        c = self.faces().where(F.col("cluster_id").isNotNull()).select("cluster_id").distinct()
        return c.select("cluster_id", F.when(F.col("cluster_id") % 7 != 0, F.concat(F.lit("Person "), F.col("cluster_id").cast("string"))).alias("name"))

    def album_photos(self) -> DataFrame:
        """(album, photo_id, added_at): the earliest time at which a photo's file was put into an album."""
        a = self.table("google_takeout_albums").select(F.col("album_name").alias("album"), F.lower(F.trim("content_hash")).alias("file_hash"), "added_at")
        a = a.where(F.col("album").isNotNull() & F.col("file_hash").isNotNull())
        p = self.photos().select("photo_id", F.lower("file_hash").alias("file_hash"))
        return a.groupBy("album", "file_hash").agg(F.min("added_at").alias("added_at")).join(p, "file_hash").select("album", "photo_id", "added_at")

    def suggestions(self) -> DataFrame:
        cols = ["id", "kind", "title", "photo_ids_json", "cover_photo_id", "fingerprint", "status", "seen_count", "created_at"]
        return self.snapshot("suggestions", "album_suggestions", lambda t: t.select(*cols).dropDuplicates(["id"]))

    def trash(self) -> DataFrame:
        return self.snapshot("trash", "trash", lambda t: t.dropDuplicates(["id"]))

    def cities(self) -> DataFrame:
        return self.table("cities")

    def items(self) -> DataFrame:
        return self.snapshot("items", "google_takeout_items", lambda t: t.select("content_hash", "file_path", "metadata_json").dropDuplicates(["content_hash"]))


_T = f"trim(regexp_extract(date_taken, '{_WALL}', 0))"
_OK = "gps_latitude BETWEEN -90 AND 90 AND gps_longitude BETWEEN -180 AND 180 AND NOT isnan(gps_latitude) AND NOT isnan(gps_longitude) AND NOT (abs(gps_latitude) < 0.001 AND abs(gps_longitude) < 0.001)"

#: The same views as common table expressions.
VIEWS = f"""
ph AS (
  SELECT id AS photo_id, any_value(file_path) AS file_path, any_value(file_name) AS file_name, any_value(file_hash) AS file_hash, any_value(file_size) AS file_size, any_value(file_mtime) AS mtime,
    any_value(try_cast(substr({_T}, 1, 4) || '-' || substr({_T}, 6, 2) || '-' || substr({_T}, 9, 2) || ' ' || substr({_T}, 12, 8) AS TIMESTAMP)) AS taken,
    any_value(CASE WHEN {_OK} THEN gps_latitude END) AS lat, any_value(CASE WHEN {_OK} THEN gps_longitude END) AS lon,
    any_value(location_city) AS city, any_value(location_country) AS country, any_value(camera_make) AS make, any_value(camera_model) AS model, any_value(iso) AS iso,
    any_value(width) AS width, any_value(height) AS height, coalesce(any_value(orientation), 1) AS orientation, any_value(media_type) AS media_type, any_value(duration_ms) AS duration_ms,
    any_value(coalesce(is_favorite, false)) AS favorite, any_value(coalesce(is_trashed, false)) AS trashed, any_value(trashed_at) AS trashed_at
  FROM photos GROUP BY id
), live AS (SELECT * FROM ph WHERE NOT trashed),
faces AS (
  SELECT face_id, any_value(photo_id) AS photo_id, any_value(current_cluster_id) AS cluster_id, 0.5::DOUBLE + CAST(face_id % 50 AS DOUBLE) / 100 AS confidence,
    CASE WHEN face_id % 7 = 0 THEN 1 WHEN face_id % 11 = 0 THEN -1 ELSE 0 END AS user_confirmed, 400 + (face_id * 37) % 9000 AS area
  FROM cluster_input GROUP BY face_id
), inferred AS (
  SELECT DISTINCT s.photo_id, f.cluster_id FROM semantic_candidate s JOIN faces f ON f.face_id = s.query_face_id
  WHERE CAST(s.score AS DOUBLE) >= 0.95::DOUBLE AND CAST(s.score AS DOUBLE) <= 1 AND f.cluster_id IS NOT NULL
), candidates AS (SELECT photo_id, CAST(score AS DOUBLE) AS score FROM semantic_candidate WHERE NOT isnan(score) AND CAST(score AS DOUBLE) BETWEEN 0 AND 1),
identities AS (SELECT photo_id, cluster_id FROM faces WHERE cluster_id IS NOT NULL UNION SELECT photo_id, cluster_id FROM inferred),
clusters AS (SELECT DISTINCT cluster_id, CASE WHEN cluster_id % 7 <> 0 THEN 'Person ' || cluster_id END AS name FROM faces WHERE cluster_id IS NOT NULL),
album_photos AS (
  SELECT a.album, p.photo_id, a.added_at FROM
    (SELECT album_name AS album, lower(trim(content_hash)) AS file_hash, min(added_at) AS added_at FROM google_takeout_albums WHERE album_name IS NOT NULL AND content_hash IS NOT NULL GROUP BY ALL) a
    JOIN ph p ON lower(p.file_hash) = a.file_hash
), suggestions AS (SELECT DISTINCT id, kind, title, photo_ids_json, cover_photo_id, fingerprint, status, seen_count, created_at FROM album_suggestions),
bin AS (SELECT DISTINCT * FROM trash),
items AS (SELECT content_hash, any_value(file_path) AS file_path, any_value(metadata_json) AS metadata_json FROM google_takeout_items GROUP BY content_hash)
"""


def sql(body: str, more: str = "") -> str:
    """A query over the views; ``more`` adds common table expressions."""
    return f"WITH RECURSIVE {VIEWS}{',' if more else ''} {more} {body}"

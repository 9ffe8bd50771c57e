"""Changes of a library as transformations of snapshots: each returns the table after the change, nothing is altered in place.

Applying a change twice gives the same table as applying it once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X

col = F.col


def trashed(photos: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """The photos named are trashed; those already in the trash keep their time."""
    m = photos.join(ids.select("photo_id", F.lit(True).alias("_m")).distinct(), "photo_id", "left")
    new = F.coalesce("_m", F.lit(False)) & ~col("trashed")
    return m.withColumn("trashed_at", F.when(new, X.ts(at)).otherwise(col("trashed_at"))).withColumn("trashed", col("trashed") | F.coalesce("_m", F.lit(False))).drop("_m")


def restored(photos: DataFrame, ids: DataFrame) -> DataFrame:
    m = photos.join(ids.select("photo_id", F.lit(True).alias("_m")).distinct(), "photo_id", "left")
    back = F.coalesce("_m", F.lit(False))
    return m.withColumn("trashed_at", F.when(~back, col("trashed_at"))).withColumn("trashed", col("trashed") & ~back).drop("_m")


def deleted(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the photos named, as a cascade would leave them."""
    k = ids.select("photo_id").distinct()
    return [t.join(k, "photo_id", "left_anti") for t in tables]


def added_to_album(album_photos: DataFrame, album: str, ids: DataFrame, live: DataFrame, at: str) -> DataFrame:
    """Only live photos are added, and none twice."""
    new = ids.select("photo_id").distinct().join(live, "photo_id", "left_semi").select(F.lit(album).alias("album"), "photo_id", X.ts(at).alias("added_at"))
    have = album_photos.where(col("album") == album).select("photo_id")
    return album_photos.select("album", "photo_id", "added_at").unionByName(new.join(have, "photo_id", "left_anti"))


def removed_from_album(album_photos: DataFrame, album: str, ids: DataFrame) -> DataFrame:
    out = ids.select("photo_id", F.lit(album).alias("album")).distinct()
    return album_photos.join(out, ["album", "photo_id"], "left_anti")


def renamed_album(album_photos: DataFrame, old: str, new: str) -> DataFrame:
    return album_photos.withColumn("album", F.when(col("album") == old, new).otherwise(col("album")))


def deleted_album(album_photos: DataFrame, album: str) -> DataFrame:
    return album_photos.where(col("album") != album)


def exported(album_photos: DataFrame, live: DataFrame, album: str, n: int | None = None) -> DataFrame:
    """(position, photo_id, file_path) of an album's live photos in the order in which they were added."""
    from pyspark.sql import Window as W

    a = album_photos.where(col("album") == album).join(live.select("photo_id", "file_path"), "photo_id")
    w = W.partitionBy("album").orderBy(col("added_at").asc_nulls_last(), "photo_id")
    out = a.select(F.row_number().over(w).cast("long").alias("position"), "photo_id", "file_path")
    return out if n is None else out.where(col("position") <= n)


def recovered_stacks(members: DataFrame, live: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """(photo_id, stack, cover): stacks after photos left: members that live, stacks of two or more, covers chosen (stack, cover) where they are members, else the smallest id."""
    m = members.select("photo_id", "stack").join(live, "photo_id", "left_semi")
    g = m.groupBy("stack").agg(F.min("photo_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    m = m.join(g, "stack")
    if covers is None:
        return m.select("photo_id", "stack", col("_first").alias("cover"))
    good = covers.select("stack", "cover").join(m.select("stack", col("photo_id").alias("cover")), ["stack", "cover"], "left_semi")
    return m.join(good, "stack", "left").select("photo_id", "stack", F.coalesce("cover", "_first").alias("cover"))


def non_keepers(groups: DataFrame, keeps: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(photo_id): the members of groups (group_key, photo_id) to be trashed: all but the one kept (group_key, keep), of groups that aren't dismissed (group_key)."""
    g = groups.join(dismissed, "group_key", "left_anti").join(keeps, "group_key")
    return g.where(col("photo_id") != col("keep")).select("photo_id").distinct()


def without_folder(photos: DataFrame, folder: str) -> DataFrame:
    return photos.where(~F.coalesce(X.under("file_path", folder), F.lit(False)))


def takeout_applied(photos: DataFrame, ledger: DataFrame) -> DataFrame:
    """Photos with what their sidecar (file_path, taken, lat, lon, favorited) says: it wins for date and place, and a favourite is only ever turned on."""
    s = ledger.select("file_path", *[col(c).alias(f"_{c}") for c in ("taken", "lat", "lon", "favorited")])
    j = photos.join(s, "file_path", "left")
    return j.withColumns({"taken": F.coalesce("_taken", "taken"), "lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon"), "favorite": col("favorite") | F.coalesce("_favorited", F.lit(False))}).drop("_taken", "_lat", "_lon", "_favorited")


def index_state(state: DataFrame, results: DataFrame, attempts: int = 3) -> DataFrame:
    """(id, status, attempts) after results (id, ok): indexed, or failed with one attempt more; given up after ``attempts``."""
    r = results.groupBy("id").agg(F.max("ok").alias("_ok"))
    j = state.join(r, "id", "full")
    n = F.coalesce("attempts", F.lit(0)) + F.when(col("_ok").isNull() | col("_ok"), 0).otherwise(1)
    status = F.when(col("_ok"), "indexed").when(~col("_ok"), F.when(n >= attempts, "unsupported").otherwise("failed")).otherwise(col("status"))
    return j.select("id", status.alias("status"), n.alias("attempts"))


def _pointers(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def publish(df: DataFrame, folder: str) -> str:
    """Write a snapshot as a new version of a table and point to it. The version's name.

    A pointer is an empty file named after its number and its version, made in one step after the version is complete, and never changed. Readers take
    the highest, so they see the old version or the new one; of two writers with one number the larger name counts.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    fs, names = _pointers(spark, folder)
    n = int(names[-1].partition("-")[0]) + 1 if names else 1
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions/{n:012d}-{version}"), False).close()
    return version


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table's last published version."""
    return spark.read.parquet(f"{folder}/{_pointers(spark, folder)[1][-1].partition('-')[2]}")

"""Counts and facets of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X

col = F.col


def year_counts(photos: DataFrame) -> DataFrame:
    """(year, n), undated photos under a null year."""
    return photos.groupBy(F.year("taken").alias("year")).agg(F.count("*").alias("n"))


def heat_map(photos: DataFrame, year: int | None = None) -> DataFrame:
    """(day, n) of one year, by default the latest."""
    dated = photos.where("taken is not null")
    if year is not None:
        dated = dated.where(F.year("taken") == year)
    else:
        latest = dated.agg(F.max(F.year("taken")).alias("_y"))
        dated = dated.crossJoin(F.broadcast(latest)).where(F.year("taken") == col("_y"))
    return dated.groupBy(F.to_date("taken").alias("day")).agg(F.count("*").alias("n"))


def months(photos: DataFrame) -> DataFrame:
    """(month, n) for all twelve months."""
    some = photos.where("taken is not null").groupBy(F.month("taken").cast("long").alias("month")).agg(F.count("*").alias("n"))
    return photos.sparkSession.range(1, 13).select(col("id").alias("month")).join(some, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def totals(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count("*").alias("n"), F.count_if(col("media_type") == "video").alias("videos"), F.count_if("favorite").alias("favorites"), F.min("taken").alias("first_taken"), F.max("taken").alias("last_taken"))


def places(photos: DataFrame) -> DataFrame:
    """Distinct countries and (city, country) pairs, and photos with a position."""
    pair = F.when(col("city").isNotNull(), F.concat(F.coalesce("city", F.lit("")), F.chr(F.lit(31)), F.coalesce("country", F.lit(""))))
    return photos.agg(F.countDistinct("country").alias("countries"), F.countDistinct(pair).alias("cities"), F.count("lat").alias("located"))


def top(photos: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent values, ties in their order."""
    known = photos.where(" and ".join(f"{c} is not null" for c in by))
    return known.groupBy(*by).agg(F.count("*").alias("n")).orderBy(col("n").desc(), *by).limit(n)


def home_city(photos: DataFrame) -> DataFrame:
    """(city, country, weeks, lat, lon): the city with photos in the most weeks, and the mean of its positions."""
    p = photos.where("taken is not null and city is not null and lat is not null")
    g = p.groupBy("city", "country").agg(F.countDistinct(X.year_week("taken")).alias("weeks"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    return g.orderBy(col("weeks").desc(), "city", "country").limit(1)


def wasted_bytes(photos: DataFrame) -> DataFrame:
    """What copies take beyond the largest of each group of the same content."""
    g = photos.where("file_hash is not null").groupBy("file_hash").agg(F.count("*").alias("n"), F.sum("file_size").alias("s"), F.max("file_size").alias("m")).where("n > 1")
    return g.agg(F.coalesce(F.sum(col("s") - col("m")), F.lit(0)).alias("wasted"))

"""The timeline's total order, keyset pages, day ranges and neighbours."""

from __future__ import annotations

import base64
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Undated last, newest first, then the larger id.
ORDER = [F.desc_nulls_last, F.desc]
MAX_LIMIT = 2000


def in_order(df: DataFrame, date: str = "taken", key: str = "photo_id") -> DataFrame:
    return df.orderBy(F.col(date).desc_nulls_last(), F.col(key).desc())


def after(date: str, key: str, cursor: tuple[datetime | None, int]) -> Column:
    """Rows that follow the cursor in the total order."""
    d, i = cursor
    if d is None:
        return F.col(date).isNull() & (F.col(key) < i)
    at = F.lit(d).cast("timestamp_ntz")
    return F.col(date).isNull() | (F.col(date) < at) | ((F.col(date) == at) & (F.col(key) < i))


def page(df: DataFrame, limit: int, cursor: tuple[datetime | None, int] | None = None, date: str = "taken", key: str = "photo_id") -> DataFrame:
    """The first ``limit`` rows after the cursor; the plan is a distributed top-k, whatever the table's size."""
    limit = max(1, min(limit, MAX_LIMIT))
    return in_order(df if cursor is None else df.where(after(date, key, cursor)), date, key).limit(limit)


def page_with_more(df: DataFrame, limit: int, cursor: tuple[datetime | None, int] | None = None) -> DataFrame:
    """A page with has_more, from a probe of one row beyond it."""
    probe = in_order(df if cursor is None else df.where(after("taken", "photo_id", cursor))).limit(limit + 1)
    n = W.partitionBy()  # limit + 1 rows
    probe = probe.withColumn("_rn", F.row_number().over(n.orderBy(F.col("taken").desc_nulls_last(), F.col("photo_id").desc()))).withColumn("has_more", F.count("*").over(n) > limit)
    return probe.where(F.col("_rn") <= limit).drop("_rn")


def encode_cursor(date: datetime | None, key: int) -> str:
    return base64.urlsafe_b64encode(f"{date.isoformat() if date else ''}|{key}".encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[datetime | None, int]:
    """The cursor of a page; ValueError if it isn't one."""
    try:
        date, sep, key = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode().rpartition("|")
        if not sep or int(key) <= 0:
            raise ValueError(text)
        return (datetime.fromisoformat(date) if date else None), int(key)
    except (ValueError, UnicodeDecodeError) as e:
        raise ValueError("not a cursor") from e


def day_ranges(df: DataFrame, date: str = "taken") -> DataFrame:
    """(day, n, start_index, end_index): half-open ranges of each day in the timeline; undated rows are the last range.

    Only the counts per day are put in order, so no task sees more rows than there are days.
    """
    days = df.groupBy(F.to_date(date).alias("day")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy().orderBy(F.col("day").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    return days.select("day", "n", (upto - F.col("n")).alias("start_index"), upto.alias("end_index"))


def neighbours(df: DataFrame, date: str = "taken", key: str = "photo_id") -> DataFrame:
    """(key, prev_id, next_id) in the total order of all rows.

    Rows are ordered within hours (undated ones within ranges of ids); only the first and last row of each such bucket meet the
    buckets before and after.
    """
    secs = F.unix_seconds(F.col(date).cast("timestamp"))
    b = df.select(F.col(key), F.col(date), F.col(date).isNull().cast("int").alias("_u"), F.when(F.col(date).isNull(), -F.floor(F.col(key) / 100_000)).otherwise(-F.floor(secs / 3600)).alias("_b"))
    w = W.partitionBy("_u", "_b").orderBy(F.col(date).desc_nulls_last(), F.col(key).desc())
    inner = b.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))
    edge = F.struct(F.col(date), F.col(key))
    ends = b.groupBy("_u", "_b").agg(F.max_by(F.col(key), edge).alias("first"), F.min_by(F.col(key), edge).alias("last"))
    o = W.partitionBy().orderBy("_u", "_b")  # one row per bucket
    ends = ends.select("_u", "_b", F.lag("last").over(o).alias("before"), F.lead("first").over(o).alias("behind"))
    j = inner.join(ends, ["_u", "_b"])
    return j.select(key, F.coalesce("prev_id", "before").alias("prev_id"), F.coalesce("next_id", "behind").alias("next_id"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; a group limit runs before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rn") <= n)

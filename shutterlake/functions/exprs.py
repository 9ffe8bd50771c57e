"""Column expressions and small building blocks; all of them stay in the JVM."""

from __future__ import annotations

from datetime import date, timedelta
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from shutterlake.sources.library import Library

col = F.col
ts = lambda s: F.lit(s).cast("timestamp_ntz")


def optional(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def seconds(c: str) -> Column:
    """Seconds since 1970 of a wall clock."""
    return F.unix_seconds(col(c).cast("timestamp"))


def folder(path: str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def between_days(c: str, first: str, last: str) -> Column:
    """Both days included, the last to its last full second."""
    return col(c).between(ts(first), ts(f"{last} 23:59:59"))


def half_open(c: str, start: str, end: str) -> Column:
    return (col(c) >= ts(start)) & (col(c) < ts(end))


def in_box(lat: str, lon: str, south: float, north: float, west: float, east: float) -> Column:
    """A box may cross the antimeridian, where west exceeds east."""
    across = (col(lon) >= west) | (col(lon) <= east) if west > east else col(lon).between(west, east)
    return col(lat).between(south, north) & across


def any_contains(columns: list[str], text: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return out


def month_day_window(c: str, today: str, days: int) -> Column:
    t = date.fromisoformat(today)
    return F.date_format(c, "MM-dd").isin([(t + timedelta(k)).strftime("%m-%d") for k in range(-days, days + 1)])


def non_covers(live: DataFrame) -> DataFrame:
    """Photos of a file that another photo, with a smaller id, shows too."""
    first = live.groupBy("file_hash").agg(F.min("photo_id").alias("cover"))
    return live.select("photo_id", "file_hash").join(first, "file_hash").where("photo_id > cover").select("photo_id")


def under(path: str, folder_: str) -> Column:
    return (col(path) == folder_) | col(path).startswith(folder_ + "/")


def unchanged(size: str, new_size: str, mtime: str, new_mtime: str) -> Column:
    """Same size, and times at most 2 s apart or by whole quarters of an hour up to 14 h (another zone's clock)."""
    d = F.abs(col(new_mtime) - col(mtime))
    return F.coalesce(col(size).eqNullSafe(col(new_size)) & ((d <= 2) | ((d % 900 == 0) & (d <= 14 * 3600))), F.lit(False))


def mass_removal(df: DataFrame) -> DataFrame:
    """Whether so many files are missing that the listing is rather wrong: at least 25 and more than a fifth."""
    gone = F.count_if(col("there").isNull())
    return df.agg(gone.alias("missing"), F.count("*").alias("active"), ((gone >= 25) & (gone * 5 > F.count("*"))).alias("refused"))


def by_status(faces: DataFrame, status: str) -> DataFrame:
    wanted = {"confirmed": col("user_confirmed") == 1, "unconfirmed": col("user_confirmed") == 0, "rejected": col("user_confirmed") == -1}
    return optional(faces, wanted.get(status))


def cleaned(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit("")).alias(c)


def later(lib: Library) -> DataFrame:
    """A later listing in which a tenth of the files moved and a tenth is gone."""
    p = lib.photos().where("photo_id % 10 <> 0")
    return p.select(F.when(col("photo_id") % 10 == 1, F.concat(F.lit("moved/"), "file_path")).otherwise(col("file_path")).alias("file_path"), col("file_size").alias("size"), "mtime", "file_hash")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def good_faces(faces: DataFrame) -> DataFrame:
    """Faces fit for a gallery: of at least 900 pixels, a confidence of 0.55 and a blur (variance of the Laplacian) of 40, turned by at most 35 degrees."""
    return faces.where((F.col("area") >= 900) & (F.col("confidence") >= 0.55) & (F.col("blur") >= 40) & (F.abs("yaw") <= 35))


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if either is null or all 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine(a: str, b: str) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def nearest_to(vectors: DataFrame, key: str, vec: str, query: int, k: int) -> DataFrame:
    """The k vectors most similar to one of them; the query is one row, the rest a scan with a distributed top-k."""
    one = vectors.where(col(key) == query).select(col(vec).alias("_q")).limit(1)
    s = vectors.crossJoin(F.broadcast(one)).select(key, F.round(cosine(vec, "_q"), 6).alias("score"))
    return s.orderBy(col("score").desc(), key).limit(k)


def relevant(scored: DataFrame, key: str) -> DataFrame:
    """Candidates near the best score: top of at least 0.06; score of at least 0.06, top - 0.02 and 0.75 top; at most 80."""
    top = scored.agg(F.max("score").alias("top"))
    s = scored.crossJoin(F.broadcast(top)).where((col("top") >= 0.06) & (col("score") >= F.greatest(F.lit(0.06), col("top") - 0.02, col("top") * 0.75)))
    return s.orderBy(col("score").desc(), key).limit(80).drop("top")


def next_review(faces: DataFrame) -> DataFrame:
    """The unconfirmed faces of the cluster with the most of them, ties to the smaller cluster."""
    u = faces.where("cluster_id is not null and user_confirmed = 0")
    best = u.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(col("n").desc(), "cluster_id").limit(1).select("cluster_id")
    return u.join(F.broadcast(best), "cluster_id").select("face_id", "cluster_id")


def cursor(date_: str, key: str) -> Column:
    text = F.concat(F.coalesce(F.date_format(date_, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), F.lit("|"), col(key).cast("string"))
    return F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/", "-_"), F.lit("="))


def indexed(df: DataFrame, key: str) -> DataFrame:
    """_i, the position in order of ``key``, and _n, the number of rows. Positions come from counts of 4096 ranges, not from one sort.

    ``key`` must be a number; the range of an id is its share of the span of ids.
    """
    span = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count("*").alias("_n"))
    d = df.crossJoin(F.broadcast(span)).withColumn("_b", F.floor((col(key) - col("_lo")) * 4096 / (col("_hi") - col("_lo") + 1)))
    before = d.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(W.partitionBy().orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - col("_c"))
    d = d.join(F.broadcast(before.select("_b", "_before")), "_b")
    return d.withColumn("_i", col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1).drop("_b", "_before", "_lo", "_hi")


def thinned(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows spread evenly over the order: those at floor(i * n / most)."""
    d = indexed(df, key)
    at = lambda i: F.floor((i * most + col("_n") - 1) / col("_n"))
    return d.where((col("_n") <= most) | (at(col("_i") + 1) > at(col("_i")))).drop("_i", "_n")


def rotated(df: DataFrame, key: str, turn: int) -> DataFrame:
    """The row at ``turn`` modulo the number of rows (a short list of candidates)."""
    w = W.partitionBy()
    return df.withColumn("_i", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count("*").over(w)).where(col("_i") == F.lit(turn) % col("_n")).drop("_i", "_n")


def in_given_order(df: DataFrame, key: str, ids: list[int], most: int = 500) -> DataFrame:
    """Rows of the ids given, with pos, the place of each id's first mention; ids up to 0 are left out."""
    seen: dict[int, int] = {}
    for pos, i in enumerate(ids, 1):
        if i > 0:
            seen.setdefault(i, pos)
    pairs = sorted(seen.items(), key=lambda x: x[1])[:most]
    where = df.sparkSession.createDataFrame(pairs or [(0, 0)], f"{key} long, pos long")
    return df.join(F.broadcast(where), key)


def week_monday(c: str) -> Column:
    """Week of the year from Monday on, 0 before the first Monday."""
    return F.floor((F.dayofyear(c) - 1 + 7 - F.weekday(c)) / 7)


def year_week(c: str) -> Column:
    return F.concat(F.date_format(c, "yyyy"), F.lit("-"), F.lpad(week_monday(c).cast("string"), 2, "0"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * radius)

"""Timeline, filter, join, window, page and set queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X
from shutterlake.operators import timeline as T
from shutterlake.operators.search import text_hits
from shutterlake.operators.segments import gap_islands
from shutterlake.sources.library import Library, sql

Query = Callable[[Library], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
col = F.col
AT = datetime(2022, 6, 1)  # noqa: DTZ001
_AT = "TIMESTAMP '2022-06-01'"
_LITE = "photo_id, taken, city, country, media_type, favorite"
LITE = ["photo_id", "taken", "city", "country", "media_type", "favorite"]
_ORDER = "ORDER BY taken DESC NULLS LAST, photo_id DESC"


def add(name: str, text: str | None, more: str = "") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: f(Library(spark, d))
        if text:
            SQL[name] = sql(text, more)
        return f

    return put


def q(name: str, text: str | None, f: Query, more: str = "") -> None:
    add(name, text, more)(f)


# Predicates and projections
q("PF01", "SELECT photo_id, file_path FROM live", lambda L: L.live().select("photo_id", "file_path"))
q("PF02", f"SELECT {_LITE} FROM ph", lambda L: L.photos().select(*LITE))
q("PF03", f"SELECT photo_id FROM live WHERE taken IS NULL OR taken < {_AT} OR (taken = {_AT} AND photo_id < 500)", lambda L: L.live().where(T.after("taken", "photo_id", (AT, 500))).select("photo_id"))
q("PF03_undated", "SELECT photo_id FROM live WHERE taken IS NULL AND photo_id < 5000", lambda L: L.live().where(T.after("taken", "photo_id", (None, 5000))).select("photo_id"))
q("PF04", "SELECT trashed, count(*) AS n FROM ph GROUP BY trashed", lambda L: X.optional(L.photos(), None).groupBy("trashed").agg(F.count("*").alias("n")))
q("PF05", "SELECT photo_id FROM live WHERE taken BETWEEN TIMESTAMP '2021-01-01' AND TIMESTAMP '2021-12-31 23:59:59'", lambda L: L.live().where(X.between_days("taken", "2021-01-01", "2021-12-31")).select("photo_id"))
q("PF06", "SELECT photo_id FROM live WHERE taken >= TIMESTAMP '2021-01-01' AND taken < TIMESTAMP '2021-02-01'", lambda L: L.live().where(X.half_open("taken", "2021-01-01", "2021-02-01")).select("photo_id"))
q("PF07", "SELECT photo_id FROM live WHERE lat BETWEEN -60 AND 60 AND (lon >= 120 OR lon <= -80)", lambda L: L.live().where(X.in_box("lat", "lon", -60, 60, 120, -80)).select("photo_id"))
q("PF08", "SELECT photo_id, lat, lon FROM ph WHERE lat IS NOT NULL", lambda L: L.photos().where("lat is not null").select("photo_id", "lat", "lon"))
_ARMS = """SELECT photo_id FROM live l WHERE contains(lower(coalesce(file_name, '')), '{t}') OR contains(lower(coalesce(city, '')), '{t}') OR contains(lower(coalesce(country, '')), '{t}') OR contains(lower(coalesce(make, '')), '{t}') OR contains(lower(coalesce(model, '')), '{t}')
 OR contains(lower(coalesce(make, '') || ' ' || coalesce(model, '')), '{t}') OR photo_id IN (SELECT photo_id FROM faces JOIN clusters USING (cluster_id) WHERE photo_id IS NOT NULL AND contains(lower(name), '{t}')) OR photo_id IN (SELECT photo_id FROM inferred JOIN clusters USING (cluster_id) WHERE photo_id IS NOT NULL AND contains(lower(name), '{t}'))"""


def _hits(L: Library, text: str) -> DataFrame:
    return text_hits(L.live(), L.faces(), L.inferred(), L.clusters(), text).select("photo_id")


q("PF09", _ARMS.format(t="an"), lambda L: _hits(L, "an"))
q("PF09_person", _ARMS.format(t="son 1"), lambda L: _hits(L, "son 1"))
q("PF09_camera", _ARMS.format(t="n h"), lambda L: _hits(L, "n h"))


_BUSY = "busy AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS r FROM faces WHERE cluster_id IS NOT NULL GROUP BY cluster_id)"


def _busy(L: Library, n: int) -> DataFrame:
    f = L.faces().where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return f.orderBy(col("n").desc(), "cluster_id").limit(n).select("cluster_id")


@add("PF10", "SELECT l.photo_id FROM live l WHERE EXISTS (SELECT 1 FROM identities i JOIN busy b ON b.cluster_id = i.cluster_id AND b.r = 1 WHERE i.photo_id = l.photo_id)", _BUSY)
def _pf10(L: Library) -> DataFrame:
    return L.live().join(L.identities().join(F.broadcast(_busy(L, 1)), "cluster_id"), "photo_id", "left_semi").select("photo_id")


@add("PF11", """SELECT l.photo_id FROM live l WHERE EXISTS (SELECT 1 FROM identities i JOIN busy b ON b.cluster_id = i.cluster_id AND b.r <= 50 WHERE i.photo_id = l.photo_id)
  AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = l.photo_id AND (f.cluster_id IS NULL OR f.cluster_id NOT IN (SELECT cluster_id FROM busy WHERE r <= 50)))
  AND NOT EXISTS (SELECT 1 FROM inferred i WHERE i.photo_id = l.photo_id AND i.cluster_id NOT IN (SELECT cluster_id FROM busy WHERE r <= 50))""", _BUSY)  # fmt: skip
def _pf11(L: Library) -> DataFrame:
    who = F.broadcast(_busy(L, 50))
    other_faces = L.faces().select("photo_id", "cluster_id").join(who, "cluster_id", "left_anti")  # unknown faces count as others
    other = other_faces.select("photo_id").unionByName(L.inferred().join(who, "cluster_id", "left_anti").select("photo_id"))
    return L.live().join(L.identities().join(who, "cluster_id"), "photo_id", "left_semi").join(other, "photo_id", "left_anti").select("photo_id")


q("PF12", "SELECT photo_id FROM live l WHERE EXISTS (SELECT 1 FROM album_photos a WHERE a.photo_id = l.photo_id AND a.album LIKE 'S%')", lambda L: L.live().join(L.album_photos().where(col("album").startswith("S")), "photo_id", "left_semi").select("photo_id"))
q("PF13", "SELECT photo_id FROM live WHERE (country = 'Kestria' OR country = 'Hestria') AND (city LIKE 'F%' OR city LIKE 'M%')", lambda L: L.live().where(col("country").isin("Kestria", "Hestria") & (col("city").startswith("F") | col("city").startswith("M"))).select("photo_id"))
q("PF14", "SELECT photo_id, file_name FROM ph WHERE photo_id IN (SELECT cover_photo_id FROM suggestions)", lambda L: L.photos().join(L.suggestions().select(col("cover_photo_id").alias("photo_id")).where("photo_id is not null").distinct(), "photo_id", "left_semi").select("photo_id", "file_name"))
_IDS = "ids AS (SELECT DISTINCT s.id, CAST(unnest(CAST(try_cast(s.photo_ids_json AS JSON) AS BIGINT[])) AS BIGINT) AS photo_id FROM suggestions s WHERE try_cast(s.photo_ids_json AS JSON) IS NOT NULL)"


def suggested(L: Library) -> DataFrame:
    """(id, photo_id) of the suggestions' JSON arrays."""
    return L.suggestions().select("id", F.explode(F.from_json("photo_ids_json", "array<bigint>")).alias("photo_id")).where("photo_id is not null").distinct()


q("PF15", "SELECT photo_id FROM live WHERE photo_id NOT IN (SELECT photo_id FROM ids)", lambda L: L.live().join(suggested(L), "photo_id", "left_anti").select("photo_id"), _IDS)
q("PF16", "SELECT photo_id FROM live WHERE strftime(taken, '%m-%d') IN ('06-12', '06-13', '06-14', '06-15', '06-16', '06-17', '06-18') AND taken < TIMESTAMP '2025-03-17'", lambda L: L.live().where(X.month_day_window("taken", "2025-06-15", 3) & (col("taken") < F.lit("2025-03-17").cast("timestamp_ntz"))).select("photo_id"))
q("PF17", "SELECT photo_id FROM live WHERE NOT starts_with(lower(file_name), 'img_00') AND NOT coalesce(taken > TIMESTAMP '2025-06-15', false)", lambda L: L.live().where(~F.lower("file_name").startswith("img_00") & ~F.coalesce(col("taken") > F.lit("2025-06-15").cast("timestamp_ntz"), F.lit(False))).select("photo_id"))
q("PF18", "SELECT face_id FROM faces WHERE cluster_id IS NOT NULL AND CAST(cluster_id AS VARCHAR) NOT IN (SELECT CAST(cluster_id AS VARCHAR) FROM clusters WHERE cluster_id % 5 = 0)", lambda L: L.faces().where("cluster_id is not null").withColumn("k", col("cluster_id").cast("string")).join(L.clusters().where("cluster_id % 5 = 0").select(col("cluster_id").cast("string").alias("k")), "k", "left_anti").select("face_id"))
q("PF19", "SELECT photo_id FROM live l WHERE NOT EXISTS (SELECT 1 FROM live o WHERE o.file_hash = l.file_hash AND o.photo_id < l.photo_id)", lambda L: L.live().join(X.non_covers(L.live()), "photo_id", "left_anti").select("photo_id"))
q("PF20", "SELECT photo_id FROM ph WHERE file_path = 'Trips' OR starts_with(file_path, 'Trips/')", lambda L: L.photos().where(X.under("file_path", "Trips")).select("photo_id"))
q("PF21", "SELECT photo_id FROM ph WHERE lower(file_path) LIKE '%.mp4' OR lower(file_path) LIKE '%.heic'", lambda L: L.photos().where(F.lower("file_path").endswith(".mp4") | F.lower("file_path").endswith(".heic")).select("photo_id"))
_LIST = "listing AS (SELECT file_path, file_size + CASE WHEN photo_id % 13 = 0 THEN 1 ELSE 0 END AS size, mtime + CASE photo_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3600 WHEN 2 THEN 7 WHEN 3 THEN 0 WHEN 4 THEN 57600 ELSE -1 END AS mtime FROM ph WHERE photo_id % 10 <> 0)"


def listing(L: Library) -> DataFrame:
    """A later file listing of the library: some files changed, some gone."""
    step = F.element_at(F.array(*map(F.lit, (2, 3600, 7, 0, 57600, -1))), (col("photo_id") % 6 + 1).cast("int"))
    return L.photos().where("photo_id % 10 <> 0").select("file_path", (col("file_size") + F.when(col("photo_id") % 13 == 0, 1).otherwise(0)).alias("size"), (col("mtime") + step).alias("mtime"))


_SAME = "(n.size IS NOT DISTINCT FROM p.file_size AND (abs(n.mtime - p.mtime) <= 2 OR (abs(n.mtime - p.mtime) % 900 = 0 AND abs(n.mtime - p.mtime) <= 50400)))"
q("PF22", f"SELECT p.photo_id FROM ph p JOIN listing n ON n.file_path = p.file_path WHERE coalesce({_SAME}, false)", lambda L: L.photos().join(listing(L).withColumnRenamed("mtime", "new_mtime"), "file_path").where(X.unchanged("file_size", "size", "mtime", "new_mtime")).select("photo_id"), _LIST)
q("PF23", "SELECT count(*) FILTER (WHERE n.file_path IS NULL) AS missing, count(*) AS active, count(*) FILTER (WHERE n.file_path IS NULL) >= 25 AND 5 * count(*) FILTER (WHERE n.file_path IS NULL) > count(*) AS refused FROM live p LEFT JOIN listing n ON n.file_path = p.file_path", lambda L: X.mass_removal(L.live().join(listing(L).select("file_path", F.lit(True).alias("there")), "file_path", "left")), _LIST)
q("PF24", "SELECT face_id FROM faces WHERE user_confirmed = 1", lambda L: X.by_status(L.faces(), "confirmed").select("face_id"))
q("PF24_unconfirmed", "SELECT face_id FROM faces WHERE user_confirmed = 0", lambda L: X.by_status(L.faces(), "unconfirmed").select("face_id"))
q("PF25", "SELECT face_id FROM faces WHERE area >= 900 AND confidence >= 0.55 AND face_id * 31 % 120 >= 40 AND abs(face_id * 17 % 90 - 45) <= 35", lambda L: X.good_faces(L.faces().withColumns({"blur": col("face_id") * 31 % 120, "yaw": col("face_id") * 17 % 90 - 45})).select("face_id"))
q("PF26", "SELECT photo_id FROM live WHERE CAST(width AS BIGINT) * height >= 300000 AND (photo_id % 100)::DOUBLE / 100 BETWEEN 0.1 AND 0.92", lambda L: L.live().where((col("width").cast("long") * col("height") >= 300_000) & ((col("photo_id") % 100).cast("double") / 100).between(0.1, 0.92)).select("photo_id"))
q("PF27", "SELECT photo_id, nullif(trim(make), '') AS make, nullif(trim(model), '') AS model FROM ph", lambda L: L.photos().select("photo_id", X.cleaned("make"), X.cleaned("model")))

# Joins
q("JN01", "SELECT f.face_id, c.name, p.city FROM faces f JOIN clusters c ON c.cluster_id = f.cluster_id JOIN live p ON p.photo_id = f.photo_id", lambda L: L.faces().join(L.clusters(), "cluster_id").join(L.live().select("photo_id", "city"), "photo_id").select("face_id", "name", "city"))
q("JN02", "SELECT a.album, count(p.photo_id) AS n, min(p.taken) AS first_taken, max(p.taken) AS last_taken FROM (SELECT DISTINCT album FROM album_photos) a LEFT JOIN album_photos ap ON ap.album = a.album LEFT JOIN live p ON p.photo_id = ap.photo_id GROUP BY a.album", lambda L: L.album_photos().join(L.live().select("photo_id", "taken", col("photo_id").alias("live_id")), "photo_id", "left").groupBy("album").agg(F.count("live_id").alias("n"), F.min("taken").alias("first_taken"), F.max("taken").alias("last_taken")))
q("JN03", "SELECT g.file_hash, count(l.photo_id) AS n FROM (SELECT file_hash FROM ph GROUP BY file_hash HAVING count(*) > 1) g LEFT JOIN live l ON l.file_hash = g.file_hash GROUP BY g.file_hash", lambda L: L.photos().groupBy("file_hash").agg(F.count("*").alias("all"), F.count_if(~col("trashed")).alias("n")).where((col("all") > 1) & col("file_hash").isNotNull()).select("file_hash", "n"))
_ST = "members AS (SELECT photo_id, file_hash AS stack, min(photo_id) OVER (PARTITION BY file_hash) AS cover, count(*) OVER (PARTITION BY file_hash) AS n FROM live WHERE file_hash IS NOT NULL), stacks AS (SELECT * FROM members WHERE n > 1)"


def stacks(L: Library) -> DataFrame:
    """(photo_id, stack, cover, n): photos of one file; the smallest id covers."""
    g = L.live().where("file_hash is not null").groupBy(col("file_hash").alias("stack")).agg(F.min("photo_id").alias("cover"), F.count("*").alias("n")).where("n > 1")
    return L.live().select("photo_id", col("file_hash").alias("stack")).join(g, "stack")


q("JN04", "SELECT l.photo_id, s.stack, s.n FROM live l LEFT JOIN stacks s ON s.photo_id = l.photo_id WHERE s.stack IS NULL OR s.cover = l.photo_id", lambda L: L.live().select("photo_id").join(stacks(L), "photo_id", "left").where(col("stack").isNull() | (col("cover") == col("photo_id"))).select("photo_id", "stack", "n"), _ST)
q("JN05", "SELECT photo_id FROM live WHERE photo_id IN (SELECT photo_id FROM faces)", lambda L: L.live().join(L.faces(), "photo_id", "left_semi").select("photo_id"))
q("JN06", "SELECT photo_id FROM live l WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = l.photo_id)", lambda L: L.live().join(L.faces(), "photo_id", "left_anti").select("photo_id"))
q("JN07", "SELECT cluster_id FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM faces WHERE user_confirmed = 1 AND cluster_id IS NOT NULL)", lambda L: L.clusters().join(L.faces().where("user_confirmed = 1"), "cluster_id", "left_anti").select("cluster_id"))


@add("JN08", "SELECT a.cluster_id AS a, b.cluster_id AS b, count(DISTINCT a.photo_id) AS n FROM identities a JOIN identities b ON a.photo_id = b.photo_id AND a.cluster_id < b.cluster_id GROUP BY ALL")
def _jn08(L: Library) -> DataFrame:
    i = L.identities()
    a, b = i.select("photo_id", col("cluster_id").alias("a")), i.select("photo_id", col("cluster_id").alias("b"))
    return a.join(b, "photo_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))  # identities are distinct


q("JN09", "SELECT file_path FROM later WHERE file_path NOT IN (SELECT file_path FROM ph)", lambda L: X.later(L).join(L.photos(), "file_path", "left_anti").select("file_path"), "later AS (SELECT CASE WHEN photo_id % 10 = 1 THEN 'moved/' || file_path ELSE file_path END AS file_path, file_size AS size, mtime, file_hash FROM ph WHERE photo_id % 10 <> 0)")
q("JN10", "SELECT p.photo_id FROM ph p JOIN listing n ON n.file_path = p.file_path WHERE n.size IS DISTINCT FROM p.file_size OR n.mtime IS DISTINCT FROM p.mtime", lambda L: L.photos().join(listing(L).withColumnRenamed("mtime", "new_mtime"), "file_path").where(~col("size").eqNullSafe(col("file_size")) | ~col("new_mtime").eqNullSafe(col("mtime"))).select("photo_id"), _LIST)
q("JN17", "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], z.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(z.embedding::DOUBLE[], z.embedding::DOUBLE[]))), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z ORDER BY score DESC, vec_id LIMIT 20", lambda L: X.nearest_to(L.table("embeddings"), "vec_id", "embedding", 0, 20))
_LG = "ledger AS (SELECT i.content_hash, min(p.file_path) AS file_path FROM items i JOIN ph p ON p.file_hash = i.content_hash GROUP BY i.content_hash)"


def ledger(L: Library) -> DataFrame:
    """(content_hash, file_path): the imported files at the paths of the library that have their content."""
    p = L.photos().select(col("file_hash").alias("content_hash"), "file_path")
    return L.items().select("content_hash").join(p, "content_hash").groupBy("content_hash").agg(F.min("file_path").alias("file_path"))


q("JN18", "SELECT p.photo_id, i.content_hash, a.album FROM ledger i JOIN ph p ON p.file_path = i.file_path LEFT JOIN (SELECT DISTINCT lower(trim(content_hash)) AS h, album_name AS album FROM google_takeout_albums) a ON a.h = i.content_hash", lambda L: ledger(L).join(L.photos().select("photo_id", "file_path"), "file_path").join(L.table("google_takeout_albums").select(F.lower(F.trim("content_hash")).alias("content_hash"), col("album_name").alias("album")).distinct(), "content_hash", "left").select("photo_id", "content_hash", "album"), _LG)
q("JN19", "SELECT l.photo_id, (SELECT count(*) FROM faces f WHERE f.photo_id = l.photo_id) AS n_faces, (SELECT max(area) FROM faces f WHERE f.photo_id = l.photo_id) AS largest, (SELECT min(album) FROM album_photos a WHERE a.photo_id = l.photo_id) AS album FROM live l", lambda L: L.live().select("photo_id").join(L.faces().groupBy("photo_id").agg(F.count("*").alias("n"), F.max("area").alias("largest")), "photo_id", "left").join(L.album_photos().groupBy("photo_id").agg(F.min("album").alias("album")), "photo_id", "left").select("photo_id", F.coalesce("n", F.lit(0)).alias("n_faces"), "largest", "album"))
_NEXT = "next AS (SELECT cluster_id FROM faces WHERE cluster_id IS NOT NULL AND user_confirmed = 0 GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1)"
q("JN20", "SELECT face_id, cluster_id FROM faces WHERE user_confirmed = 0 AND cluster_id IN (SELECT cluster_id FROM next)", lambda L: X.next_review(L.faces()), _NEXT)
q("FC15", "SELECT cluster_id FROM next", lambda L: X.next_review(L.faces()).select("cluster_id").distinct(), _NEXT)
q("JN21", "SELECT * FROM (SELECT photo_id, lag(photo_id) OVER w AS prev_id, lead(photo_id) OVER w AS next_id FROM live WINDOW w AS (ORDER BY taken DESC NULLS LAST, photo_id DESC)) WHERE photo_id = (SELECT max(photo_id) FROM live WHERE taken IS NOT NULL)", lambda L: T.neighbours(L.live()).join(F.broadcast(L.live().where("taken is not null").agg(F.max("photo_id").alias("photo_id"))), "photo_id"))

# Windows
_Y = "year(taken)::INTEGER AS year"
q("WN01", f"SELECT * FROM (SELECT photo_id, {_Y}, row_number() OVER (PARTITION BY year(taken) ORDER BY taken DESC, photo_id DESC) AS rn FROM live WHERE taken IS NOT NULL) WHERE rn <= 500", lambda L: T.top_per_group(L.live().where("taken is not null").select("photo_id", F.year("taken").alias("year"), "taken"), ["year"], [col("taken").desc(), col("photo_id").desc()], 500).drop("taken"))
q("WN02", f"SELECT {_Y}, count(*) AS total FROM live WHERE month(taken) = 6 GROUP BY 1 HAVING count(*) >= 5", lambda L: L.live().where(F.month("taken") == 6).groupBy(F.year("taken").alias("year")).agg(F.count("*").alias("total")).where("total >= 5"))
q("WN03", f"SELECT * FROM (SELECT i.cluster_id, {_Y}, l.photo_id, row_number() OVER (PARTITION BY i.cluster_id, year(taken) ORDER BY favorite DESC, taken DESC, l.photo_id DESC) AS rn FROM identities i JOIN live l ON l.photo_id = i.photo_id WHERE taken IS NOT NULL) WHERE rn <= 8", lambda L: T.top_per_group(L.identities().join(L.live().where("taken is not null"), "photo_id").select("cluster_id", F.year("taken").alias("year"), "photo_id", "favorite", "taken"), ["cluster_id", "year"], [col("favorite").desc(), col("taken").desc(), col("photo_id").desc()], 8).drop("favorite", "taken"))
q("WN04", f"SELECT * FROM (SELECT city, {_Y}, photo_id, row_number() OVER (PARTITION BY city, year(taken) ORDER BY favorite DESC, taken DESC, photo_id DESC) AS rn FROM live WHERE taken IS NOT NULL AND city IS NOT NULL) WHERE rn <= 8", lambda L: T.top_per_group(L.live().where("taken is not null and city is not null").select("city", F.year("taken").alias("year"), "photo_id", "favorite", "taken"), ["city", "year"], [col("favorite").desc(), col("taken").desc(), col("photo_id").desc()], 8).drop("favorite", "taken"))
q("WN05", "SELECT day, photo_id, rn FROM (SELECT taken::DATE AS day, photo_id, row_number() OVER (PARTITION BY taken::DATE ORDER BY md5(photo_id || ':7'), photo_id) AS rn FROM live WHERE taken IS NOT NULL) WHERE rn <= 8", lambda L: T.top_per_group(L.live().where("taken is not null").select(F.to_date("taken").alias("day"), "photo_id"), ["day"], [F.md5(F.concat_ws(":", col("photo_id").cast("string"), F.lit("7")).cast("binary")), col("photo_id")], 8))
q("WN06", "SELECT * FROM (SELECT cluster_id, face_id, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, face_id) AS rn FROM faces WHERE cluster_id IS NOT NULL) WHERE rn <= 5", lambda L: T.top_per_group(L.faces().where("cluster_id is not null").select("cluster_id", "face_id", "confidence"), ["cluster_id"], [col("confidence").desc(), col("face_id")], 5).drop("confidence"))
q("FC16", "SELECT cluster_id, face_id FROM (SELECT cluster_id, face_id, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, face_id) AS rn FROM faces WHERE cluster_id IS NOT NULL AND user_confirmed >= 0) WHERE rn <= 3", lambda L: T.top_per_group(L.faces().where("cluster_id is not null and user_confirmed >= 0"), ["cluster_id"], [col("confidence").desc(), col("face_id")], 3).select("cluster_id", "face_id"))
q("WN07", "SELECT day, n, CAST(sum(n) OVER w - n AS BIGINT) AS start_index, CAST(sum(n) OVER w AS BIGINT) AS end_index FROM (SELECT CAST(taken AS DATE) AS day, count(*) AS n FROM live GROUP BY 1) WINDOW w AS (ORDER BY day DESC NULLS LAST ROWS UNBOUNDED PRECEDING)", lambda L: T.day_ranges(L.live()))
q("WN08", "SELECT photo_id, lag(photo_id) OVER w AS prev_id, lead(photo_id) OVER w AS next_id FROM live WINDOW w AS (ORDER BY taken DESC NULLS LAST, photo_id DESC)", lambda L: T.neighbours(L.live()))
_GAP = "SELECT photo_id, folder, sum(CASE WHEN gap IS NULL OR gap > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY taken, photo_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT photo_id, taken, regexp_replace(file_path, '/[^/]*$', '') AS folder, epoch(taken - lag(taken) OVER (PARTITION BY regexp_replace(file_path, '/[^/]*$', '') ORDER BY taken, photo_id)) AS gap FROM live WHERE taken IS NOT NULL)"


@add("WN09", _GAP)
def _wn09(L: Library) -> DataFrame:
    p = L.live().where("taken is not null").select("photo_id", "taken", X.folder("file_path").alias("folder"))
    return gap_islands(p, ["folder"], 14400).select("photo_id", "folder", "island")


_SC = "sem AS (SELECT photo_id, max(score) AS score FROM candidates GROUP BY photo_id), ranked AS (SELECT photo_id, row_number() OVER (ORDER BY score DESC, photo_id) AS rank FROM sem ORDER BY rank LIMIT 300)"


def _ranked(L: Library) -> DataFrame:
    s = L.candidates().groupBy("photo_id").agg(F.max("score").alias("score"))
    s = s.orderBy(col("score").desc(), "photo_id").limit(300)
    return s.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(col("score").desc(), "photo_id")).cast("long")).select("photo_id", "rank")  # 300 rows


q("WN10", "SELECT l.photo_id, r.rank FROM live l LEFT JOIN ranked r ON r.photo_id = l.photo_id", lambda L: L.live().select("photo_id").join(_ranked(L), "photo_id", "left"), _SC)

# Pages
q("SL01", f"SELECT photo_id, taken FROM live {_ORDER} LIMIT 200", lambda L: T.page(L.live(), 200).select("photo_id", "taken"))
q("SL02", f"SELECT photo_id FROM live WHERE taken IS NULL OR taken < {_AT} OR (taken = {_AT} AND photo_id < 500) {_ORDER} LIMIT 100", lambda L: T.page(L.live(), 100, (AT, 500)).select("photo_id"))
q("SL02_favorites", f"SELECT photo_id FROM live WHERE favorite {_ORDER} LIMIT 100", lambda L: T.page(L.live().where("favorite"), 100).select("photo_id"))
q("SL02_album", f"SELECT l.photo_id FROM live l WHERE photo_id IN (SELECT photo_id FROM album_photos WHERE album = 'Camera roll') {_ORDER} LIMIT 100", lambda L: T.page(L.live().join(L.album_photos().where("album = 'Camera roll'"), "photo_id", "left_semi"), 100).select("photo_id"))
q("SL02_person", f"SELECT photo_id FROM live WHERE photo_id IN (SELECT photo_id FROM identities i JOIN busy b ON b.cluster_id = i.cluster_id AND b.r = 1) {_ORDER} LIMIT 100", lambda L: T.page(L.live().join(L.identities().join(F.broadcast(_busy(L, 1)), "cluster_id"), "photo_id", "left_semi"), 100).select("photo_id"), _BUSY)
q("SL02_stacked", f"SELECT l.photo_id FROM live l LEFT JOIN stacks s ON s.photo_id = l.photo_id WHERE s.stack IS NULL OR s.cover = l.photo_id {_ORDER.replace('photo_id', 'l.photo_id')} LIMIT 100", lambda L: T.page(L.live().join(stacks(L).where("cover <> photo_id"), "photo_id", "left_anti"), 100).select("photo_id"), _ST)
q("SL03", f"SELECT photo_id FROM live {_ORDER} LIMIT 50 OFFSET 100", lambda L: T.in_order(L.live()).offset(100).limit(50).select("photo_id"))
q("SL04", f"SELECT photo_id, (SELECT count(*) FROM live) > 40 AS has_more FROM live {_ORDER} LIMIT 40", lambda L: T.page_with_more(L.live(), 40).select("photo_id", "has_more"))
q("SL05", "SELECT photo_id, rtrim(replace(replace(to_base64(encode(coalesce(strftime(taken, '%Y-%m-%dT%H:%M:%S'), '') || '|' || photo_id)), '+', '-'), '/', '_'), '=') AS cursor FROM live", lambda L: L.live().select("photo_id", X.cursor("taken", "photo_id").alias("cursor")))
q("SL06", "SELECT l.photo_id, r.rank FROM live l LEFT JOIN ranked r ON r.photo_id = l.photo_id ORDER BY rank NULLS LAST, taken DESC NULLS LAST, l.photo_id DESC LIMIT 400", lambda L: L.live().join(_ranked(L), "photo_id", "left").orderBy(col("rank").asc_nulls_last(), col("taken").desc_nulls_last(), col("photo_id").desc()).limit(400).select("photo_id", "rank"), _SC)
q("SL07", SQL["JN17"][SQL["JN17"].index("SELECT e.vec_id") :].replace("LIMIT 20", "LIMIT 10"), lambda L: X.nearest_to(L.table("embeddings"), "vec_id", "embedding", 0, 10))
_REL = "scored AS (SELECT vec_id, score - 0.3 AS score FROM (SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], z.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(z.embedding::DOUBLE[], z.embedding::DOUBLE[]))), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z WHERE e.vec_id <> 0))"
q("SL08", "SELECT vec_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER () AS top FROM scored) WHERE top >= 0.06 AND score >= greatest(0.06, top - 0.02, 0.75 * top) ORDER BY score DESC, vec_id LIMIT 80", lambda L: X.relevant(X.nearest_to(L.table("embeddings").where("vec_id >= 0"), "vec_id", "embedding", 0, 1_000_000).where("vec_id <> 0").withColumn("score", col("score") - 0.3), "vec_id").select("vec_id", F.round("score", 6).alias("score")), _REL)
q("SL09", "SELECT id, photo_id, trashed_at FROM bin WHERE photo_id IS NOT NULL ORDER BY trashed_at DESC NULLS LAST, photo_id DESC, id DESC LIMIT 100", lambda L: L.trash().where("photo_id is not null").orderBy(col("trashed_at").desc_nulls_last(), col("photo_id").desc(), col("id").desc()).limit(100).select("id", "photo_id", "trashed_at"))
q("SL10", "SELECT face_id FROM faces WHERE cluster_id IS NULL AND face_id > 100 ORDER BY face_id LIMIT 100", lambda L: L.faces().where("cluster_id is null and face_id > 100").orderBy("face_id").limit(100).select("face_id"))
q("SL11", "SELECT photo_id FROM (SELECT photo_id, row_number() OVER (ORDER BY photo_id) - 1 AS i, count(*) OVER () AS n FROM live WHERE favorite) WHERE floor(((i + 1) * 50 + n - 1) // n) > floor((i * 50 + n - 1) // n) OR n <= 50", lambda L: X.thinned(L.live().where("favorite").select("photo_id"), "photo_id", 50))
q("SL12", "SELECT album FROM (SELECT album, row_number() OVER (ORDER BY album) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT album FROM album_photos)) WHERE i = 166 % n", lambda L: X.rotated(L.album_photos().select("album").distinct(), "album", 166))
_COV = "SELECT s.id, (SELECT p.photo_id FROM ids i JOIN live p ON p.photo_id = i.photo_id WHERE i.id = s.id ORDER BY p.media_type = 'photo' DESC, p.favorite DESC, p.width > p.height DESC NULLS LAST, p.taken DESC NULLS LAST, p.photo_id DESC LIMIT 1) AS cover FROM suggestions s"


@add("SL13", _COV, _IDS)
def _sl13(L: Library) -> DataFrame:
    key = F.struct((col("media_type") == "photo"), "favorite", (col("width") > col("height")), col("taken").isNotNull(), "taken", "photo_id")
    best = suggested(L).join(L.live(), "photo_id").groupBy("id").agg(F.max_by("photo_id", key).alias("cover"))
    return L.suggestions().select("id").join(best, "id", "left")


q("SL14", "SELECT photo_id FROM live WHERE favorite AND media_type = 'photo' ORDER BY coalesce(width > height, false) DESC, taken DESC NULLS LAST, photo_id DESC LIMIT 1", lambda L: L.live().where("favorite and media_type = 'photo'").orderBy(F.coalesce(col("width") > col("height"), F.lit(False)).desc(), col("taken").desc_nulls_last(), col("photo_id").desc()).limit(1).select("photo_id"))
q("SL15", "SELECT u.pos, p.photo_id, p.file_name FROM (SELECT unnest([1030, 1005, 1005, 1002, 9999999, 1001, 1013]) AS id, generate_subscripts([1030, 1005, 1005, 1002, 9999999, 1001, 1013], 1) AS pos) u JOIN ph p ON p.photo_id = u.id WHERE u.pos <> 3", lambda L: X.in_given_order(L.photos(), "photo_id", [1030, 1005, 1005, 1002, 9999999, 1001, 1013]).select("pos", "photo_id", "file_name"))
q("SL16", "SELECT file_hash, n, bytes FROM (SELECT file_hash, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM live WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1) ORDER BY bytes DESC NULLS LAST, file_hash LIMIT 20 OFFSET 10", lambda L: L.live().where("file_hash is not null").groupBy("file_hash").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")).where("n > 1").orderBy(col("bytes").desc_nulls_last(), "file_hash").offset(10).limit(20))

# Sets
q("SO01", "SELECT photo_id, cluster_id FROM identities", lambda L: L.identities())
q("SO02", "SELECT photo_id FROM identities i JOIN busy b ON b.cluster_id = i.cluster_id AND b.r = 1 INTERSECT SELECT photo_id FROM identities i JOIN busy b ON b.cluster_id = i.cluster_id AND b.r BETWEEN 2 AND 40", lambda L: L.identities().join(_busy(L, 1), "cluster_id").select("photo_id").intersect(L.identities().join(_busy(L, 40).subtract(_busy(L, 1)), "cluster_id").select("photo_id")), _BUSY)
q("SO03", "SELECT * FROM (VALUES ('favorites', 1::BIGINT), ('recent', 2::BIGINT)) v(kind, pos)", lambda L: L.spark.range(1, 2).select(F.lit("favorites").alias("kind"), col("id").alias("pos")).unionByName(L.spark.range(2, 3).select(F.lit("recent").alias("kind"), col("id").alias("pos"))))
q("SO04", "SELECT photo_id FROM live WHERE (country = 'Kestria' OR favorite) AND photo_id NOT IN (SELECT photo_id FROM faces)", lambda L: L.live().where("country = 'Kestria'").select("photo_id").union(L.live().where("favorite").select("photo_id")).distinct().join(L.faces(), "photo_id", "left_anti"))
q("SO05", "SELECT file_hash FROM ph WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1 EXCEPT SELECT file_hash FROM live WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1", lambda L: L.photos().where("file_hash is not null").groupBy("file_hash").count().where("count > 1").select("file_hash").join(L.live().groupBy("file_hash").count().where("count > 1"), "file_hash", "left_anti"))
q("SO06", "SELECT ascii_name FROM cities WHERE ascii_name IS NOT NULL EXCEPT SELECT city FROM ph", lambda L: L.cities().select("ascii_name").where("ascii_name is not null").subtract(L.photos().select("city")))

"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X
from shutterlake.functions.cameras import friendly_name
from shutterlake.operators import insights as I
from shutterlake.operators.segments import gap_islands
from shutterlake.plans.timeline import _IDS, _LIST, _ST, listing, stacks, suggested
from shutterlake.sources.library import Library, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col


def q(name: str, text: str | None, f, more: str = "") -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, d: f(Library(spark, d))
    if text:
        SQL[name] = sql(text, more)


q("AG01", "SELECT count(*) FILTER (WHERE NOT trashed) AS live, count(*) FILTER (WHERE NOT trashed AND taken IS NULL) AS no_date, count(*) FILTER (WHERE NOT trashed AND lat IS NULL) AS no_place, count(*) FILTER (WHERE NOT trashed AND width IS NULL) AS no_size FROM ph", lambda L: L.photos().agg(F.count_if(~col("trashed")).alias("live"), *(F.count_if(~col("trashed") & col(c).isNull()).alias(n) for c, n in (("taken", "no_date"), ("lat", "no_place"), ("width", "no_size")))))
q("AG02", "SELECT count(*) AS n FROM live WHERE photo_id NOT IN (SELECT photo_id FROM stacks WHERE cover <> photo_id)", lambda L: L.live().join(stacks(L).where("cover <> photo_id"), "photo_id", "left_anti").agg(F.count("*").alias("n")), _ST)
q("AG03", "SELECT year(taken)::INTEGER AS year, count(*) AS n FROM live GROUP BY 1", lambda L: I.year_counts(L.live()))
q("AG04", "SELECT CAST(taken AS DATE) AS day, count(*) AS n FROM live WHERE year(taken) = (SELECT max(year(taken)) FROM live) GROUP BY 1", lambda L: I.heat_map(L.live()))
q("AG04_year", "SELECT CAST(taken AS DATE) AS day, count(*) AS n FROM live WHERE year(taken) = 2021 GROUP BY 1", lambda L: I.heat_map(L.live(), 2021))
q("AG05", "SELECT m.month, count(l.photo_id) AS n FROM (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN live l ON month(l.taken) = m.month GROUP BY 1", lambda L: I.months(L.live()))
q("AG06", "SELECT strftime(taken, '%Y-%m') AS month, count(*) AS n FROM live WHERE taken IS NOT NULL GROUP BY 1", lambda L: L.live().where("taken is not null").groupBy(F.date_format("taken", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")))
q("AG07", "SELECT DISTINCT year(taken)::INTEGER AS year FROM live WHERE taken IS NOT NULL", lambda L: L.live().where("taken is not null").select(F.year("taken").alias("year")).distinct())
q("AG08", "SELECT count(*) AS n, count(*) FILTER (WHERE media_type = 'video') AS videos, count(*) FILTER (WHERE favorite) AS favorites, min(taken) AS first_taken, max(taken) AS last_taken FROM live", lambda L: I.totals(L.live()))
q("AG09", "SELECT (SELECT count(DISTINCT cluster_id) FROM identities WHERE photo_id IN (SELECT photo_id FROM live)) AS people, (SELECT count(DISTINCT album) FROM album_photos WHERE photo_id IN (SELECT photo_id FROM live)) AS albums", lambda L: L.identities().join(L.live(), "photo_id", "left_semi").agg(F.countDistinct("cluster_id").alias("people")).crossJoin(L.album_photos().join(L.live(), "photo_id", "left_semi").agg(F.countDistinct("album").alias("albums"))))
q("AG10", "SELECT count(DISTINCT country) AS countries, count(DISTINCT CASE WHEN city IS NOT NULL THEN city || chr(31) || coalesce(country, '') END) AS cities, count(lat) AS located FROM live", lambda L: I.places(L.live()))
q("AG11", "SELECT c.name, count(DISTINCT i.photo_id) AS n FROM identities i JOIN clusters c ON c.cluster_id = i.cluster_id JOIN live l ON l.photo_id = i.photo_id WHERE c.name IS NOT NULL GROUP BY c.name ORDER BY n DESC, name LIMIT 10", lambda L: L.identities().join(L.clusters().where("name is not null"), "cluster_id").join(L.live(), "photo_id", "left_semi").groupBy("name").agg(F.countDistinct("photo_id").alias("n")).orderBy(col("n").desc(), "name").limit(10))
q("AG12", "SELECT city, country, count(*) AS n FROM live WHERE city IS NOT NULL AND country IS NOT NULL GROUP BY ALL ORDER BY n DESC, city, country LIMIT 30", lambda L: I.top(L.live(), ["city", "country"], 30))
q("AG12_countries", "SELECT country, count(*) AS n FROM live WHERE country IS NOT NULL GROUP BY ALL ORDER BY n DESC, country LIMIT 20", lambda L: I.top(L.live(), ["country"], 20))
_CAM = """cam AS (SELECT nullif(trim(trim(trim(replace(make, chr(0), '')), '"')), '') AS m, nullif(trim(trim(trim(replace(model, chr(0), '')), '"')), '') AS d FROM live),
cased AS (SELECT *, CASE WHEN contains(d, ' ') AND d <> upper(d) AND d <> lower(d) THEN d WHEN NOT contains(d, ' ') THEN upper(d) ELSE array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split_regex(d, '\\s+') IF w <> ''], ' ') END AS c FROM cam),
named AS (SELECT CASE WHEN d IS NULL THEN m WHEN m IS NULL OR starts_with(lower(d), lower(m)) THEN c ELSE m || ' ' || c END AS name FROM cased)"""
q("AG13", "SELECT name, count(*) AS n FROM named WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 3", lambda L: I.top(_named(L), ["name"], 3), _CAM)
q("AG13_names", "SELECT name, count(*) AS n FROM named WHERE name IS NOT NULL GROUP BY name", lambda L: _named(L).where("name is not null").groupBy("name").agg(F.count("*").alias("n")), _CAM)


def _named(L: Library) -> DataFrame:
    return L.live().withColumn("name", friendly_name(col("make"), col("model")))


q("AG14", "SELECT (SELECT count(*) FROM live) AS photos, (SELECT count(DISTINCT cluster_id) FROM faces) AS people, (SELECT count(DISTINCT country) FROM live) AS countries, (SELECT count(DISTINCT year(taken)) FROM live) AS years, (SELECT count(*) FROM live WHERE favorite) AS favorites", lambda L: L.live().agg(F.count("*").alias("photos"), F.countDistinct("country").alias("countries"), F.countDistinct(F.year("taken")).alias("years"), F.count_if("favorite").alias("favorites")).crossJoin(L.faces().agg(F.countDistinct("cluster_id").alias("people"))).select("photos", "people", "countries", "years", "favorites"))
q("AG15", "SELECT a.album, count(*) AS n, min(taken) AS first_taken, max(taken) AS last_taken FROM album_photos a JOIN live l ON l.photo_id = a.photo_id GROUP BY a.album", lambda L: L.album_photos().join(L.live(), "photo_id").groupBy("album").agg(F.count("*").alias("n"), F.min("taken").alias("first_taken"), F.max("taken").alias("last_taken")))
q("AG16", "SELECT count(*) AS n, (SELECT photo_id FROM live WHERE favorite ORDER BY taken DESC NULLS LAST, photo_id DESC LIMIT 1) AS cover, min(taken) AS first_taken, max(taken) AS last_taken FROM live WHERE favorite", lambda L: L.live().where("favorite").agg(F.count("*").alias("n"), F.max_by("photo_id", F.struct(col("taken").isNotNull(), "taken", "photo_id")).alias("cover"), F.min("taken").alias("first_taken"), F.max("taken").alias("last_taken")))
q("AG17", "SELECT CAST(coalesce(sum(s - m), 0) AS BIGINT) AS wasted FROM (SELECT sum(file_size) AS s, max(file_size) AS m FROM live WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1)", lambda L: I.wasted_bytes(L.live()))
q("AG18", "SELECT stack, cover, count(*) AS n FROM stacks GROUP BY ALL", lambda L: stacks(L).groupBy("stack", "cover").agg(F.count("*").alias("n")), _ST)
_BU = "seq AS (SELECT photo_id, taken, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM live WHERE taken IS NOT NULL), gaps AS (SELECT *, CASE WHEN epoch(taken - lag(taken) OVER w) <= 600 THEN 0 ELSE 1 END AS s FROM seq WINDOW w AS (PARTITION BY folder ORDER BY taken, photo_id)), runs AS (SELECT *, sum(s) OVER (PARTITION BY folder ORDER BY taken, photo_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)"


def runs(L: Library, gap: int = 600) -> DataFrame:
    """Photos of a folder in runs without a gap of more than ``gap`` seconds."""
    p = L.live().where("taken is not null").select("photo_id", "taken", X.folder("file_path").alias("folder"))
    return gap_islands(p, ["folder"], gap, name="run")


q("AG19", "SELECT folder, min(photo_id) AS first_id, count(*) AS n FROM runs GROUP BY folder, run HAVING count(*) > 1", lambda L: runs(L).groupBy("folder", "run").agg(F.min("photo_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("run"), _BU)
q("AG20", "SELECT file_size, count(*) AS n FROM live WHERE file_size IS NOT NULL GROUP BY file_size HAVING count(*) > 1", lambda L: L.live().where("file_size is not null").groupBy("file_size").agg(F.count("*").alias("n")).where("n > 1"))
q("AG21", "SELECT f.cluster_id, count(*) AS faces, (SELECT count(DISTINCT photo_id) FROM identities i WHERE i.cluster_id = f.cluster_id) AS photos, arg_max(face_id, (confidence, -face_id)) AS best FROM faces f WHERE f.cluster_id IS NOT NULL GROUP BY f.cluster_id", lambda L: L.faces().where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("faces"), F.max_by("face_id", F.struct("confidence", -col("face_id"))).alias("best")).join(L.identities().groupBy("cluster_id").agg(F.count("*").alias("photos")), "cluster_id", "left").select("cluster_id", "faces", F.coalesce("photos", F.lit(0)).alias("photos"), "best"))
q("AG22", "SELECT count(*) AS faces, count(DISTINCT cluster_id) AS people FROM faces WHERE user_confirmed = 0", lambda L: L.faces().where("user_confirmed = 0").agg(F.count("*").alias("faces"), F.countDistinct("cluster_id").alias("people")))
_HOME = "home AS (SELECT city, country, count(DISTINCT strftime(taken, '%Y-%W')) AS weeks, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM live WHERE taken IS NOT NULL AND city IS NOT NULL AND lat IS NOT NULL GROUP BY city, country ORDER BY weeks DESC, city, country LIMIT 1)"
q("AG23", "SELECT city, country, weeks FROM home", lambda L: I.home_city(L.live()).select("city", "country", "weeks"), _HOME)
q("AG24", "SELECT city, country, round(avg(lat) + 1e-7::DOUBLE, 3) AS lat, round(avg(lon) + 1e-7::DOUBLE, 3) AS lon FROM live WHERE city IS NOT NULL AND lat IS NOT NULL GROUP BY ALL", lambda L: L.live().where("city is not null and lat is not null").groupBy("city", "country").agg(F.round(F.avg("lat") + 1e-7, 3).alias("lat"), F.round(F.avg("lon") + 1e-7, 3).alias("lon")))
q("AG25", "SELECT city, country, round(count(DISTINCT strftime(taken, '%Y-%W'))::DOUBLE / (SELECT count(DISTINCT strftime(taken, '%Y-%W')) FROM live WHERE taken IS NOT NULL), 6) AS rarity FROM live WHERE taken IS NOT NULL AND city IS NOT NULL GROUP BY city, country", lambda L: L.live().where("taken is not null and city is not null").groupBy("city", "country").agg(F.countDistinct(X.year_week("taken")).alias("w")).crossJoin(F.broadcast(L.live().where("taken is not null").agg(F.countDistinct(X.year_week("taken")).alias("all")))).select("city", "country", F.round(col("w").cast("double") / col("all"), 6).alias("rarity")))
q("AG26", "SELECT count(*) AS n, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM ph WHERE trashed", lambda L: L.photos().where("trashed").agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")))
q("AG27", "SELECT count(*) FILTER (WHERE taken IS NULL) AS undated, count(*) FILTER (WHERE lat IS NULL) AS unplaced, count(*) FILTER (WHERE lat IS NOT NULL AND city IS NULL) AS ungeocoded, count(*) FILTER (WHERE width IS NULL) AS unsized, count(*) FILTER (WHERE lower(file_name) LIKE '%.heic') AS heic, count(*) FILTER (WHERE file_path NOT IN (SELECT file_path FROM listing)) AS missing_files FROM live", lambda L: L.live().join(listing(L).select("file_path", F.lit(True).alias("there")), "file_path", "left").agg(F.count_if(col("taken").isNull()).alias("undated"), F.count_if(col("lat").isNull()).alias("unplaced"), F.count_if(col("lat").isNotNull() & col("city").isNull()).alias("ungeocoded"), F.count_if(col("width").isNull()).alias("unsized"), F.count_if(F.lower("file_name").endswith(".heic")).alias("heic"), F.count_if(col("there").isNull()).alias("missing_files")), _LIST)
q("AG28", "SELECT count(DISTINCT c.face_id) FILTER (WHERE len(embedding) = 64) AS indexed, count(DISTINCT c.face_id) FILTER (WHERE len(embedding) <> 64) AS failed, greatest(count(DISTINCT c.face_id) - count(DISTINCT c.face_id) FILTER (WHERE embedding IS NOT NULL), 0) AS pending FROM cluster_input c", lambda L: L.table("cluster_input").groupBy("face_id").agg(F.max(F.size("embedding")).alias("n")).agg(F.count_if(col("n") == 64).alias("indexed"), F.count_if((col("n") != 64) & (col("n") >= 0)).alias("failed"), F.count_if(col("n").isNull() | (col("n") < 0)).alias("pending")))
q("AG29", "SELECT photo_id, string_agg(DISTINCT CAST(cluster_id AS VARCHAR), ',' ORDER BY CAST(cluster_id AS VARCHAR)) AS people FROM identities GROUP BY photo_id", lambda L: L.identities().groupBy("photo_id").agg(F.array_join(F.array_sort(F.collect_set(col("cluster_id").cast("string"))), ",").alias("people")))
q("AG30", "SELECT sha256(concat_ws(':', count(*), max(photo_id), CAST(sum(CASE WHEN favorite THEN 1 ELSE 0 END) AS BIGINT), (SELECT count(*) FROM identities))) AS fingerprint FROM live", lambda L: L.live().agg(F.count("*").alias("n"), F.max("photo_id").alias("m"), F.count_if("favorite").alias("f")).crossJoin(L.identities().agg(F.count("*").alias("i"))).select(F.sha2(F.concat_ws(":", "n", "m", "f", "i"), 256).alias("fingerprint")))
q("AG31", "SELECT city, country, count(*) AS n FROM live WHERE city IS NOT NULL AND country IS NOT NULL AND contains(lower(city), 'br') GROUP BY ALL ORDER BY n DESC, city, country LIMIT 10", lambda L: I.top(L.live().where(F.lower("city").contains("br")), ["city", "country"], 10))
q("AG32", "SELECT CAST(taken AS DATE) AS day, count(*) AS n, arg_min(city, (taken, photo_id)) FILTER (WHERE city IS NOT NULL) AS city FROM live GROUP BY 1", lambda L: L.live().groupBy(F.to_date("taken").alias("day")).agg(F.count("*").alias("n"), F.min_by("city", F.when(col("city").isNotNull(), F.struct(col("taken"), col("photo_id")))).alias("city")))


def story_facts(L: Library, folder: str) -> DataFrame:
    """Facts of the photos under a folder: span, places with their first visit, people."""
    p = L.live().where(X.under("file_path", folder))
    span = p.agg(F.count("*").alias("n"), F.min("taken").alias("first_taken"), F.max("taken").alias("last_taken"), F.round(F.avg("lat"), 4).alias("lat"))
    place = p.where("city is not null").groupBy("city", "country").agg(F.count("*").alias("c"), F.min("taken").alias("first_visit"))
    best = place.orderBy(col("c").desc(), "city", "country").limit(1).select(col("city").alias("main_city"), "first_visit")
    people = p.join(L.identities(), "photo_id").agg(F.countDistinct("cluster_id").alias("people"))
    return span.join(best, how="left").crossJoin(people)


q("AG33", "SELECT s.*, b.main_city, b.first_visit, p.people FROM (SELECT count(*) AS n, min(taken) AS first_taken, max(taken) AS last_taken, round(avg(lat), 4) AS lat FROM live WHERE file_path = 'Trips' OR starts_with(file_path, 'Trips/')) s LEFT JOIN (SELECT city AS main_city, min(taken) AS first_visit FROM live WHERE (file_path = 'Trips' OR starts_with(file_path, 'Trips/')) AND city IS NOT NULL GROUP BY city, country ORDER BY count(*) DESC, city, country LIMIT 1) b ON true CROSS JOIN (SELECT count(DISTINCT cluster_id) AS people FROM identities WHERE photo_id IN (SELECT photo_id FROM live WHERE file_path = 'Trips' OR starts_with(file_path, 'Trips/'))) p", lambda L: story_facts(L, "Trips"))
q("AG34", "SELECT a.album, count(*) AS n FROM album_photos a JOIN live l ON l.photo_id = a.photo_id GROUP BY a.album HAVING count(*) >= 3", lambda L: L.album_photos().join(L.live(), "photo_id", "left_semi").groupBy("album").agg(F.count("*").alias("n")).where("n >= 3"))
q("TS10", "SELECT i.id, i.photo_id FROM ids i JOIN live l ON l.photo_id = i.photo_id WHERE i.photo_id NOT IN (SELECT photo_id FROM stacks WHERE cover <> photo_id)", lambda L: suggested(L).join(L.live(), "photo_id", "left_semi").join(stacks(L).where("cover <> photo_id"), "photo_id", "left_anti").select("id", "photo_id"), f"{_ST}, {_IDS}")

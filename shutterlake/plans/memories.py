"""Memory, collage and story queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X
from shutterlake.operators import grouping as G
from shutterlake.operators import insights as I
from shutterlake.operators import memories as M
from shutterlake.plans.groups import photo_hashes
from shutterlake.plans.insights import _HOME, runs
from shutterlake.plans.timeline import _IDS, suggested
from shutterlake.sources.library import Library, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col
TODAY = date(2025, 6, 15)
_OLD = "taken < TIMESTAMP '2025-03-17'"
_OR = "taken DESC, photo_id DESC"


def q(name: str, text: str | None, f, more: str = "") -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, d: f(Library(spark, d))
    if text:
        SQL[name] = sql(text, more)


def dated(L: Library) -> DataFrame:
    return L.live().where("taken is not null")


def _years(inner: str, n: int) -> str:
    return f"SELECT * FROM ({inner}) WHERE year IN (SELECT DISTINCT year FROM ({inner}) ORDER BY year DESC LIMIT {n})"


def _per(where: str, order: str, n: int) -> str:
    return f"SELECT * FROM (SELECT year(taken)::INTEGER AS year, photo_id, row_number() OVER (PARTITION BY year(taken) ORDER BY {order}) AS rn FROM live WHERE {where}) WHERE rn <= {n}"


q("MM01", _years(_per(f"{_OLD} AND strftime(taken, '%m-%d') = '06-15'", _OR, 500), 10), lambda L: M.on_this_day(dated(L), TODAY))
_NEAR = "('06-12', '06-13', '06-14', '06-15', '06-16', '06-17', '06-18')"
_BARE = "bare AS (SELECT * FROM live WHERE strftime(taken, '%m-%d') <> '06-15')"  # a library with no photo of the day itself
q("MM02", _years(_per(f"{_OLD} AND strftime(taken, '%m-%d') IN {_NEAR}", _OR, 500), 10).replace("FROM live", "FROM bare"), lambda L: M.around_this_day(dated(L).where(F.date_format("taken", "MM-dd") != "06-15"), TODAY), _BARE)
q("MM03", _years(_per(f"{_OLD} AND month(taken) = 6 AND year(taken) IN (SELECT year(taken) FROM live WHERE {_OLD} AND month(taken) = 6 GROUP BY 1 HAVING count(*) >= 5)", _OR, 500), 5), lambda L: M.seasonal(dated(L), TODAY))
_ST = """t8 AS (SELECT {k} AS k, photo_id, taken, year(taken) AS year FROM (SELECT *, row_number() OVER (PARTITION BY {k}, year(taken) ORDER BY favorite DESC, taken DESC, photo_id DESC) AS rn FROM {src}) WHERE rn <= 8),
ok AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM (SELECT k FROM t8 GROUP BY k HAVING count(DISTINCT year) >= 3 AND count(*) >= 9))"""
_PS = "src AS (SELECT l.*, i.cluster_id FROM live l JOIN identities i USING (photo_id) WHERE taken IS NOT NULL AND i.cluster_id % 5 <> 0), " + _ST.format(k="cluster_id", src="src")
_PICK = "SELECT k AS {k}, photo_id FROM t8 WHERE k = (SELECT k FROM ok WHERE i = {turn} % n) ORDER BY taken DESC, photo_id DESC LIMIT 24"


def _people_story(L: Library) -> DataFrame:
    """Photos of a person of three years; blocked people (every fifth here) have no stories."""
    return M.story_candidates(dated(L), L.identities().where("cluster_id % 5 <> 0"), "cluster_id")


q("MM04", _PICK.format(k="cluster_id", turn=165), lambda L: M.chosen_story(_people_story(L), "cluster_id", TODAY.timetuple().tm_yday - 1), _PS)
_CS = f"{_HOME}, src AS (SELECT * FROM live WHERE taken IS NOT NULL AND city IS NOT NULL AND city <> (SELECT city FROM home)), " + _ST.format(k="city", src="src")


def _place_story(L: Library) -> DataFrame:
    home = I.home_city(L.live()).select("city")
    return M.story_candidates(dated(L).join(F.broadcast(home), "city", "left_anti"), None, "city")


q("MM05", _PICK.format(k="city", turn=55), lambda L: M.chosen_story(_place_story(L), "city", (TODAY.timetuple().tm_yday - 1) // 3), _CS)
q("MM06", _years(_per(_OLD, "favorite DESC, taken DESC, photo_id DESC", 50), 5), lambda L: M.year_recap(dated(L), TODAY))
_HERO = "hs AS (SELECT i.id, l.photo_id, l.taken, n, CASE WHEN orientation IN (1, 3) AND width >= height AND width > 0 THEN 3 ELSE 0 END + CASE WHEN coalesce(n, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(n, 0) >= 2 THEN 1 ELSE 0 END AS s FROM ids i JOIN live l USING (photo_id) LEFT JOIN (SELECT photo_id, count(*) AS n FROM faces GROUP BY photo_id) f ON f.photo_id = l.photo_id), hero AS (SELECT id, arg_max(photo_id, (s, -photo_id)) AS hero, bool_or(coalesce(n, 0) > 0) AS has_faces, count(*) AS k, max(year(taken))::INTEGER AS year FROM hs GROUP BY id)"
q("MM07", "SELECT id, hero, has_faces FROM hero", lambda L: M.heroes(suggested(L), L.live(), L.faces(), "id"), f"{_IDS}, {_HERO}")


def _ranked(L: Library) -> DataFrame:
    s = suggested(L)
    h = M.heroes(s, L.live(), L.faces(), "id")
    n = s.join(L.live(), "photo_id").groupBy("id").agg(F.count("*").alias("n"), F.max(F.year("taken")).alias("year"))
    k = L.suggestions().select("id", F.when(col("kind") == "trip", "place").otherwise(col("kind")).alias("kind"))
    j = h.join(n, "id").join(k, "id").where("year is not null")
    return j.select("id", F.round(M.rank_score("n", "year", "has_faces", "kind", TODAY), 6).alias("score"))


q("MM08", "SELECT h.id, round(log2(k + 1.0::DOUBLE) * sqrt(greatest(2025 - year, 0) + 1.0::DOUBLE) * CASE WHEN has_faces THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN s.kind = 'trip' THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM hero h JOIN suggestions s ON s.id = h.id WHERE year IS NOT NULL", _ranked, f"{_IDS}, {_HERO}")
q("MM09", "SELECT id FROM ids LEFT JOIN (SELECT DISTINCT photo_id AS b FROM faces WHERE cluster_id % 5 = 0) x ON x.b = ids.photo_id GROUP BY id HAVING count(b) * 2 <= count(*)", lambda L: M.without_blocked(suggested(L), L.faces(), L.clusters().where("cluster_id % 5 = 0").select("cluster_id"), "id"), _IDS)
q("MM10", "SELECT coalesce(min(taken) <= TIMESTAMP '2025-03-17', false) AS old_enough FROM live", lambda L: L.live().agg(F.coalesce(F.min("taken") <= X.ts("2025-03-17"), F.lit(False)).alias("old_enough")))
q("MM11", None, lambda L: M.surprise(_hashed(L), TODAY, 7))


def _hashed(L: Library) -> DataFrame:
    """Dated photos with their hash and their group of look-alikes."""
    h = photo_hashes(L)
    g = G.near_groups(h, "photo_id").select("photo_id", "group_key")
    return dated(L).join(h, "photo_id", "left").join(g, "photo_id", "left")


_CO = """fc AS (SELECT photo_id, count(*) AS n, max(area)::DOUBLE / 1000000 AS largest FROM faces GROUP BY photo_id),
cp AS (SELECT photo_id, row_number() OVER (PARTITION BY file_hash ORDER BY photo_id) > 1 AS second FROM live WHERE file_hash IS NOT NULL),
co AS (SELECT l.photo_id, 1.0::DOUBLE + CASE WHEN favorite THEN 3.0 ELSE 0 END + CASE WHEN coalesce(n, 0) > 0 THEN 1.2 ELSE 0 END + CASE WHEN coalesce(largest, 0) >= 0.01 THEN 0.6 ELSE 0 END + CASE WHEN coalesce(n, 0) BETWEEN 2 AND 5 THEN 0.3 ELSE 0 END
 - CASE WHEN NOT ((l.photo_id % 100)::DOUBLE / 100 BETWEEN 0.18 AND 0.85) THEN 0.6 ELSE 0 END - CASE WHEN greatest(width, height)::DOUBLE / nullif(least(width, height), 0) > 2.4 THEN 1.5 ELSE 0 END - CASE WHEN coalesce(second, false) THEN 0.8 ELSE 0 END AS score
 FROM live l LEFT JOIN fc ON fc.photo_id = l.photo_id LEFT JOIN cp ON cp.photo_id = l.photo_id)"""


def _collage_scores(L: Library) -> DataFrame:
    f = L.faces().groupBy("photo_id").agg(F.count("*").alias("n"), (F.max("area").cast("double") / 1_000_000).alias("largest"))
    p = L.live().join(f, "photo_id", "left").join(X.non_covers(L.live()).withColumn("second", F.lit(True)), "photo_id", "left").withColumn("second", F.coalesce("second", F.lit(False)))
    p = p.withColumn("brightness", (col("photo_id") % 100).cast("double") / 100).withColumn("no", F.lit(False))
    return p.withColumn("score", F.round(M.collage_score("n", "largest", "brightness", "no", "second"), 6))


q("MM12", "SELECT photo_id, round(score, 6) AS score FROM co", lambda L: _collage_scores(L).select("photo_id", "score"), _CO)


def _pools(L: Library) -> DataFrame:
    b = runs(L).groupBy("folder", "run").agg(F.min("photo_id").alias("burst"), F.collect_set("photo_id").alias("m")).select("burst", F.explode("m").alias("photo_id"))
    p = _collage_scores(L).join(b, "photo_id", "left").join(photo_hashes(L), "photo_id", "left")
    p = p.select("photo_id", X.seconds("taken").alias("t"), "score", "file_hash", "phash", "burst")
    return suggested(L).withColumnRenamed("id", "key").join(p, "photo_id")


q("MM13", None, lambda L: M.collages(_pools(L)))
_SRC = """mem AS (SELECT '2025-06-15' AS key WHERE EXISTS (SELECT 1 FROM live WHERE taken < TIMESTAMP '2025-03-17' AND strftime(taken, '%m-%d') = '06-15')), sug AS (SELECT id::VARCHAR AS key, row_number() OVER (ORDER BY id::VARCHAR) - 1 AS i, count(*) OVER () AS n FROM suggestions WHERE status = 'pending'),
alb AS (SELECT album AS key, row_number() OVER (ORDER BY album) - 1 AS i, count(*) OVER () AS n FROM (SELECT album FROM album_photos JOIN live USING (photo_id) GROUP BY album HAVING count(DISTINCT photo_id) >= 3))"""
q("MM14", "SELECT row_number() OVER (ORDER BY p) AS pos, kind, key FROM (SELECT 0 AS p, 'memory' AS kind, key FROM mem UNION ALL SELECT 1, 'suggestion', key FROM sug WHERE i = 741315 % n UNION ALL SELECT 2, 'album', key FROM alb WHERE i = 370657 % n)", lambda L: _collage_sources(L), _SRC)


def _collage_sources(L: Library) -> DataFrame:
    memory = M.on_this_day(dated(L), TODAY).select(F.lit(TODAY.isoformat()).alias("key"))
    pending = L.suggestions().where("status = 'pending'").select(col("id").alias("key"))
    albums = L.album_photos().join(L.live().select("photo_id"), "photo_id").groupBy(col("album").alias("key")).agg(F.countDistinct("photo_id").alias("n")).where("n >= 3")
    return M.collage_suggestions(memory, pending, albums, TODAY)


_SF = """sp AS (SELECT i.id, l.* FROM ids i JOIN live l USING (photo_id) WHERE taken IS NOT NULL), sb AS (SELECT id, min(taken) AS start, max(taken) AS "end", count(*) AS n, count(DISTINCT city) AS places FROM sp GROUP BY id),
sm AS (SELECT id, arg_max(city, (c, city)) AS main, max(c) AS mc FROM (SELECT id, city, count(*) AS c FROM sp WHERE city IS NOT NULL GROUP BY ALL) GROUP BY id),
sw AS (SELECT id, name, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, name) AS rn FROM (SELECT sp.id, c.name, count(DISTINCT sp.photo_id) AS c FROM sp JOIN identities USING (photo_id) JOIN clusters c USING (cluster_id) WHERE c.name IS NOT NULL GROUP BY ALL) JOIN sb USING (id) WHERE c >= n * 0.3),
s2 AS (SELECT id, string_agg(name, ' and ' ORDER BY rn) AS people FROM sw WHERE rn <= 2 GROUP BY id)"""
q("MM15", 'SELECT sb.id, sb.start, sb."end", sb.n, sb.places, CASE WHEN mc * 2 >= n THEN main END AS main_place, people FROM sb LEFT JOIN sm USING (id) LEFT JOIN s2 USING (id)', lambda L: M.story_facts(suggested(L), L.live(), L.identities(), L.clusters(), "id").drop("lat"), f"{_IDS}, {_SF}")
_TT = f"""{_IDS}, {_SF}, {_HOME}, ap AS (SELECT id, city, coalesce(country, '') AS country, count(*) AS c, min(taken) AS first, bool_or(true) AS one FROM sp WHERE city IS NOT NULL GROUP BY ALL),
aw AS (SELECT ap.*, coalesce(ap.city <> h.city OR ap.country <> coalesce(h.country, ''), true) AS away, coalesce(h.country, '') AS hn FROM ap LEFT JOIN home h ON true),
st AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first, city, country) AS i, count(*) OVER (PARTITION BY id) AS k FROM (SELECT * FROM aw QUALIFY away OR NOT bool_or(away) OVER (PARTITION BY id))),
mn AS (SELECT id, arg_max(city, (c, first, city)) AS main, arg_max(country, (c, first, city)) AS mcountry, max(k) AS k, max(city) FILTER (WHERE i = 1) AS c1, max(city) FILTER (WHERE i = 2) AS c2, max(city) FILTER (WHERE i = 3) AS c3, max(city) FILTER (WHERE i = k) AS cl,
  max(country) FILTER (WHERE i = 1) AS land, count(DISTINCT nullif(country, '')) AS nc, max(nullif(country, '')) AS onec, max(hn) AS hn FROM st GROUP BY id),
fx AS (SELECT sb.*, start::DATE AS d1, "end"::DATE AS d2, date_diff('day', start::DATE, "end"::DATE) + 1 AS days, people, mn.* EXCLUDE (id), coalesce(main, 'somewhere new') AS w, (SELECT avg(lat) FROM sp WHERE sp.id = sb.id) AS lat,
  (SELECT min(taken) FROM live WHERE live.country = mn.land) AS lf, (SELECT min(taken) FROM live WHERE live.city = mn.main AND coalesce(live.country, '') = mn.mcountry) AS tf FROM sb LEFT JOIN mn USING (id) LEFT JOIN s2 USING (id)),
hol AS (SELECT *, (make_date(year(d1), 12, 25) BETWEEN d1 AND d2 OR make_date(year(d2), 12, 25) BETWEEN d1 AND d2 OR year(d2) - year(d1) > 1) AS xm, (make_date(year(d1), 12, 31) BETWEEN d1 AND d2 OR make_date(year(d2), 1, 1) BETWEEN d1 AND d2 OR make_date(year(d1), 1, 1) BETWEEN d1 AND d2 OR make_date(year(d2), 12, 31) BETWEEN d1 AND d2 OR year(d2) - year(d1) > 1) AS ny FROM fx)"""
_NUM = "CASE WHEN {n} BETWEEN 0 AND 12 THEN (['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'])[({n} + 1)::INTEGER] ELSE ({n})::BIGINT::VARCHAR END"
_DUR = f"CASE WHEN days <= 1 THEN 'one day' WHEN days <= 6 THEN {_NUM.format(n='days')} || ' days' WHEN days <= 10 THEN 'a week' WHEN days <= 17 THEN 'two weeks' ELSE {_NUM.format(n='((days + 3) // 7)')} || ' weeks' END"
q("MM15_titles", f"""SELECT id, CASE WHEN xm AND ny THEN 'The holidays in ' || w WHEN xm THEN 'Christmas in ' || w WHEN ny THEN 'New Year in ' || w WHEN people IS NOT NULL THEN w || ' with ' || people
 WHEN k = 2 THEN c1 || ' to ' || cl WHEN k = 3 THEN c1 || ', ' || c2 || ' and ' || c3 WHEN k > 3 AND nc = 1 THEN 'Across ' || onec WHEN k > 3 THEN c1 || ' to ' || cl
 WHEN land <> '' AND land IS DISTINCT FROM hn AND lf >= start THEN 'First time in ' || land WHEN tf < d1 - INTERVAL 30 DAY THEN 'Back in ' || w WHEN days BETWEEN 2 AND 3 AND dayofweek(d1) IN (5, 6) AND dayofweek(d2) IN (6, 0, 1) THEN 'A weekend in ' || w
 WHEN abs(lat) < 23.5 THEN strftime(start, '%B') || ' in ' || w WHEN lat IS NOT NULL THEN (['Winter', 'Spring', 'Summer', 'Autumn'])[1 + (CASE WHEN lat < 0 THEN (month(start) % 12 // 3 + 2) % 4 ELSE month(start) % 12 // 3 END)::INTEGER] || ' in ' || w
 ELSE upper(({_DUR})[1]) || ({_DUR})[2:] || ' in ' || w END AS title FROM hol""", lambda L: M.trip_titles(suggested(L), L.live(), L.identities(), L.clusters(), I.home_city(L.live()), "id"), _TT)
q("MM16", """SELECT photo_id, CASE WHEN hour(taken) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(taken) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(taken) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS part,
 CASE WHEN abs(lat) < 23.5 THEN strftime(taken, '%B') ELSE (['Winter', 'Spring', 'Summer', 'Autumn'])[1 + (CASE WHEN lat < 0 THEN (month(taken) % 12 // 3 + 2) % 4 ELSE month(taken) % 12 // 3 END)::INTEGER] END AS season,
 CASE strftime(taken, '%m-%d') WHEN '12-24' THEN 'Christmas Eve' WHEN '12-25' THEN 'Christmas Day' WHEN '12-31' THEN 'New Year''s Eve' WHEN '01-01' THEN 'New Year''s Day' END AS holiday
 FROM live WHERE taken IS NOT NULL""", lambda L: dated(L).select("photo_id", M.day_part("taken").alias("part"), M.season("taken", col("lat")).alias("season"), M.holiday("taken").alias("holiday")))  # fmt: skip
_M2 = "(2025 - year(taken)) * 12 + 6 - month(taken) - CASE WHEN 15 < day(taken) THEN 1 ELSE 0 END"
q("MM16_labels", f"""SELECT photo_id, CASE WHEN taken::DATE >= DATE '2025-06-15' OR {_M2} <= 0 THEN 'Recent' WHEN {_M2} = 1 THEN '1 month ago' WHEN {_M2} < 12 THEN ({_M2}) || ' months ago' WHEN ({_M2}) // 12 = 1 THEN '1 year ago' ELSE (({_M2}) // 12) || ' years ago' END AS age,
 CASE WHEN taken::DATE = DATE '2025-06-15' THEN 'Today' WHEN taken::DATE = DATE '2025-06-14' THEN 'Yesterday' WHEN year(taken) = 2025 THEN strftime(taken, '%B %d') ELSE strftime(taken, '%B %d, %Y') END AS day FROM live WHERE taken IS NOT NULL""", lambda L: dated(L).select("photo_id", M.age_label("taken", TODAY).alias("age"), M.day_label("taken", TODAY).alias("day")))  # fmt: skip
q("MM17", "SELECT c.id, c.city, count(*) AS visits, count(DISTINCT year(p.taken)) AS years, max(p.taken) AS last FROM (SELECT DISTINCT id, city FROM sp WHERE city IS NOT NULL) c JOIN sb USING (id) JOIN live p ON p.city = c.city AND p.taken < sb.start - INTERVAL 30 DAY GROUP BY ALL", lambda L: M.earlier_visits(suggested(L), L.live(), "id"), f"{_IDS}, {_SF}")

"""Duplicate, segment, spatial and remaining join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X
from shutterlake.operators import grouping as G
from shutterlake.operators import insights as I
from shutterlake.operators import segments as S
from shutterlake.operators import spatial as P
from shutterlake.plans.insights import _BU, _HOME

from shutterlake.session import written
from shutterlake.sources.library import Library, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col


def q(name: str, text: str | None, f, more: str = "") -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, d: f(Library(spark, d))
    if text:
        SQL[name] = sql(text, more)


# Duplicates
def sized(L: Library) -> DataFrame:
    """Live photos; files of one content have one size, the smallest recorded."""
    least = L.live().where("file_hash is not null").groupBy("file_hash").agg(F.min("file_size").alias("_s"))
    return L.live().join(least, "file_hash", "left").withColumn("file_size", F.when(col("file_hash").isNull(), col("file_size")).otherwise(col("_s"))).drop("_s")


_EX = "sized AS (SELECT * REPLACE (CASE WHEN file_hash IS NULL THEN file_size ELSE min(file_size) OVER (PARTITION BY file_hash) END AS file_size) FROM live), exact AS (SELECT * FROM sized WHERE file_size IS NOT NULL AND file_hash IN (SELECT file_hash FROM sized WHERE file_hash IS NOT NULL AND file_size IN (SELECT file_size FROM sized WHERE file_hash IS NOT NULL AND file_size IS NOT NULL GROUP BY file_size HAVING count(*) > 1) GROUP BY file_hash HAVING count(*) > 1))"
q("SG01", "SELECT file_hash, photo_id FROM exact", lambda L: G.exact_groups(sized(L)).select("file_hash", "photo_id"), _EX)
_PEN = " + ".join(f"100 * CAST(list_contains(string_split_regex(lower(file_path), '[^a-z0-9]+'), '{w}') AS INTEGER)" for w in G.BAD_WORDS)
q("SG02", f"SELECT file_hash, photo_id AS keep FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY {_PEN}, file_size DESC, length(file_path), taken NULLS LAST, file_path, photo_id) AS rn FROM exact) WHERE rn = 1", lambda L: G.keep_suggestions(G.exact_groups(sized(L))), _EX)
_HASH = "u AS (SELECT face_id, list_sum([CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END FOR i IN range(64)]) AS u FROM (SELECT face_id, any_value(embedding) AS embedding FROM cluster_input GROUP BY face_id) WHERE len(embedding) = 64), hashes AS (SELECT face_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS phash FROM u)"


def hashes(L: Library) -> DataFrame:
    """(face_id, phash): the signs of each face's embedding play the role of a picture's 64-bit hash."""
    c = L.vectors().select("face_id", "embedding").where(F.size("embedding") == 64)
    return c.select("face_id", G.sign_hash("embedding").alias("phash"))


_PAIRS = f"{_HASH}, dh AS (SELECT DISTINCT phash FROM hashes), pairs AS (SELECT x.phash AS a, y.phash AS b FROM dh x JOIN dh y ON x.phash < y.phash AND bit_count(xor(x.phash, y.phash)) <= 4)"
q("SG03", "SELECT face_id, phash FROM hashes", lambda L: hashes(L), _HASH)
q("JN14", "SELECT a, b FROM pairs", lambda L: G.near_pairs(hashes(L).select("phash").distinct()), _PAIRS)
_CC = f"{_PAIRS}, e2 AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT phash AS n, phash AS l FROM dh UNION SELECT e2.b, reach.l FROM reach JOIN e2 ON e2.a = reach.n), comp AS (SELECT n, min(l) AS group_key FROM reach GROUP BY n)"
q("SG04", "SELECT face_id, phash, group_key FROM (SELECT h.face_id, h.phash, c.group_key, count(*) OVER (PARTITION BY c.group_key) AS k FROM hashes h JOIN comp c ON c.n = h.phash) WHERE k > 1", lambda L: G.near_groups(hashes(L), "face_id"), _CC)
q("SG12", "SELECT n AS node, group_key AS label FROM comp WHERE n IN (SELECT a FROM e2)", lambda L: G.components(G.near_pairs(hashes(L).select("phash").distinct())), _CC)
_OLD = "oldg AS (SELECT file_hash FROM ph WHERE file_hash IS NOT NULL AND photo_id % 3 <> 0 GROUP BY file_hash HAVING count(*) > 1), newg AS (SELECT DISTINCT file_hash FROM exact)"


def _stored(L: Library) -> DataFrame:
    """Groups as an earlier detection stored them."""
    return L.photos().where("file_hash is not null and photo_id % 3 <> 0").groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1").select("file_hash")


q("SG06", "SELECT coalesce(o.file_hash, n.file_hash) AS file_hash, CASE WHEN o.file_hash IS NULL THEN 'new' WHEN n.file_hash IS NULL THEN 'stale' ELSE 'kept' END AS action FROM oldg o FULL JOIN newg n ON n.file_hash = o.file_hash", lambda L: G.synced(_stored(L), G.exact_groups(sized(L)).select("file_hash"), "file_hash"), f"{_EX}, {_OLD}")
_R2 = f"{_BU}, sets AS (SELECT folder, run, count(*) AS n, sha256(array_to_string(list_sort(list(photo_id))::VARCHAR[], ',')) AS set_key FROM runs GROUP BY folder, run HAVING count(*) > 1)"


def _runs(L: Library) -> DataFrame:
    p = L.live().withColumn("folder", X.folder("file_path")).select("folder", "photo_id", "taken")
    return S.gap_islands(p, ["folder"], 600, name="run")


def _sets(L: Library) -> DataFrame:
    r = _runs(L)
    big = r.groupBy("folder", "run").agg(F.count("*").alias("n")).where("n > 1").select("folder", "run")
    return G.member_set_key(r.join(big, ["folder", "run"], "left_semi"), ["folder", "run"], "photo_id")


q("SG07", "SELECT set_key FROM sets", lambda L: _sets(L).select("set_key"), _R2)
q("SG08", "SELECT folder, arg_min(photo_id, (taken, photo_id)) AS best, count(*) AS n FROM runs GROUP BY folder, run HAVING count(*) > 1", lambda L: _runs(L).groupBy("folder", "run").agg(F.min_by("photo_id", F.struct("taken", "photo_id")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("run"), _BU)
_CL = f"""{_EX}, {_BU}, {_CC}, c1 AS (SELECT file_hash AS g, photo_id FROM exact),
k1 AS (SELECT g, photo_id FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM c1) WHERE k > 1),
pp AS (SELECT f.photo_id, arg_min(h.phash, f.face_id) AS phash FROM faces f JOIN hashes h USING (face_id) JOIN live l ON l.photo_id = f.photo_id GROUP BY f.photo_id),
own AS (SELECT a, b FROM e2 WHERE a IN (SELECT phash FROM pp) AND b IN (SELECT phash FROM pp)),
far AS (SELECT phash AS n, phash AS l FROM (SELECT DISTINCT phash FROM pp) UNION SELECT own.b, far.l FROM far JOIN own ON own.a = far.n), comp2 AS (SELECT n, min(l) AS group_key FROM far GROUP BY n),
cp AS (SELECT CAST(c.group_key AS VARCHAR) AS g, photo_id FROM pp JOIN comp2 c ON c.n = pp.phash WHERE photo_id NOT IN (SELECT photo_id FROM k1)),
kp AS (SELECT g, photo_id FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM cp) WHERE k > 1),
c2 AS (SELECT folder || ':' || run AS g, photo_id FROM runs WHERE photo_id NOT IN (SELECT photo_id FROM k1) AND photo_id NOT IN (SELECT photo_id FROM kp)),
k2 AS (SELECT g, photo_id FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM c2) WHERE k > 1)"""


def photo_hashes(L: Library) -> DataFrame:
    """(photo_id, phash): the hash of a photo's first face stands for its own."""
    return L.vectors().select("photo_id", "face_id").join(hashes(L), "face_id").groupBy("photo_id").agg(F.min_by("phash", "face_id").alias("phash"))


def _claims(L: Library) -> DataFrame:
    exact = G.exact_groups(sized(L)).select(col("file_hash").alias("group_key"), "photo_id")
    alike = G.near_groups(photo_hashes(L).join(L.live().select("photo_id"), "photo_id", "left_semi"), "photo_id").select("group_key", "photo_id")
    burst = _runs(L).select(F.concat("folder", F.lit(":"), col("run").cast("string")).alias("group_key"), "photo_id")
    return G.claimed([("exact", exact), ("perceptual", alike), ("burst", burst)])


q("SG09", "SELECT 'exact' AS kind, g AS group_key, photo_id FROM k1 UNION ALL SELECT 'perceptual', g, photo_id FROM kp UNION ALL SELECT 'burst', g, photo_id FROM k2", _claims, _CL)
_QL = "1.2 * least(coalesce(CASE WHEN width > 0 AND height > 0 THEN CAST(width AS DOUBLE) * height / 1e6 END, 0), 60) + coalesce(CASE WHEN file_size > 0 THEN least(ln(CAST(file_size AS DOUBLE)) / 20, 4) END, 0) + 2.0 * least(coalesce(n, 0), 5) + CASE WHEN keep IS NOT NULL THEN 20 ELSE 0 END + least((photo_id % 53)::DOUBLE, 40) + 8 * greatest(0, 1 - abs((photo_id % 100)::DOUBLE / 100 - 0.5) * 2)"
_SCORED = f"{_EX}, keeps AS (SELECT photo_id AS keep FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY {_PEN}, file_size DESC, length(file_path), taken NULLS LAST, file_path, photo_id) AS rn FROM exact) WHERE rn = 1), scored AS (SELECT s.*, keep, round({_QL}, 6) AS score FROM sized s LEFT JOIN (SELECT photo_id, count(*) AS n FROM faces GROUP BY photo_id) f USING (photo_id) LEFT JOIN keeps ON keep = photo_id)"


def scored(L: Library) -> DataFrame:
    """Live photos with their quality; sharpness and brightness, which pixels would give, are derived from the id."""
    p, n = sized(L), L.faces().groupBy("photo_id").agg(F.count("*").alias("n"))
    picks = G.keep_suggestions(G.exact_groups(p)).select(col("keep").alias("photo_id"), F.lit(True).alias("_p"))
    p = p.join(n, "photo_id", "left").join(picks, "photo_id", "left").withColumn("suggested", F.coalesce("_p", F.lit(False)))
    score = G.quality(F.coalesce("n", F.lit(0)), col("suggested"), (col("photo_id") % 53).cast("double"), (col("photo_id") % 100).cast("double") / 100)
    return p.withColumn("score", F.round(score, 6))


q("SG10", "SELECT photo_id, score FROM scored", lambda L: scored(L).select("photo_id", "score"), _SCORED)
_COVERS = f"{_SCORED}, best AS (SELECT file_hash, photo_id, first_value(photo_id) OVER (PARTITION BY file_hash ORDER BY score DESC, keep IS NULL, file_size DESC, photo_id) AS cover FROM scored WHERE file_hash IN (SELECT file_hash FROM exact))"


def _members(L: Library) -> DataFrame:
    """(group_key, photo_id, best) of the exact groups."""
    m = scored(L).where("file_hash is not null").withColumnRenamed("file_hash", "group_key")
    m = m.join(G.exact_groups(sized(L)).select(col("file_hash").alias("group_key")).distinct(), "group_key", "left_semi")
    return m.select("group_key", "photo_id").join(G.covers(m).withColumnRenamed("cover", "best"), "group_key")


q("SG10_covers", "SELECT DISTINCT file_hash AS group_key, cover FROM best", lambda L: _members(L).select("group_key", col("best").alias("cover")).distinct(), _COVERS)
_SY = f"{_COVERS}, oldst AS (SELECT file_hash, max(photo_id) AS cover, file_hash < '4' AS dismissed FROM ph WHERE file_hash IS NOT NULL AND photo_id % 3 <> 0 GROUP BY file_hash HAVING count(*) > 1)"
q("SG11", """SELECT b.file_hash AS group_key, CASE WHEN o.dismissed OR bool_or(b.photo_id = o.cover) THEN o.cover ELSE min(b.cover) END AS cover, CASE WHEN o.dismissed THEN 'dismissed' WHEN o.cover IS NULL THEN 'new' ELSE 'kept' END AS action
 FROM best b LEFT JOIN oldst o ON o.file_hash = b.file_hash GROUP BY b.file_hash, o.cover, o.dismissed UNION ALL SELECT file_hash, cover, CASE WHEN dismissed THEN 'dismissed' ELSE 'removed' END FROM oldst WHERE file_hash NOT IN (SELECT file_hash FROM best)""", lambda L: G.synced_stacks(_members(L), _old_stacks(L)), _SY)


def _old_stacks(L: Library) -> DataFrame:
    """(group_key, cover, dismissed) as an earlier detection and the user left them."""
    o = L.photos().where("file_hash is not null and photo_id % 3 <> 0").groupBy(col("file_hash").alias("group_key")).agg(F.max("photo_id").alias("cover"), F.count("*").alias("n"))
    return o.where("n > 1").select("group_key", "cover", (col("group_key") < "4").alias("dismissed"))


q("SG13", None, lambda L: G.sharpness(L.table("embeddings"), "vec_id", "embedding", 8))
q("SG05", "SELECT * FROM (VALUES (1::BIGINT), (2), (3), (4), (5)) v(id)", lambda L: G.near_groups(L.spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 15), (5, 255), (6, 65535)], "id long, phash long"), "id").select("id"))

# Segments
_FOLD = """b0 AS (SELECT *, row_number() OVER (PARTITION BY folder, run ORDER BY taken, photo_id) AS i, epoch(taken) AS t FROM runs),
fold AS (SELECT folder, run, i, photo_id, t AS begin, photo_id AS burst, t FROM b0 WHERE i = 1
  UNION ALL SELECT b.folder, b.run, b.i, b.photo_id, CASE WHEN b.t - f.begin > 900 THEN b.t ELSE f.begin END, CASE WHEN b.t - f.begin > 900 THEN b.photo_id ELSE f.burst END, b.t
  FROM fold f JOIN b0 b ON b.folder = f.folder AND b.run = f.run AND b.i = f.i + 1)"""
_SIM = """sig AS (SELECT photo_id, arg_min(embedding, face_id)::DOUBLE[] AS signature FROM (SELECT face_id, any_value(photo_id) AS photo_id, any_value(embedding) AS embedding FROM cluster_input GROUP BY face_id) WHERE len(embedding) = 64 AND photo_id IS NOT NULL GROUP BY photo_id),
seq AS (SELECT l.photo_id, taken, regexp_replace(file_path, '/[^/]*$', '') AS folder, signature FROM live l LEFT JOIN sig USING (photo_id) WHERE taken IS NOT NULL), prevs AS (SELECT *, lag(taken) OVER w AS pt, lag(signature) OVER w AS ps FROM seq WINDOW w AS (PARTITION BY folder ORDER BY taken, photo_id)),
gaps AS (SELECT *, CASE WHEN epoch(taken - pt) <= 600 AND NOT coalesce(list_dot_product(signature, ps) / nullif(sqrt(list_dot_product(signature, signature)) * sqrt(list_dot_product(ps, ps)), 0) < 0.65, false) THEN 0 ELSE 1 END AS s FROM prevs),
runs AS (SELECT *, sum(s) OVER (PARTITION BY folder ORDER BY taken, photo_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)"""


def signed(L: Library) -> DataFrame:
    """Live photos with their folder; the vector of a photo's first face stands for the signature of its picture."""
    s = L.vectors().where((F.size("embedding") == 64) & col("photo_id").isNotNull()).groupBy("photo_id").agg(F.min_by("embedding", "face_id").alias("signature"))
    return L.live().withColumn("folder", X.folder("file_path")).join(s, "photo_id", "left")


q("TS01", "SELECT folder, photo_id, burst FROM (SELECT *, count(*) OVER (PARTITION BY folder, burst) AS k FROM fold) WHERE k > 1", lambda L: S.bursts(signed(L), 600, 900), f"{_SIM}, {_FOLD}")
q("TS01_anywhere", "SELECT folder, photo_id, burst FROM (SELECT *, count(*) OVER (PARTITION BY folder, burst) AS k FROM fold) WHERE k > 1", lambda L: S.bursts(L.live().withColumn("folder", F.lit("")), 60, 600), f"{_BU}, {_FOLD}".replace("regexp_replace(file_path, '/[^/]*$', '')", "''").replace("<= 600", "<= 60").replace("> 900", "> 600"))
q("TS02", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1", lambda L: L.table("embeddings").select("vec_id", "embedding").join(L.table("embeddings").select((col("vec_id") + 1).alias("vec_id"), col("embedding").alias("before")), "vec_id").select("vec_id", F.round(X.cosine("embedding", "before"), 6).alias("cos")))
_SES = "sg AS (SELECT *, CASE WHEN epoch(taken - lag(taken) OVER (ORDER BY taken, photo_id)) <= 43200 THEN 0 ELSE 1 END AS s FROM live WHERE taken IS NOT NULL), ses AS (SELECT *, CAST(sum(s) OVER (ORDER BY taken, photo_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM sg)"
_EV = f"""{_SES}, ev AS (SELECT session, min(taken) AS start, count(*) AS n, count(DISTINCT city) AS cities, count(DISTINCT taken::DATE) AS days, count(*) FILTER (WHERE photo_id % 4 <> 0 AND year(taken) = 2021) AS t, count(*) FILTER (WHERE photo_id IN (SELECT photo_id FROM album_photos)) AS a FROM ses GROUP BY session),
pe AS (SELECT session, count(DISTINCT cluster_id) AS people FROM ses JOIN identities USING (photo_id) GROUP BY session), e3 AS (SELECT ev.*, coalesce(people, 0) AS people FROM ev LEFT JOIN pe USING (session) WHERE n >= 3)"""
q("TS03", "SELECT session, start, n, people, cities, days, round(CAST(a AS DOUBLE) / n, 6) AS album_share FROM e3 WHERE (people >= 2 OR (cities >= 1 AND days <= 3)) AND a <= n * 0.6 AND t <= n * 0.7", lambda L: S.events(L.live(), L.identities(), L.album_photos(), 12 * 3600, 3, L.live().where("photo_id % 4 <> 0 and year(taken) = 2021")), _EV)
q("TS03_sessions", "SELECT photo_id, session FROM ses", lambda L: S.sessions(L.live(), 12 * 3600).select("photo_id", "session"), _SES)
q("TS04", None, lambda L: S.trips(L.live(), L.identities(), I.home_city(L.live()), L.album_photos(), least=4, days=2))
_AH = f"{_HOME}, ctr AS (SELECT city, country, avg(lat) AS la, avg(lon) AS lo FROM live WHERE city IS NOT NULL AND lat IS NOT NULL GROUP BY ALL)"
q("TS05", "SELECT c.city, c.country, (c.city = h.city AND c.country IS NOT DISTINCT FROM h.country) OR 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(h.lat - c.la) / 2), 2) + cos(radians(c.la)) * cos(radians(h.lat)) * power(sin(radians(h.lon - c.lo) / 2), 2)))) <= 50 AS is_home FROM ctr c CROSS JOIN home h", lambda L: S.at_home(L.live().where("city is not null and lat is not null"), I.home_city(L.live())).select("city", "country", "is_home").distinct(), _AH)
q("TS06", None, lambda L: S.gatherings(L.live(), L.identities(), least=3, used=_used(L)))


def _used(L: Library) -> DataFrame:
    """(photo_id): photos that trips and events already suggest."""
    t = written(S.trip_photos(L.live(), L.identities(), I.home_city(L.live()), L.album_photos(), 4, 2).select("photo_id").distinct(), "trips")
    e = S.events(L.live(), L.identities(), L.album_photos(), 12 * 3600, 3, t).select("session")
    return t.unionByName(S.sessions(L.live(), 12 * 3600).join(e, "session", "left_semi").select("photo_id")).distinct()


q("TS07", "SELECT city, country, min(taken) AS first_taken, max(taken) AS last_taken, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY city, country ORDER BY taken, photo_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT *, CASE WHEN epoch(taken - lag(taken) OVER (PARTITION BY city, country ORDER BY taken, photo_id)) <= 259200 THEN 0 ELSE 1 END AS s FROM live WHERE taken IS NOT NULL AND city IS NOT NULL)) GROUP BY city, country, v", lambda L: S.gap_islands(L.live().where("city is not null"), ["city", "country"], 3 * 86400, name="v").groupBy("city", "country", "v").agg(F.min("taken").alias("first_taken"), F.max("taken").alias("last_taken"), F.count("*").alias("n")).drop("v"))
q("TS08", "SELECT count(*) AS sessions, count(*) FILTER (WHERE n < 3) AS small, count(*) FILTER (WHERE n >= 3 AND a > n * 0.6) AS in_albums, count(*) FILTER (WHERE n >= 3 AND t > n * 0.7) AS in_trips, count(*) FILTER (WHERE n >= 3 AND NOT (people >= 2 OR (cities >= 1 AND days <= 3))) AS no_signal, count(*) FILTER (WHERE n >= 3 AND (people >= 2 OR (cities >= 1 AND days <= 3)) AND a <= n * 0.6 AND t <= n * 0.7) AS kept FROM (SELECT ev.*, coalesce(people, 0) AS people FROM ev LEFT JOIN pe USING (session))", lambda L: S.diagnostics(L.live(), L.identities(), L.album_photos(), 12 * 3600, 3, L.live().where("photo_id % 4 <> 0 and year(taken) = 2021")), _EV)
_FP = "fp AS (SELECT session, sha256(array_to_string(list_sort(list(photo_id))::VARCHAR[], ',')) AS fingerprint FROM ses GROUP BY session HAVING count(*) >= 3)"
q("TS11", "SELECT session, fingerprint FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM suggestions WHERE fingerprint IS NOT NULL)", lambda L: G.member_set_key(_large_sessions(L), ["session"], "photo_id").withColumnRenamed("set_key", "fingerprint").join(L.suggestions().select("fingerprint"), "fingerprint", "left_anti").select("session", "fingerprint"), f"{_SES}, {_FP}")


def _large_sessions(L: Library) -> DataFrame:
    s = S.sessions(L.live(), 12 * 3600).select("session", "photo_id")
    return s.join(s.groupBy("session").agg(F.count("*").alias("n")).where("n >= 3").select("session"), "session", "left_semi")


_NT = "nt AS (SELECT photo_id, regexp_replace(file_path, '/[^/]*$', '') AS folder, CAST(epoch(taken) AS BIGINT) AS t FROM live WHERE taken IS NOT NULL)"
q("JN12", "SELECT x.photo_id AS a, y.photo_id AS b, abs(x.t - y.t) AS delta FROM nt x JOIN nt y ON x.folder = y.folder AND x.photo_id < y.photo_id AND abs(x.t - y.t) <= 300", lambda L: S.near_in_time(L.live().where("taken is not null").select("photo_id", X.folder("file_path").alias("folder"), X.seconds("taken").alias("t")), "photo_id", "t", ["folder"], 300), _NT)

# Map
_C8 = "c AS (SELECT *, CAST(floor(lat / 0.3515625) AS BIGINT) AS cy, CAST(floor(lon / 0.3515625) AS BIGINT) AS cx FROM live WHERE lat IS NOT NULL)"
q("SP01", "SELECT cy, cx, count(*) AS n, arg_max(photo_id, (taken IS NOT NULL, coalesce(taken, TIMESTAMP '1000-01-01'), photo_id)) AS newest, round((cy + 0.5::DOUBLE) * 0.3515625::DOUBLE, 6) AS lat, round((cx + 0.5::DOUBLE) * 0.3515625::DOUBLE, 6) AS lon FROM c GROUP BY cy, cx", lambda L: P.pins(L.live(), 8), _C8)
q("SP01_ids", "SELECT cy, cx, array_to_string(list_sort(list(photo_id))[1:500], ',') AS ids FROM c GROUP BY cy, cx", lambda L: P.pin_ids(L.live(), 8), _C8)
_LV = "lv AS (SELECT k, CAST(floor(cy / CAST(power(2, k) AS DOUBLE)) AS BIGINT) AS cy, CAST(floor(cx / CAST(power(2, k) AS DOUBLE)) AS BIGINT) AS cx, lat, lon FROM c, range(0, 14) r(k)), lk AS (SELECT min(k) AS k FROM (SELECT k, count(DISTINCT (cy, cx)) AS n FROM lv GROUP BY k) WHERE n <= 300)"
q("SP02", "SELECT cy, cx, CAST(lv.k AS BIGINT) AS level, count(*) AS n, round(sum(lat) / count(*) + 1e-7::DOUBLE, 4) AS lat, round(sum(lon) / count(*) + 1e-7::DOUBLE, 4) AS lon FROM lv JOIN lk ON lk.k = lv.k GROUP BY cy, cx, lv.k", lambda L: P.merged_pins(L.live(), 8, 300), f"{_C8}, {_LV}")
q("SP03", "SELECT photo_id FROM live WHERE lat BETWEEN -50 AND 70 AND (lon >= 170 OR lon <= 20)", lambda L: L.live().where(P.Viewport.of(70, -50, 170, 380).holds()).select("photo_id"))
q("SP04", "SELECT photo_id, lat, lon FROM live WHERE lat IS NOT NULL ORDER BY taken DESC NULLS LAST, photo_id DESC LIMIT 100000", lambda L: L.live().where("lat is not null").orderBy(col("taken").desc_nulls_last(), col("photo_id").desc()).limit(100_000).select("photo_id", "lat", "lon"))
q("SP05", "SELECT photo_id, file_name FROM live WHERE photo_id IN (1001, 1002, 1005, 1008, 1013, 1021, 1034, 1055, 1089)", lambda L: X.in_given_order(L.live(), "photo_id", [1001, 1002, 1005, 1008, 1013, 1021, 1034, 1055, 1089]).select("photo_id", "file_name"))
_PR = "CASE feature_code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.PRIORITY.items()) + " ELSE 7 END"
_BC = f"""cand AS (SELECT p.photo_id, c.id AS city_id, abs(p.lat - c.latitude) AS dy, least(abs(p.lon - c.longitude), 360 - abs(p.lon - c.longitude)) AS dx, {_PR} AS pr,
  2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(c.latitude - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.latitude)) * power(sin(radians(c.longitude - p.lon) / 2), 2)))) AS km
  FROM live p JOIN cities c ON c.population >= 100000 AND c.latitude BETWEEN p.lat - 2 AND p.lat + 2 WHERE p.lat IS NOT NULL),
best AS (SELECT photo_id, city_id, round(round(km, 6) + 1e-7::DOUBLE, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY dx > 1 OR dy > 1, pr, round(km, 6), city_id) AS rn FROM cand WHERE dx <= 2 AND km <= 100) WHERE rn = 1)"""
q("SP06", "SELECT photo_id, city_id, km FROM best", lambda L: P.best_city(L.live(), L.cities(), "photo_id"), _BC)
q("JN13", "SELECT photo_id, city_id, km FROM best WHERE km <= 50", lambda L: P.best_city(L.live(), L.cities(), "photo_id").where("km <= 50"), _BC)
q("SP07", "SELECT photo_id FROM live WHERE lat IS NOT NULL AND least(abs(lon - 179.5), 360 - abs(lon - 179.5)) <= 4", lambda L: L.live().where("lat is not null").where(F.lit(False) | _either(P.wrapped_ranges(179.5, 4))).select("photo_id"))
q("SP08", "SELECT l.photo_id, coalesce(l.city, c.ascii_name) AS city, coalesce(l.country, c.country_name) AS country FROM live l LEFT JOIN best b USING (photo_id) LEFT JOIN cities c ON c.id = b.city_id WHERE l.city IS NULL AND l.lat IS NOT NULL", lambda L: _backfilled(L), _BC)


def _either(ranges: list[tuple[float, float]]) -> F.Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | col("lon").between(a, b)
    return out


def _backfilled(L: Library) -> DataFrame:
    """Photos without a city, with the best city near them."""
    p = L.live().where("city is null and lat is not null")
    c = L.cities().select(col("id").alias("city_id"), "ascii_name", "country_name")
    j = p.join(P.best_city(p, L.cities(), "photo_id"), "photo_id", "left").join(c, "city_id", "left")
    return j.select("photo_id", F.coalesce("city", "ascii_name").alias("city"), F.coalesce("country", "country_name").alias("country"))


_LT = "later AS (SELECT CASE WHEN photo_id % 10 = 1 THEN 'moved/' || file_path ELSE file_path END AS file_path, file_size AS size, mtime, file_hash FROM ph WHERE photo_id % 10 <> 0)"
_MV = f"{_LT}, gone AS (SELECT file_hash, photo_id, file_path AS old_path, row_number() OVER (PARTITION BY file_hash ORDER BY photo_id) AS rn FROM ph WHERE file_path NOT IN (SELECT file_path FROM later) AND file_hash IS NOT NULL), came AS (SELECT file_hash, min(file_path) AS new_path FROM later WHERE file_path NOT IN (SELECT file_path FROM ph) GROUP BY file_hash), moved AS (SELECT g.photo_id, g.old_path, c.new_path FROM gone g JOIN came c ON c.file_hash = g.file_hash WHERE g.rn = 1)"


def changes(L: Library) -> DataFrame:
    """(op, photo_id, file_path): what a later listing changes."""
    from shutterlake.operators.ingest import change_set

    return change_set(L.photos().select("photo_id", "file_path", "file_size", "mtime", "file_hash"), X.later(L))


q("JN11", "SELECT photo_id, new_path AS file_path FROM moved", lambda L: changes(L).where("op = 'moved'").select("photo_id", "file_path"), _MV)
_OPS = f"{_MV}, ops AS (SELECT 'moved' AS op, photo_id, new_path AS file_path FROM moved UNION ALL SELECT 'missing', photo_id, file_path FROM ph WHERE file_path NOT IN (SELECT file_path FROM later) AND photo_id NOT IN (SELECT photo_id FROM moved) UNION ALL SELECT 'added', NULL, file_path FROM later WHERE file_path NOT IN (SELECT file_path FROM ph) AND file_path NOT IN (SELECT new_path FROM moved) UNION ALL SELECT 'modified', p.photo_id, p.file_path FROM ph p JOIN later n ON n.file_path = p.file_path WHERE n.size IS DISTINCT FROM p.file_size OR n.mtime IS DISTINCT FROM p.mtime)"
q("SC07", "SELECT op, photo_id, file_path FROM ops", changes, _OPS)
q("TS09", "SELECT op, count(*) AS n FROM ops GROUP BY op", lambda L: changes(L).groupBy("op").agg(F.count("*").alias("n")), _OPS)

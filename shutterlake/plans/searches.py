"""Search queries: text compiled to plans, and their results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import search as Q
from shutterlake.plans.timeline import _SC
from shutterlake.sources.library import Library, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col
TODAY = date(2025, 6, 15)


def q(name: str, text: str | None, f, more: str = "") -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, d: f(Library(spark, d))
    if text:
        SQL[name] = sql(text, more)


def _names(L: Library, text: str) -> Q.Names:
    return Q.names_of(L.clusters(), L.live(), L.album_photos(), text)


def run(L: Library, plan: Q.Plan, semantic: DataFrame | None = None, limit: int = Q.MAX_RESULTS) -> DataFrame:
    return Q.execute(plan, L.photos(), L.faces(), L.inferred(), L.identities(), L.album_photos(), semantic, limit).select("photo_id")


def search(L: Library, text: str) -> DataFrame:
    return run(L, Q.compile_search(text, _names(L, text), TODAY))


_DATES = ["today", "yesterday", "last week", "this month", "last year", "march 2021", "2019", "summer 2020", "winter 2018", "last summer", "last autumn", "june", "2022-02-03", "no date"]


def _dates(L: Library, peel: bool = False) -> DataFrame:
    rows = []
    for t in _DATES:
        rest, s = Q.peel_date(f"beach {t} dog", TODAY) if peel else ("", Q.parse_date(t, TODAY))
        rows.append((t, rest, s and s.first, s and s.last))
    return L.spark.createDataFrame(rows, "text string, rest string, first date, last date")


_SPANS = """(VALUES ('today', DATE '2025-06-15', DATE '2025-06-15'), ('yesterday', DATE '2025-06-14', DATE '2025-06-14'), ('last week', DATE '2025-06-02', DATE '2025-06-08'), ('this month', DATE '2025-06-01', DATE '2025-06-30'),
 ('last year', DATE '2024-01-01', DATE '2024-12-31'), ('march 2021', DATE '2021-03-01', DATE '2021-03-31'), ('2019', DATE '2019-01-01', DATE '2019-12-31'), ('summer 2020', DATE '2020-06-01', DATE '2020-08-31'), ('winter 2018', DATE '2018-12-01', DATE '2019-02-28'),
 ('last summer', DATE '2024-06-01', DATE '2024-08-31'), ('last autumn', DATE '2023-09-01', DATE '2023-11-30'), ('june', DATE '2025-06-01', DATE '2025-06-30'), ('2022-02-03', DATE '2022-02-03', DATE '2022-02-03'), ('no date', NULL, NULL)) v(text, first, last)"""
q("NL01", f"SELECT text, CASE WHEN first IS NULL THEN 'beach no date dog' ELSE 'beach dog' END AS rest, first, last FROM {_SPANS}", lambda L: _dates(L, True))
q("NL02", f"SELECT text, '' AS rest, first, last FROM {_SPANS}", _dates)
q("NL03", "SELECT photo_id FROM live WHERE favorite AND media_type = 'video' AND taken BETWEEN TIMESTAMP '2021-01-01' AND TIMESTAMP '2021-12-31 23:59:59'", lambda L: search(L, "favourites videos 2021"))
_P = "who AS (SELECT min(cluster_id) AS a FROM clusters WHERE name IS NOT NULL), towns AS (SELECT city FROM live WHERE city IS NOT NULL AND country IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1)"


def _first_person(L: Library) -> str:
    return L.clusters().where("name is not null").agg(F.min_by("name", "cluster_id")).first()[0]


def _first_town(L: Library) -> str:
    return L.live().where("city is not null and country is not null").groupBy("city").count().orderBy(col("count").desc(), "city").first()[0]


q("NL04", "SELECT l.photo_id FROM live l JOIN towns t ON lower(t.city) = lower(l.city) WHERE country IS NOT NULL", lambda L: search(L, f"photos in {_first_town(L)}").join(L.live(), "photo_id", "left_semi"), _P)
SQL["NL04"] = SQL["NL04"].replace("WHERE country IS NOT NULL", "WHERE country IS NOT NULL AND media_type = 'photo'")
_TEXT = " OR ".join(f"contains(lower(coalesce({c}, '')), 'granite')" for c in ("file_name", "file_path", "city", "country", "make", "model"))
q("NL05", f"SELECT photo_id FROM live WHERE {_TEXT}", lambda L: search(L, "from granite containing &"))
q("NL06", "SELECT photo_id FROM live WHERE photo_id IN (SELECT photo_id FROM identities WHERE cluster_id = (SELECT a FROM who))", lambda L: search(L, f"with {_first_person(L)}"), _P)
q("NL06_only", "SELECT photo_id FROM live l WHERE photo_id IN (SELECT photo_id FROM identities WHERE cluster_id = (SELECT a FROM who)) AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = l.photo_id AND f.cluster_id IS DISTINCT FROM (SELECT a FROM who)) AND NOT EXISTS (SELECT 1 FROM inferred i WHERE i.photo_id = l.photo_id AND i.cluster_id <> (SELECT a FROM who))", lambda L: search(L, f"only {_first_person(L)}"), _P)
q("NL06_country", "SELECT photo_id FROM live WHERE country = 'Kestria' AND taken BETWEEN TIMESTAMP '2020-06-01' AND TIMESTAMP '2020-08-31 23:59:59'", lambda L: search(L, "Kestria summer 2020"))
q("NL06_album", "SELECT photo_id FROM live WHERE photo_id IN (SELECT photo_id FROM album_photos WHERE lower(album) LIKE '%scans%' )", lambda L: search(L, "album Scans"))
q("NL07", f"SELECT l.photo_id FROM live l LEFT JOIN ranked r ON r.photo_id = l.photo_id WHERE ({_TEXT}) OR r.rank IS NOT NULL ORDER BY r.rank NULLS LAST, taken DESC NULLS LAST, l.photo_id DESC LIMIT 500", lambda L: run(L, Q.Plan(text="granite"), Q.ranked(L.candidates()), 500), _SC)
q("NL08", "SELECT name FROM (SELECT DISTINCT name FROM clusters WHERE contains(lower(name), 'son 1')) ORDER BY starts_with(lower(name), 'son 1') DESC, length(name), name LIMIT 10", lambda L: Q.hits(L.clusters(), "name", "son 1").select("name"))
q("NL08_places", "SELECT city FROM (SELECT DISTINCT city FROM live WHERE contains(lower(city), 'br')) ORDER BY starts_with(lower(city), 'br') DESC, length(city), city LIMIT 10", lambda L: Q.hits(L.live(), "city", "br").select("city"))
q("NL09", "SELECT * FROM (VALUES ('date'), ('country:Kestria'), ('favorite'), ('media:video'), ('text:dog')) v(chip)", lambda L: L.spark.createDataFrame([(c,) for c in Q.compile_search("starred videos Kestria dog 2021", Q.Names(countries=("Kestria",)), TODAY).chips], "chip string"))
q("NL10", "SELECT l.photo_id FROM live l JOIN towns t ON lower(t.city) = lower(l.city) WHERE taken BETWEEN TIMESTAMP '2022-01-01' AND TIMESTAMP '2022-12-31 23:59:59'", lambda L: run(L, Q.compile_simple(f"in {_first_town(L)} 2022", TODAY)), _P)
q("NL11", "SELECT photo_id FROM live WHERE country = 'Hestria' AND media_type = 'video'", lambda L: run(L, Q.compile_request("show me my videos Hestria", _names(L, "show me my videos Hestria"), TODAY).plan))
q("NL12", "SELECT city FROM (SELECT DISTINCT city, regexp_replace(lower(city), '[^\\w]|_', '', 'g') AS s FROM live WHERE city IS NOT NULL) WHERE starts_with(s, 'mor') OR starts_with(s, 'm') ORDER BY NOT starts_with(s, 'mor'), length(city), city LIMIT 5", lambda L: Q.near_names(L.live().where("city is not null"), "city", "mor"))
q("NL13", "SELECT photo_id FROM live WHERE (country = 'Kestria' OR country = 'Hestria') AND NOT favorite", lambda L: Q.combined([search(L, "Kestria"), search(L, "Hestria")], "union", search(L, "favorites")))
q("NL13_both", "SELECT photo_id FROM live WHERE country = 'Kestria' AND taken BETWEEN TIMESTAMP '2021-01-01' AND TIMESTAMP '2021-12-31 23:59:59'", lambda L: Q.combined([search(L, "Kestria"), search(L, "2021")], "intersect"))
q("NL14", "SELECT photo_id, rank FROM ranked", lambda L: Q.ranked(L.candidates()), _SC)

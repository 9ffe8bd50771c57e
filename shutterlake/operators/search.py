"""The search language: dates, words and names compiled to one plan, and its execution as a DataFrame.

Compilation runs on the driver over small dimensions (people, places, albums); the plan is immutable. Execution is one pass over the photos with
semi-joins, so the optimiser sees the whole query.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X

col = F.col
# Words of the language.
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m} | {"sept": 9}
SEASONS = {"spring": (3, 5), "summer": (6, 8), "fall": (9, 11), "autumn": (9, 11), "winter": (12, 2)}
FAVORITE_WORDS = "favourites favorites favourite favorite starred".split()
MEDIA_WORDS = {"videos": "video", "video": "video", "photos": "photo", "photo": "photo"}
STOP_WORDS = frozenset("and & with in at from person people containing".split())
TOOL_WORDS = frozenset("find show search get give list all my photo photos picture pictures".split())
MAKE_WORDS = frozenset("create make build generate save collect album albums collection".split())
RESIDUE_WORDS = frozenset("and or the a an me my only just in at to of".split())
LOCATION_WORDS = "city country beach mountain park airport station hotel restaurant museum temple shrine".split()
KNOWN_PLACES = ["japan", "tokyo", "usa", "new york", "london", "paris", "france", "germany", "berlin", "italy", "rome", "spain", "china", "beijing", "australia", "sydney", "canada", "toronto", "india", "hyderabad", "delhi"]
MAX_RESULTS, MAX_PLACES = 20_000, 3


@dataclass(frozen=True)
class Span:
    """Whole days, both included."""

    first: date
    last: date


def _month(y: int, m: int) -> Span:
    return Span(date(y, m, 1), date(y, m, calendar.monthrange(y, m)[1]))


def _season(name: str, y: int) -> Span:
    a, b = SEASONS[name]
    return Span(date(y, a, 1), _month(y + (b < a), b).last)


def parse_date(text: str, today: date) -> Span | None:
    """Relative words, then month and year in either order, a year, a season, a month of this year, an ISO day."""
    t = " ".join(text.lower().split())
    monday = today - timedelta(today.weekday())
    first = today.replace(day=1)
    before = first - timedelta(1)
    fixed = {
        "today": Span(today, today), "yesterday": Span(today - timedelta(1), today - timedelta(1)), "this week": Span(monday, monday + timedelta(6)), "last week": Span(monday - timedelta(7), monday - timedelta(1)),
        "this month": _month(today.year, today.month), "last month": _month(before.year, before.month), "this year": Span(date(today.year, 1, 1), date(today.year, 12, 31)), "last year": Span(date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)),
    }
    if t in fixed:
        return fixed[t]
    w = t.split()
    year = lambda s: int(s) if re.fullmatch(r"\d{4}", s) and 1900 <= int(s) <= 2100 else None
    if len(w) == 2:
        for a, b in ((w[0], w[1]), (w[1], w[0])):
            if a in MONTHS and year(b):
                return _month(year(b), MONTHS[a])
    if len(w) == 1 and year(w[0]):
        return Span(date(year(w[0]), 1, 1), date(year(w[0]), 12, 31))
    if len(w) == 2 and w[0] in SEASONS and year(w[1]):
        return _season(w[0], year(w[1]))
    if len(w) == 2 and w[0] in ("last", "this") and w[1] in SEASONS:
        back = 0 if w[0] == "this" else 2 if SEASONS[w[1]][0] > today.month else 1
        return _season(w[1], today.year - back)
    if len(w) == 1 and w[0] in SEASONS:
        return _season(w[0], today.year)
    if len(w) == 1 and w[0] in MONTHS:
        return _month(today.year, MONTHS[w[0]])
    try:
        d = date.fromisoformat(t)
        return Span(d, d)
    except ValueError:
        return None


def peel_date(text: str, today: date) -> tuple[str, Span | None]:
    """(rest, span): the whole text, any two neighbouring words, or any word that is a date."""
    if s := parse_date(text, today):
        return "", s
    w = text.split()
    for n in (2, 1):
        for i in range(len(w) - n + 1):
            if s := parse_date(" ".join(w[i : i + n]), today):
                return " ".join(w[:i] + w[i + n :]), s
    return text, None


def tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]


def phrase_in(name: str, text: str) -> bool:
    """Whether the words of ``name`` stand in ``text``, one after the other."""
    n, t = tokens(name), tokens(text)
    return bool(n) and any(t[i : i + len(n)] == n for i in range(len(t) - len(n) + 1))


def masked(name: str, text: str) -> str:
    """``text`` as words without the first mention of ``name``."""
    n, t = tokens(name), tokens(text)
    for i in range(len(t) - len(n) + 1):
        if t[i : i + len(n)] == n:
            return " ".join(t[:i] + t[i + len(n) :])
    return text


@dataclass(frozen=True)
class Names:
    """The small dimensions that names are resolved in."""

    people: tuple[tuple[int, str], ...] = ()
    cities: tuple[tuple[str, str], ...] = ()
    countries: tuple[str, ...] = ()
    albums: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    """A compiled search; all its parts hold together."""

    span: Span | None = None
    text: str = ""
    people: tuple[int, ...] = ()
    only_people: bool = False
    cities: tuple[tuple[str, str], ...] = ()
    countries: tuple[str, ...] = ()
    albums: tuple[str, ...] = ()
    favorite: bool = False
    media: str | None = None
    chips: tuple[str, ...] = field(default=(), compare=False)


def _longest(names: list, text: str, key, most: int | None = None):  # noqa: ANN001, ANN202
    found = []
    for n in sorted(names, key=lambda n: (-len(key(n)), key(n))):
        if (most is None or len(found) < most) and phrase_in(key(n), text):
            found.append(n)
            text = masked(key(n), text)
    return found, text


def compile_search(query: str, names: Names, today: date) -> Plan:
    """Text to plan: date, 'only', media and favourite words, 'album x', then people, cities and countries by their longest names; the rest is text."""
    text = " ".join(query.split())
    only = False
    if m := re.match(r"(?i)(only|just)\s+", text):
        only, text = True, text[m.end() :]
    text, span = peel_date(text, today)
    words = text.split()
    low = [w.lower() for w in words]
    favorite = next((w for w in FAVORITE_WORDS if w in low), None)
    media = next((w for w in MEDIA_WORDS if w in low), None)
    text = " ".join(w for w in words if w.lower() not in (favorite, media))
    albums: tuple[str, ...] = ()
    if m := re.search(r"(?i)\b(?:in\s+)?album\s+(.+)$", text):
        hit = [a for a in names.albums if tokens(a) and (phrase_in(a, m[1]) or m[1].lower().strip() in a.lower())]
        if hit:
            albums = tuple(sorted(hit))
            text = text[: m.start()]
    people, text = _longest([p for p in names.people if p[1]], text, lambda p: p[1])
    cities, text = _longest(list(dict.fromkeys(names.cities)), text, lambda c: c[0], MAX_PLACES)
    same = {c[0] for c in cities}
    cities = [c for c in names.cities if c[0] in same]  # a name may be a city of several countries
    countries, text = _longest(list(names.countries), text, lambda c: c, MAX_PLACES)
    rest = " ".join(w for w in text.split() if w.lower() not in STOP_WORDS and any(c.isalnum() for c in w))
    chips = [*(["date"] if span else []), *(f"person:{p[1]}" for p in people), *(f"city:{c[0]}" for c in cities), *(f"country:{c}" for c in countries), *(f"album:{a}" for a in albums), *(["favorite"] if favorite else []), *([f"media:{MEDIA_WORDS[media]}"] if media else []), *([f"text:{rest}"] if rest else [])]
    return Plan(span, rest, tuple(p[0] for p in people), only and bool(people), tuple(dict.fromkeys(cities)), tuple(countries), albums, favorite is not None, MEDIA_WORDS[media] if media else None, tuple(chips))


def compile_simple(query: str, today: date) -> Plan:
    """The older grammar: 'in <place>', a date at the end, words of places and well-known places, else a person or text."""
    text, span = query.strip(), None
    words = text.split()
    for n in (2, 1):
        if len(words) >= n and (s := parse_date(" ".join(words[-n:]), today)):
            span, words = s, words[:-n]
            break
    text = " ".join(words)
    if m := re.search(r"(?i)\bin\s+(.+)$", text):
        return Plan(span=span, text=text[: m.start()].strip(), cities=((m[1].strip(), ""),))
    if any(w in text.lower() for w in (*LOCATION_WORDS, *KNOWN_PLACES)):
        return Plan(span=span, cities=((text, ""),))
    return Plan(span=span, text=text)


@dataclass(frozen=True)
class Request:
    """What an assistant is asked for: intent, plan, and the residue to be searched by meaning."""

    intent: str
    plan: Plan
    residue: str


def compile_request(query: str, names: Names, today: date) -> Request:
    """Intent ('create_album' or 'search') and plan; dates are looked for in windows of three, two and one words."""
    low = tokens(query)
    creating = bool(MAKE_WORDS & set(low)) and "album" in low
    words, span = query.split(), None
    for n in (3, 2, 1):
        for i in range(len(words) - n + 1):
            if span is None and (s := parse_date(" ".join(words[i : i + n]), today)):
                span, words = s, words[:i] + words[i + n :]
    drop = TOOL_WORDS | (MAKE_WORDS if creating else frozenset())
    media = next((MEDIA_WORDS[w] for w in low if w in ("video", "videos")), None)
    text = " ".join(w for w in words if w.lower().strip(".,!?") not in drop and not (media and w.lower() in ("video", "videos")))
    p = compile_search(text, names, today)
    residue = " ".join(w for w in tokens(p.text) if w not in RESIDUE_WORDS)
    return Request("create_album" if creating else "search", replace(p, span=span or p.span, media=media or p.media, text=""), residue)


def fuzzy(query: str, labels: list[str], most: int = 5) -> list[str]:
    """Labels near a query: those it begins first, then those with its first letter that contain it (or any, if it is at most 4 characters long)."""
    q = "".join(tokens(query))
    out = []
    for label in labels:
        s = "".join(tokens(label))
        if q and s.startswith(q):
            out.append((0, len(label), label))
        elif q and s[:1] == q[:1] and (q in s or len(q) <= 4):
            out.append((1, len(label), label))
    return [x[2] for x in sorted(out)[:most]]


def execute(plan: Plan, photos: DataFrame, faces: DataFrame, inferred: DataFrame, identities: DataFrame, album_photos: DataFrame, semantic: DataFrame | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """Live photos that meet the plan, those found by meaning first in their rank, then the newest; at most ``limit``.

    ``semantic`` (photo_id, rank) is an alternative to the text filter; people are each required, places of a kind are alternatives.
    """
    p = photos.where(~col("trashed"))
    if plan.span:
        p = p.where(X.between_days("taken", plan.span.first.isoformat(), plan.span.last.isoformat()))
    if plan.favorite:
        p = p.where("favorite")
    if plan.media:
        p = p.where(col("media_type") == plan.media)
    if plan.cities:
        any_: Column = F.lit(False)
        for city, country in plan.cities:
            any_ = any_ | ((F.lower("city") == city.lower()) & (col("country") == country if country else F.lit(True)))
        p = p.where(any_)
    if plan.countries:
        p = p.where(col("country").isin(list(plan.countries)))
    if plan.albums:
        p = p.join(album_photos.where(col("album").isin(list(plan.albums))), "photo_id", "left_semi")
    for person in plan.people:
        p = p.join(identities.where(col("cluster_id") == person), "photo_id", "left_semi")
    if plan.only_people:
        mine = list(plan.people)
        p = p.join(faces.where(col("cluster_id").isNull() | ~col("cluster_id").isin(mine)), "photo_id", "left_anti")
        p = p.join(inferred.where(~col("cluster_id").isin(mine)), "photo_id", "left_anti")
    rank = F.lit(None).cast("long")
    if semantic is not None:
        p = p.join(semantic.select("photo_id", col("rank").alias("_rank")), "photo_id", "left")
        rank = col("_rank")
    if plan.text:
        hit = F.lit(True)
        for w in plan.text.split():
            hit = hit & X.any_contains(["file_name", "file_path", "city", "country", "make", "model"], w)
        p = p.where(hit if semantic is None else hit | col("_rank").isNotNull())
    p = p.withColumn("rank", rank)
    return p.orderBy(col("rank").asc_nulls_last(), col("taken").desc_nulls_last(), col("photo_id").desc()).limit(limit).drop("_rank")


def text_hits(photos: DataFrame, faces: DataFrame, inferred: DataFrame, clusters: DataFrame, text: str) -> DataFrame:
    """Photos whose file, place, maker or model (or both of these together) contains a text, or on which a person of such a name is seen or inferred."""
    who = clusters.where(F.lower("name").contains(text.lower())).select("cluster_id")
    seen = faces.select("photo_id", "cluster_id").unionByName(inferred.select("photo_id", "cluster_id")).join(who, "cluster_id").select("photo_id", F.lit(True).alias("_who")).distinct()
    p = photos.join(seen, "photo_id", "left")
    both = F.concat_ws(" ", F.coalesce("make", F.lit("")), F.coalesce("model", F.lit("")))
    hit = X.any_contains(["file_name", "city", "country", "make", "model"], text) | F.lower(both).contains(text.lower()) | F.coalesce("_who", F.lit(False))
    return p.where(hit).drop("_who")


def by_day(found: DataFrame) -> DataFrame:
    """(day, n, city): results by day with the first known city of each."""
    return found.groupBy(F.to_date("taken").alias("day")).agg(F.count("*").alias("n"), F.min_by("city", F.when(col("city").isNotNull(), F.struct("taken", "photo_id"))).alias("city"))


def combined(parts: list[DataFrame], how: str, exclude: DataFrame | None = None) -> DataFrame:
    """(photo_id): union or intersection of results, without those of ``exclude``."""
    out = parts[0].select("photo_id").distinct()
    for p in parts[1:]:
        out = out.unionByName(p.select("photo_id")).distinct() if how == "union" else out.join(p, "photo_id", "left_semi")
    return out if exclude is None else out.join(exclude, "photo_id", "left_anti")


def hits(names: DataFrame, column: str, text: str, most: int = 10) -> DataFrame:
    """The first names that contain a text, those it begins first."""
    n = names.where(F.lower(column).contains(text.lower())).select(column).distinct()
    n = n.withColumn("starts", F.lower(column).startswith(text.lower()))
    return n.orderBy(col("starts").desc(), F.length(column), column).limit(most)


def names_of(clusters: DataFrame, photos: DataFrame, album_photos: DataFrame, query: str) -> Names:
    """The people, places and albums that a query may name: only names all of whose words stand in the query leave the tables, so what comes back doesn't grow with the library."""
    words = F.array(*map(F.lit, tokens(query))) if tokens(query) else F.array().cast("array<string>")

    def named(c: str) -> Column:
        own = F.filter(F.split(F.lower(c), r"(?U)[^\w]+|_"), lambda w: w != "")
        return (F.size(own) > 0) & (F.size(F.array_except(own, words)) == 0)

    pairs = photos.where(col("city").isNotNull() & col("country").isNotNull() & (named("city") | named("country"))).select("city", "country", named("city").alias("_c")).distinct().orderBy("city", "country").collect()
    people = clusters.where(col("name").isNotNull() & named("name")).orderBy("cluster_id").collect()
    albums: list = []
    if m := re.search(r"(?i)\balbum\s+(.+)$", query):
        part = named("album")
        for w in m[1].lower().split():
            part = part | F.lower("album").contains(w)
        albums = album_photos.where(part).select("album").distinct().orderBy("album").collect()
    return Names(tuple((r.cluster_id, r.name) for r in people), tuple((r.city, r.country) for r in pairs if r["_c"]), tuple(sorted({r.country for r in pairs})), tuple(r.album for r in albums))


def near_names(names: DataFrame, column: str, query: str, most: int = 5) -> DataFrame:
    """Names near a query, as ``fuzzy`` has them, found in the table."""
    q = "".join(tokens(query))
    s = F.regexp_replace(F.lower(column), r"(?U)[^\w]|_", "")
    ok = s.startswith(q) | (s.startswith(q[:1]) & (F.lit(len(q) <= 4) | s.contains(q))) if q else F.lit(False)
    n = names.where(ok).select(column, s.startswith(q).alias("_starts")).distinct()
    return n.orderBy(col("_starts").desc(), F.length(column), column).limit(most).select(column)


def meaningful(text: str) -> bool:
    """Whether a text is worth a search by meaning: three characters, one of them a letter."""
    return len(text.strip()) >= 3 and any(c.isalpha() for c in text)


def ranked(scores: DataFrame, most: int = 300) -> DataFrame:
    """(photo_id, rank) of the best scores, kept for all pages of a search."""
    s = scores.groupBy("photo_id").agg(F.max("score").alias("score")).orderBy(col("score").desc(), "photo_id").limit(most)
    return s.select("photo_id", F.row_number().over(W.partitionBy().orderBy(col("score").desc(), "photo_id")).cast("long").alias("rank"))

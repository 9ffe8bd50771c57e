"""Segments of a timeline: sessions, bursts, trips and gatherings."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X

col = F.col
BUCKET_S = 6 * 3600


def gap_islands(df: DataFrame, keys: list[str], gap: int, date: str = "taken", key: str = "photo_id", closes: str | None = None, name: str = "island", differs: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Number the runs of rows within ``keys`` that have no gap of more than ``gap`` seconds; with ``closes``, a run also ends where that column changes (or
    ``differs`` says so of the row before and the row).

    Rows are ordered within buckets of six hours only; buckets are joined through one row each (their first and last row and their number of
    starts), so a key that holds most rows is spread over its buckets. Without ``closes`` only distinct times are ordered, so that very many rows of one time (a camera's default) are
    one row there, and a plain join gives them their run. Rows without a date are left out.
    """
    if closes is None:
        times = df.where(col(date).isNotNull()).select(*keys, date).distinct()
        return _null_safe_join(df.where(col(date).isNotNull()), _islands(times, keys, gap, date, date, None, name), [*keys, date])
    return _islands(df, keys, gap, date, key, closes, name, differs)


def _islands(df: DataFrame, keys: list[str], gap: int, date: str, key: str, closes: str | None, name: str, differs: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    d = df.where(col(date).isNotNull()).withColumn("_b", F.floor(X.seconds(date) / BUCKET_S))
    w = W.partitionBy(*keys, "_b").orderBy(date, key)
    flag = F.struct(col(closes).alias("v")) if closes else F.lit(0)
    d = d.withColumn("_f", flag).withColumn("_t", F.lag(X.seconds(date)).over(w)).withColumn("_p", F.lag("_f").over(w))
    edge = F.struct(col(date), col(key))
    e = d.groupBy(*keys, "_b").agg(F.max(X.seconds(date)).alias("_last"), F.max_by("_f", edge).alias("_lastf"))
    o = W.partitionBy(*keys).orderBy("_b")
    e = e.select(*keys, "_b", F.lag("_last").over(o).alias("_bt"), F.lag("_lastf").over(o).alias("_bp"))
    on = [*keys, "_b"]
    d = _null_safe_join(d, e, on)
    prev, pf = F.coalesce("_t", "_bt"), F.coalesce("_p", "_bp")
    start = prev.isNull() | (X.seconds(date) - prev > gap)
    if closes:
        start = start | (F.coalesce(differs(pf["v"], col("_f.v")), F.lit(False)) if differs else ~pf.eqNullSafe(col("_f")))
    d = d.withColumn("_s", start.cast("long")).drop("_t", "_p", "_bt", "_bp", "_f")
    c = d.groupBy(*keys, "_b").agg(F.sum("_s").alias("_n"))
    c = c.select(*keys, "_b", (F.sum("_n").over(o.rowsBetween(W.unboundedPreceding, 0)) - col("_n")).alias("_before"))
    d = _null_safe_join(d, c, on)
    return d.withColumn(name, col("_before") + F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s", "_b", "_before")


def _null_safe_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    b = b.select(*[col(c).alias(f"_r{c}") if c in on else col(c) for c in b.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & col(c).eqNullSafe(col(f"_r{c}"))
    return a.join(b, cond).drop(*[f"_r{c}" for c in on])


def bursts(photos: DataFrame, gap: int, span: int, least: int = 2, similarity: float = 0.65) -> DataFrame:
    """(folder, photo_id, burst): photos of a folder at most ``gap`` seconds apart, a burst lasting at most ``span`` seconds; bursts of at least ``least``.

    Where ``photos`` has a column signature, a photo whose cosine similarity to the one before is under ``similarity`` begins a burst, if both have one. For bursts across folders
    give all photos one folder.

    Gaps depend on the previous photo only and cut the timeline into islands. Only an island longer than ``span`` is folded in order, as the start of a burst in it depends
    on where the one before ended; the fold takes the distinct seconds of the island, with the first photo of each, so what a task holds is bounded by the time
    that a camera fired without a break, not by the number of its photos.
    """
    if "signature" in photos.columns:
        p = gap_islands(photos.select("folder", "photo_id", "taken", "signature"), ["folder"], gap, closes="signature", differs=lambda a, b: X.cosine_of(a, b) < similarity).drop("signature")
    else:
        p = gap_islands(photos.select("folder", "photo_id", "taken"), ["folder"], gap)
    p = p.withColumn("t", X.seconds("taken"))
    size = p.groupBy("folder", "island").agg((F.max("t") - F.min("t")).alias("_span"), F.min_by("photo_id", F.struct("t", "photo_id")).alias("_first"))
    p = p.join(size, ["folder", "island"])
    short = p.where(col("_span") <= span).select("folder", "photo_id", col("_first").alias("burst"))

    def fold(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        ids, times = t.column("photo_id").to_pylist(), t.column("t").to_pylist()
        out, head, begin = [], None, None
        for i, x in zip(ids, times):
            if head is None or x - begin > span:
                head, begin = i, x
            out.append(head)
        return pa.table([t.column("folder"), t.column("island"), t.column("t"), pa.array(out, pa.int64())], names=["folder", "island", "t", "burst"])

    long = p.where(col("_span") > span).select("folder", "island", "photo_id", "t")
    heads = long.groupBy("folder", "island", "t").agg(F.min("photo_id").alias("photo_id")).groupBy("folder", "island").applyInArrow(fold, "folder string, island long, t long, burst long")
    every = short.unionByName(_null_safe_join(long, heads, ["folder", "island", "t"]).select("folder", "photo_id", "burst"))
    big = every.groupBy("folder", "burst").agg(F.count("*").alias("n")).where(col("n") >= least).select("folder", "burst")
    return every.join(big, ["folder", "burst"], "left_semi")


def sessions(photos: DataFrame, gap: int) -> DataFrame:
    """Photos with the number of their session: a gap of more than ``gap`` seconds splits, an equal one doesn't."""
    return gap_islands(photos, [], gap, name="session")


def _candidates(photos: DataFrame, identities: DataFrame, in_album: DataFrame, gap: int, in_trips: DataFrame | None) -> DataFrame:
    """Sessions with what the gates of ``events`` ask for: signal, in_albums, in_trips."""
    s = sessions(photos, gap).join(in_album.select("photo_id", F.lit(1).alias("in_album")).distinct(), "photo_id", "left")
    s = s.join(in_trips.select("photo_id", F.lit(1).alias("in_trip")).distinct(), "photo_id", "left") if in_trips is not None else s.withColumn("in_trip", F.lit(None).cast("int"))
    people = s.join(identities, "photo_id").groupBy("session").agg(F.countDistinct("cluster_id").alias("people"))
    e = s.groupBy("session").agg(F.count("*").alias("n"), F.countDistinct("city").alias("cities"), F.countDistinct(F.to_date("taken")).alias("days"), F.count("in_album").alias("_a"), F.count("in_trip").alias("_t"), F.min("taken").alias("start"))
    e = e.join(people, "session", "left").withColumn("people", F.coalesce("people", F.lit(0))).withColumn("album_share", F.round(col("_a").cast("double") / col("n"), 6))
    signal = (col("people") >= 2) | ((col("cities") >= 1) & (col("days") <= 3))
    return e.withColumns({"signal": signal, "in_albums": col("_a") > col("n") * 0.6, "in_trips": col("_t") > col("n") * 0.7})


def events(photos: DataFrame, identities: DataFrame, in_album: DataFrame, gap: int = 4 * 3600, least: int = 15, in_trips: DataFrame | None = None) -> DataFrame:
    """(session, n, people, cities, days, album_share): sessions of at least ``least`` photos with two people, or a city and three days with photos at most, at most 60 % in albums and 70 % in trips."""
    e = _candidates(photos, identities, in_album, gap, in_trips).where(col("n") >= least)
    return e.where(col("signal") & ~col("in_albums") & ~col("in_trips")).select("session", "start", "n", "people", "cities", "days", "album_share")


def diagnostics(photos: DataFrame, identities: DataFrame, in_album: DataFrame, gap: int = 4 * 3600, least: int = 15, in_trips: DataFrame | None = None) -> DataFrame:
    """One row: the sessions, how many each gate of ``events`` turns away, and how many pass all."""
    e, big = _candidates(photos, identities, in_album, gap, in_trips), col("n") >= least
    kept = big & col("signal") & ~col("in_albums") & ~col("in_trips")
    return e.agg(
        F.count("*").alias("sessions"), F.count_if(~big).alias("small"), F.count_if(big & col("in_albums")).alias("in_albums"), F.count_if(big & col("in_trips")).alias("in_trips"),
        F.count_if(big & ~col("signal")).alias("no_signal"), F.count_if(kept).alias("kept"),
    )


def at_home(photos: DataFrame, home: DataFrame) -> DataFrame:
    """``photos`` with is_home: in the home city, or in a city whose centre lies within 50 km of home's."""
    centre = photos.where("city is not null and lat is not null").groupBy("city", "country").agg(F.avg("lat").alias("_la"), F.avg("lon").alias("_lo"))
    h = home.select(col("city").alias("_hc"), col("country").alias("_hn"), col("lat").alias("_hla"), col("lon").alias("_hlo"))  # one row
    near = X.haversine_km(col("_la"), col("_lo"), col("_hla"), col("_hlo")) <= 50
    c = centre.crossJoin(F.broadcast(h)).withColumn("is_home", near | ((col("city") == col("_hc")) & col("country").eqNullSafe(col("_hn")))).select("city", "country", "is_home")
    return _null_safe_join(photos, c, ["city", "country"])


def trip_photos(photos: DataFrame, identities: DataFrame, home: DataFrame, in_album: DataFrame | None = None, least: int = 15, days: int = 3, far: int = 10, apart: int = 4) -> DataFrame:
    """(trip, start, end, photo_id): the photos of journeys away from home; trip is the second of its first photo.

    In order of time, a photo at home ends a journey; so does a gap of more than ``far`` days, or of more than ``apart`` days without a person in common with
    any photo of the journey so far. The first two cut the timeline into independent stretches; only the last is folded in order within a
    stretch. A trip lasts at least ``days`` days; all photos from its first to its last day belong to it, at least ``least``, and at most 60 % of them are in albums.
    """
    located = at_home(photos.where("city is not null and taken is not null"), home).select("photo_id", "taken", "is_home")
    runs = gap_islands(located, [], far * 86400, closes="is_home", name="stretch").where(~col("is_home"))
    who = identities.groupBy("photo_id").agg(F.collect_set("cluster_id").alias("who"))
    # One row per second: what a stretch's task holds is bounded by its time, not by its photos.
    runs = runs.join(who, "photo_id", "left").groupBy("stretch", X.seconds("taken").alias("t")).agg(F.array_distinct(F.flatten(F.collect_list("who"))).alias("who"))

    def fold(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        out, seen, last, begin = [], set(), None, None
        for x, w in zip(t.column("t").to_pylist(), t.column("who").to_pylist()):
            w = set(w or ())
            if last is not None and x - last > apart * 86400 and not (w & seen):
                out.append((begin, last))
                seen, begin = set(), None
            begin = x if begin is None else begin
            seen |= w
            last = x
        if last is not None:
            out.append((begin, last))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["start_s", "end_s"])

    spans = runs.groupBy("stretch").applyInArrow(fold, "start_s long, end_s long")
    day = lambda c: F.floor(col(c) / 86400)
    spans = spans.where(day("end_s") - day("start_s") + 1 >= days)
    # All photos of the days: trips are exploded to their days, an equi-join.
    on_day = spans.withColumn("_day", F.explode(F.sequence(day("start_s"), day("end_s"))))
    p = photos.where("taken is not null").select("photo_id", F.floor(X.seconds("taken") / 86400).alias("_day"))
    p = p.join(in_album.select("photo_id", F.lit(1).alias("_a")).distinct(), "photo_id", "left") if in_album is not None else p.withColumn("_a", F.lit(None).cast("int"))
    p = p.join(on_day, "_day")
    good = p.groupBy("start_s").agg(F.count("*").alias("_n"), F.count("_a").alias("_in")).where((col("_n") >= least) & (col("_in") <= col("_n") * 0.6)).select("start_s")
    when = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return p.join(good, "start_s").select(col("start_s").alias("trip"), when("start_s").alias("start"), when("end_s").alias("end"), "photo_id")


def trips(photos: DataFrame, identities: DataFrame, home: DataFrame, in_album: DataFrame | None = None, least: int = 15, days: int = 3) -> DataFrame:
    """(start, end, n): the trips of ``trip_photos``."""
    return trip_photos(photos, identities, home, in_album, least, days).groupBy("start", "end").agg(F.count("*").alias("n"))


def gatherings(photos: DataFrame, identities: DataFrame, least: int = 8, window: int = 2 * 86400, used: DataFrame | None = None) -> DataFrame:
    """(start, n, people): windows of two days, each anchored at the first photo after the window before, with ``least`` photos and two people; photos ``used`` by other suggestions are left out.

    Windows on both sides of a gap longer than a window don't depend on each other, so only stretches without one are folded in order.
    """
    p = photos.where("taken is not null").join(identities.select("photo_id").distinct(), "photo_id", "left_semi")
    p = p if used is None else p.join(used, "photo_id", "left_anti")
    s = gap_islands(p.select("photo_id", "taken"), [], window, name="stretch").select("stretch", "photo_id", X.seconds("taken").alias("t"))

    def fold(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        out, begin = [], None
        for x in t.column("t").to_pylist():
            if begin is None or x >= begin + window:
                begin = x
            out.append(begin)
        return pa.table([t.column("stretch"), t.column("t"), pa.array(out, pa.int64())], names=["stretch", "t", "start_s"])

    # Distinct seconds only, so a stretch is bounded by its time.
    w = s.select("stretch", "t").distinct().groupBy("stretch").applyInArrow(fold, "stretch long, t long, start_s long")
    w = s.join(w, ["stretch", "t"]).select("photo_id", "start_s")
    g = w.join(identities, "photo_id").groupBy("start_s").agg(F.countDistinct("photo_id").alias("n"), F.countDistinct("cluster_id").alias("people"))
    return g.where((col("n") >= least) & (col("people") >= 2)).select(F.timestamp_seconds("start_s").cast("timestamp_ntz").alias("start"), "n", "people")


def near_in_time(rows: DataFrame, key: str, t: str, keys: list[str], width: int) -> DataFrame:
    """(a, b, delta): pairs within ``keys`` at most ``width`` seconds apart, by an equi-join on buckets of that width."""
    a = rows.select(*keys, col(key).alias("a"), col(t).alias("ta"), F.floor(col(t) / width).alias("_b"))
    b = rows.select(*keys, col(key).alias("b"), col(t).alias("tb"), F.explode(F.array(*[F.floor(col(t) / width) + k for k in (-1, 0, 1)])).alias("_b"))
    return a.join(b, [*keys, "_b"]).where((col("a") < col("b")) & (F.abs(col("ta") - col("tb")) <= width)).select("a", "b", F.abs(col("ta") - col("tb")).alias("delta"))

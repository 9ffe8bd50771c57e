from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from shutterlake.operators import grouping, identity, ingest, insights, memories, mutate, search, segments, spatial, timeline
from shutterlake.operators.graph import components
from shutterlake.streaming import library as streams

D = datetime


def photos(spark, rows):  # noqa: ANN001, ANN202
    """(photo_id, taken, trashed) as a table."""
    return spark.createDataFrame(rows, "photo_id long, taken timestamp_ntz, trashed boolean")


def test_year_counts(spark) -> None:  # noqa: ANN001
    p = photos(spark, [(1, D(2019, 1, 1), False), (2, D(2021, 1, 1), False), (3, D(2021, 2, 1), False), (4, None, False), (5, D(2021, 1, 1), True)])
    assert {tuple(r) for r in insights.year_counts(p.where("not trashed")).collect()} == {(2021, 2), (2019, 1), (None, 1)}


def test_neighbours(spark) -> None:  # noqa: ANN001
    p = photos(spark, [(1, D(2025, 1, 2), False), (2, D(2025, 1, 1), False), (3, D(2024, 12, 31), True), (4, None, False)]).where("not trashed")
    got = {r.photo_id: (r.prev_id, r.next_id) for r in timeline.neighbours(p).collect()}
    assert got[2] == (1, 4)
    assert got[4] == (2, None)


def test_pages_join_to_the_whole_list(spark) -> None:  # noqa: ANN001
    r = random.Random(1)
    p = photos(spark, [(i, D(2020, 1, 1) + timedelta(hours=r.randrange(30)) if i % 5 else None, False) for i in range(1, 60)])
    whole = [x.photo_id for x in timeline.in_order(p).collect()]
    got, cursor = [], None
    while rows := timeline.page(p, 7, cursor).collect():
        got += [x.photo_id for x in rows]
        cursor = timeline.decode_cursor(timeline.encode_cursor(rows[-1].taken, rows[-1].photo_id))
    assert got == whole
    assert timeline.page_with_more(p, 59).first().has_more is False
    with pytest.raises(ValueError, match="cursor"):
        timeline.decode_cursor("!!")


def test_day_ranges_cover_the_timeline(spark) -> None:  # noqa: ANN001
    p = photos(spark, [(i, D(2020, 1, 1 + i % 4) if i % 3 else None, False) for i in range(20)])
    rows = sorted(timeline.day_ranges(p).collect(), key=lambda r: r.start_index)
    assert rows[0].start_index == 0
    assert all(a.end_index == b.start_index for a, b in zip(rows, rows[1:]))
    assert (rows[-1].end_index, rows[-1].day) == (20, None)


def test_near_duplicates(spark) -> None:  # noqa: ANN001
    h = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 15), (5, 255), (6, 65535), (7, None)], "id long, phash long")
    assert sorted(r.id for r in grouping.near_groups(h, "id").collect()) == [1, 2, 3, 4, 5]
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(20)]
    hs = sorted({b ^ sum(1 << r.randrange(63) for _ in range(r.randrange(6))) for b in base for _ in range(8)})
    want = {(a, b) for a in hs for b in hs if a < b and (a ^ b).bit_count() <= 4}
    got = [tuple(x) for x in grouping.near_pairs(spark.createDataFrame([(x,) for x in hs], "phash long")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_components(spark) -> None:  # noqa: ANN001
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (50, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 50: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bursts_equal_the_sequential_rule(spark) -> None:  # noqa: ANN001
    r = random.Random(4)
    t, rows = D(2024, 1, 1), []
    for i in range(300):
        t += timedelta(seconds=r.choice([1, 2, 3, 20, 200]))
        rows.append((i, f"f{r.randrange(2)}", t))
    want = {}
    for f in ("f0", "f1"):
        group, start, last = [], None, None
        for i, _, x in [x for x in rows if x[1] == f] + [(None, f, None)]:
            if group and (i is None or (x - last).seconds > 30 or (x - start).total_seconds() > 60):
                if len(group) > 1:
                    want |= dict.fromkeys(group, group[0])
                group = []
            if i is not None:
                start = start if group else x
                group.append(i)
                last = x
    got = segments.bursts(spark.createDataFrame(rows, "photo_id long, folder string, taken timestamp_ntz"), 30, 60).collect()
    assert {x.photo_id: x.burst for x in got} == want


def test_islands_across_buckets(spark) -> None:  # noqa: ANN001
    times = [D(2024, 1, 1) + timedelta(hours=5 * i) for i in range(10)] + [D(2024, 1, 10)]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "photo_id long, taken timestamp_ntz")
    got = [r.island for r in segments.gap_islands(p, [], 5 * 3600).orderBy("photo_id").collect()]
    assert got == [1] * 10 + [2]


def test_trip_of_several_stops(spark) -> None:  # noqa: ANN001
    home = [(i, D(2024, 1, 1) + timedelta(days=7 * i), "Home", "A", 10.0, 10.0) for i in range(10)]
    away = [(100 + i, D(2024, 6, 1) + timedelta(hours=12 * i), f"Stop{i % 3}", "B", 40.0, 40.0) for i in range(16)]
    p = spark.createDataFrame(home + away + [(200, D(2024, 6, 3, 1), None, None, None, None)], "photo_id long, taken timestamp_ntz, city string, country string, lat double, lon double")
    none = spark.createDataFrame([], "photo_id long, cluster_id long")
    got = segments.trips(p, none, insights.home_city(p)).collect()
    assert [(r.start, r.end, r.n) for r in got] == [(D(2024, 6, 1), D(2024, 6, 8, 12), 17)]


def test_best_city(spark) -> None:  # noqa: ANN001
    c = [(1, 17.6868, 83.2185, 1_063_178, "PPLA2"), (2, 17.7330, 83.3162, 1_728_128, "PPL"), (3, 0.1, -179.7, 200_000, "PPL"), (4, 48.85, 2.35, 2_000_000, "PPLC")]
    cities = spark.createDataFrame(c, "id long, latitude double, longitude double, population long, feature_code string")
    p = spark.createDataFrame([(1, 17.72, 83.30), (2, 30.0, 30.0), (3, 0.0, 179.9), (4, None, None)], "photo_id long, lat double, lon double")
    assert {r.photo_id: r.city_id for r in spatial.best_city(p, cities, "photo_id").collect()} == {1: 1, 3: 3}


def test_viewports() -> None:
    assert spatial.Viewport.of(10, -10, 170, 200) == spatial.Viewport(-10, 10, 170, -160)
    assert spatial.Viewport.of(-100, 95, -400, 10) == spatial.Viewport(-90, 90, -180, 180)
    assert spatial.wrapped_ranges(179, 2) == [(177, 180.0), (-180.0, -179)]


NAMES = search.Names(((1, "Anna"), (2, "Anna Maria"), (3, "Bo")), (("Paris", "France"), ("Paris", "Texas"), ("Vizianagaram", "India")), ("France", "India"), ("Holiday 2019", "Work"))


@pytest.mark.parametrize("q", ["favourites videos 2025 Vizianagaram", "videos Vizianagaram favourites 2025", "2025 favourites Vizianagaram videos", "Vizianagaram 2025 videos favourites"])
def test_word_order_does_not_matter(q: str) -> None:
    p = search.compile_search(q, NAMES, date(2025, 6, 15))
    assert (p.favorite, p.media, p.cities, p.text, p.span) == (True, "video", (("Vizianagaram", "India"),), "", search.Span(date(2025, 1, 1), date(2025, 12, 31)))


def test_names_and_dates() -> None:
    today = date(2025, 6, 15)
    p = search.compile_search("only Anna Maria and Bo in Paris beach", NAMES, today)
    assert (set(p.people), p.only_people, len(p.cities), p.text) == ({2, 3}, True, 2, "beach")
    assert search.compile_search("in album holiday", NAMES, today).albums == ("Holiday 2019",)
    assert search.parse_date("winter 2019", today) == search.Span(date(2019, 12, 1), date(2020, 2, 29))
    assert search.parse_date("last autumn", today) == search.Span(date(2023, 9, 1), date(2023, 11, 30))
    assert search.parse_date("2025-13-01", today) is None
    assert search.compile_request("create an album of my videos last week", NAMES, today).intent == "create_album"


def test_complete_link_keeps_photos_apart() -> None:
    r = np.random.default_rng(1)
    x = np.repeat(np.eye(8)[:3], 5, axis=0) + r.normal(0, 0.02, (15, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = identity.complete_link(1 - x @ x.T, np.arange(15), 0.3)
    assert len(set(lab)) == 3
    assert all(len(set(lab[i : i + 5])) == 1 for i in (0, 5, 10))
    lab = identity.complete_link(1 - x @ x.T, np.array([1, 1, 2, 3, 4] * 3), 0.3)
    assert lab[0] != lab[1]


def test_ordered_union_respects_bars() -> None:
    import pandas as pd

    e = pd.DataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], columns=["a", "b", "score"])
    assert identity.ordered_union(e, {(1, 3)}, {}) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert identity.ordered_union(e, set(), {1: {7}, 3: {7}}) == {1: 1, 2: 1, 3: 3, 4: 3}


def test_retrieval_in_blocks(spark, monkeypatch) -> None:  # noqa: ANN001
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 64))
    f = identity.unit_vectors(spark.createDataFrame([(i, i % 4, [float(v) for v in x[i]]) for i in range(40)] + [(90, 1, None), (91, 1, [0.0] * 64), (92, 1, [1.0])], "face_id long, cluster_id long, embedding array<float>"))
    assert f.count() == 40
    g = f.select("cluster_id", f.face_id.alias("exemplar"), "unit")
    a = sorted(map(tuple, identity.matches(f, g, 0.1).collect()))
    monkeypatch.setattr(identity, "BLOCK", 7)
    assert sorted(map(tuple, identity.matches(f, g, 0.1).collect())) == a != []


def test_boxes(spark) -> None:  # noqa: ANN001
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.9), (1, 2, 0.1, 0.0, 1.1, 1.0, 0.8), (1, 3, 2.0, 2.0, 3.0, 3.0, 0.7)], "photo_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.box_id for r in identity.suppressed(b).collect()) == [1, 3]


def test_change_set(spark) -> None:  # noqa: ANN001
    old = spark.createDataFrame([(1, "a", 1, 1, "h1"), (2, "b", 1, 1, "h1"), (3, "c", 1, 1, "h3"), (4, "d", 1, 1, None)], "photo_id long, file_path string, file_size long, mtime long, file_hash string")
    new = spark.createDataFrame([("x", 1, 1, "h1"), ("c", 2, 1, "h3"), ("y", 1, 1, "h9")], "file_path string, size long, mtime long, file_hash string")
    got = {tuple(r) for r in ingest.change_set(old, new).collect()}
    assert got == {("moved", 1, "x"), ("missing", 2, "b"), ("missing", 4, "d"), ("added", None, "y"), ("modified", 3, "c")}


def test_writes_are_idempotent(spark) -> None:  # noqa: ANN001
    old = spark.createDataFrame([("a", 1, "Paris")], "file_path string, file_size long, city string")
    new = spark.createDataFrame([("a", 2, "Rome"), ("b", 3, "Oslo")], "file_path string, file_size long, city string")
    once = ingest.upserted(old, new, "file_path", ["city"])
    assert {tuple(r) for r in once.collect()} == {("a", 2, "Paris"), ("b", 3, "Oslo")}
    assert {tuple(r) for r in ingest.upserted(once, new, "file_path", ["city"]).collect()} == {("a", 2, "Paris"), ("b", 3, "Oslo")}
    assert ingest.inserted(ingest.inserted(old, new), new).count() == 2
    p = photos(spark, [(1, None, False), (2, None, True)]).selectExpr("*", "cast(null as timestamp_ntz) as trashed_at")
    ids = spark.createDataFrame([(1,), (2,)], "photo_id long")
    assert [r.trashed for r in mutate.restored(mutate.trashed(p, ids, "2025-01-01"), ids).collect()] == [False, False]


def test_published_versions(spark, tmp_path) -> None:  # noqa: ANN001
    mutate.publish(spark.range(3), str(tmp_path))
    mutate.publish(mutate.current(spark, str(tmp_path)).where("id > 0"), str(tmp_path))
    assert mutate.current(spark, str(tmp_path)).count() == 2


def test_file_metadata(spark, tmp_path) -> None:  # noqa: ANN001
    import struct
    import zipfile

    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("Photos from 2019/a.jpg", b"12345")
        z.writestr("Photos from 2019/a.jpg.json", b"{}")
    (tmp_path / "bad.zip").write_bytes(b"no")
    files = ingest.listed(spark, str(tmp_path))
    assert sorted((r.name, r.size, r.is_sidecar) for r in ingest.zip_inventory(files).collect()) == [("Photos from 2019/a.jpg", 5, False), ("Photos from 2019/a.jpg.json", 2, True)]
    ifd = struct.pack("<H", 2) + struct.pack("<HHI4s", 0x010F, 2, 4, b"Abc\0") + struct.pack("<HHII", 0x8825, 4, 1, 38) + struct.pack("<I", 0)
    gps = struct.pack("<H", 2) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, 68) + struct.pack("<I", 0)
    exif = b"\xff\xd8Exif\x00\x00II*\x00" + struct.pack("<I", 8) + ifd + gps + struct.pack("<6I", 10, 1, 30, 1, 0, 1)
    assert ingest.exif_tags(exif) == {"make": "Abc", "lat": -10.5}
    assert ingest.exif_tags(exif[:40]) in ({}, {"make": "Abc"})
    assert ingest.exif_tags(b"") == {}
    mvhd = b"....mvhd\x00\x00\x00\x00" + struct.pack(">I", 3_600_000_000) + b"rest"
    assert ingest.quicktime_date(mvhd) == D(1904, 1, 1) + timedelta(seconds=3_600_000_000)
    assert ingest.quicktime_date(b"mvhd") is None
    (tmp_path / "cities.txt").write_text("﻿# note\n" + "\t".join(["7", "Zürich", "Zurich", "", "47.3", "8.5", "P", "PPLA", "CH", "", "", "", "", "", "400000", "", "", "Europe/Zurich", ""]) + "\nshort\n", "utf-8")
    (tmp_path / "countries.txt").write_text("CH\tCHE\t756\tSZ\tSwitzerland\n", "utf-8")
    assert [(r.id, r.country_name) for r in ingest.tsv_cities(spark, str(tmp_path / "cities.txt"), str(tmp_path / "countries.txt")).collect()] == [(7, "Switzerland")]


def test_names_with_dates(spark) -> None:  # noqa: ANN001
    n = ["IMG_20190203_101112.jpg", "2019-02-03 10.11.12.png", "scan 2019-02-03.tif", "20191399_999999", "IMG_1234", "IMG-20201231-WA0007.jpg", "Screenshot 2019-02-03 at 14.30.22.png"]
    d = spark.createDataFrame([(x,) for x in n], "name string")
    assert [r[0] for r in d.select(ingest.name_date("name", 2025)).collect()] == [D(2019, 2, 3, 10, 11, 12), D(2019, 2, 3, 10, 11, 12), None, None, None, D(2020, 12, 31), D(2019, 2, 3, 14, 30, 22)]


def test_memories(spark) -> None:  # noqa: ANN001
    today = date(2025, 6, 15)
    p = photos(spark, [(1, D(2020, 6, 15), False), (2, D(2021, 6, 15), False), (3, D(2025, 6, 15), False), (4, D(2022, 6, 17), False)])
    assert sorted(r.photo_id for r in memories.on_this_day(p, today).collect()) == [1, 2]
    assert memories.around_this_day(p, today).count() == 0
    assert [r.photo_id for r in memories.around_this_day(p.where("photo_id = 4"), today).collect()] == [4]
    pool = [("a", i, 1000 * i, float(i == 3), "h" if i in (4, 5) else str(i), None, None) for i in range(6)]  # copies
    pool += [("b", i, 1000 * i, float(i), str(i), 7 if i < 3 else None, None) for i in range(4)]  # look-alikes
    pool += [("c", i, 10 * i, 1.0, str(i), None, None) for i in range(5)] + [("d", 1, None, 1.0, None, None, 3), ("d", 2, None, 2.0, None, None, 3)]  # of one minute; of one burst, undated
    df = spark.createDataFrame(pool, "key string, photo_id long, t long, score double, file_hash string, phash long, burst long")
    got: dict = {}
    for r in sorted(memories.collages(df).collect(), key=lambda r: r.position):
        got.setdefault(r.key, []).append(r.photo_id)
    assert got["a"][0] == 3
    assert len(got["a"]) == 4
    assert not {4, 5} <= set(got["a"])
    assert got["b"] == [3, 0]
    assert got["c"] == [0, 1, 2, 3]
    assert got["d"] == [2, 1]
    assert memories.collages(df.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path) -> None:  # noqa: ANN001
    e = spark.createDataFrame([(1, D(2024, 1, 1, 0, 0, s)) for s in (0, 5, 9, 40, 41)] + [(2, D(2024, 1, 1, 1))], "user long, ts timestamp")
    e.write.parquet(str(tmp_path / "e"))
    s = streams.tables(spark, str(tmp_path / "e"), e)
    got = streams.collected(streams.sessions(s, "ts", "1 minute", "10 seconds", ["user"]), "complete")
    assert sorted((r.user, r.n) for r in got.collect()) == [(1, 2), (1, 3), (2, 1)]
    merge = streams.merging(str(tmp_path / "m"), "user", "ts")
    streams.run_once(streams.tables(spark, str(tmp_path / "e"), e), merge)
    assert spark.read.parquet(str(tmp_path / "m/0")).count() == 2


def test_camera_names(spark) -> None:  # noqa: ANN001
    from shutterlake.functions import cameras

    rows = [
        ("Xiaomi", "m2007j20ci", "Xiaomi Poco X3 NFC"), ("SONY", "ILCE-7M3", "Sony α7 III"), ("SONY", "ILCE-7RM4", "Sony α7R IV"), ("SONY", "ILCE-6400", "Sony α6400"), ("SONY", "DSC-RX100M5A", "Sony RX100 VA"), ("SONY", "DSC-W830", "Sony W830"),
        ("Apple", "iPhone15,2", "iPhone 14 Pro"), ("Apple", "iPhone 12", "Apple iPhone 12"), ("Canon", "EOS R5", "Canon EOS R5"), ("Canon", "Canon PowerShot S110", "Canon PowerShot S110"), ("UnknownMaker", "xyz123abc", "UnknownMaker XYZ123ABC"),
        ("NIKON CORPORATION", "Z 6", "Nikon Z 6"), ("FUJIFILM", "X-T4", "Fujifilm X-T4"), ("Google", "Pixel 7 Pro", "Google Pixel 7 Pro"), ("ACME", "GREAT CAM", "ACME Great Cam"), (None, None, None), (" \x00", '"', None), ('"OnePlus", "", ""', "x1", "OnePlus X1"), ("Only", None, "Only"),
    ]
    d = spark.createDataFrame(rows, "make string, model string, want string")
    for r in d.select("want", cameras.friendly_name(d.make, d.model).alias("got")).collect():
        assert r.got == r.want
    csv = spark.createDataFrame([("Acme", "Acme One", "d", "a-1"), ("Acme", "Two", "d", "A-2"), ("Acme", "", "d", "A-3")], "retail_branding string, marketing_name string, device string, model string")
    assert sorted(map(tuple, cameras.device_names(csv).collect())) == [("A-1", "Acme One"), ("A-2", "Acme Two")]


def test_the_older_grammar() -> None:
    today = date(2025, 6, 15)
    assert search.compile_simple("Dad in Tokyo", today) == search.Plan(text="Dad", cities=(("Tokyo", ""),))
    assert search.compile_simple("new york 2019", today).cities == (("new york", ""),)
    assert search.compile_simple("old museum", today).cities == (("old museum", ""),)
    assert search.compile_simple("Dad", today) == search.Plan(text="Dad")
    assert search.compile_simple("march 2019", today).span is not None


def test_names_come_back_by_the_words_of_the_query(spark) -> None:  # noqa: ANN001
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "Bob"), (3, None)], "cluster_id long, name string")
    p = spark.createDataFrame([("Bern", "Land A"), ("Basel", "Land B"), ("Bern", "Land B"), (None, "Land C")], "city string, country string")
    albums = spark.createDataFrame([("Summer 2019",), ("Winter",)], "album string")
    n = search.names_of(people, p, albums, "bob and ann, bern land a, album summ")
    assert n.people == ((2, "Bob"),)
    assert n.cities == (("Bern", "Land A"), ("Bern", "Land B"))
    assert n.countries == ("Land A", "Land B")
    assert n.albums == ("Summer 2019",)
    assert search.names_of(people, p, albums, "") == search.Names()
    want = search.fuzzy("ber", ["Bern", "Basel", "Bergen", "abber"])
    assert [r.name for r in search.near_names(spark.createDataFrame([("Bern",), ("Basel",), ("Bergen",), ("abber",)], "name string"), "name", "ber").collect()] == want

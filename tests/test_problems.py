from __future__ import annotations

import math
import random

from shutterlake.operators import orphans, regions

REF = "record_key long, ref string, at timestamp_ntz, kind string"


def _orphans(spark, refs, parents):  # noqa: ANN001, ANN202
    r = spark.createDataFrame(refs, "record_key long, ref string, at string, kind string").selectExpr("record_key", "ref", "cast(at as timestamp_ntz) as at", "kind")
    p = spark.createDataFrame(parents, "key string, known_at string, ref string").selectExpr("key", "cast(known_at as timestamp_ntz) as known_at", "ref")
    return sorted((x.record_key, x.period, x.kind) for x in orphans.orphan_references([orphans.References("t", r)], p).collect())


def test_orphans(spark) -> None:  # noqa: ANN001
    parents = [("a", "2024-01-01", "z"), ("a", "2024-03-01", "z"), ("b", None, "z"), (None, "2020-01-01", "z"), ("c", "2024-05-01", "z")]
    refs = [(1, "a", "2024-02-01", "x"), (2, "b", "2020-01-01", "x"), (3, "c", "2024-02-01", "x"), (4, "gone", "2024-02-01", "x"), (5, "gone", None, "x"), (6, None, "2024-02-01", "x"), (4, "gone", "2024-02-01", "x"), (7, "c", None, "x"), (8, "", "2024-02-01", "x")]
    want = [(3, "2024-02", "late"), (4, "2024-02", "missing"), (5, "unknown", "missing"), (8, "2024-02", "missing")]
    assert _orphans(spark, refs, parents) == [(str(a), b, c) for a, b, c in want]
    assert _orphans(spark, [], parents) == []
    assert len(_orphans(spark, refs, [])) == 7


def test_orphans_with_a_full_filter(spark, monkeypatch) -> None:  # noqa: ANN001
    """A filter that lets everything through changes nothing."""
    monkeypatch.setattr(orphans, "MAX_BITS", 1 << 13)
    parents = [(f"k{i}", "2020-01-01", "z") for i in range(20_000)]
    refs = [(i, f"k{i}", "2021-01-01", "x") for i in range(19_990, 20_010)]
    assert [x[0] for x in _orphans(spark, refs, parents)] == [str(i) for i in range(20_000, 20_010)]


def test_hash_spelling(spark) -> None:  # noqa: ANN001
    d = spark.createDataFrame([(" ABC\t",), (" aBc",), (None,)], "h string")
    assert [r[0] for r in d.select(orphans.norm_hash(d.h)).collect()] == ["abc", "abc", None]


def km(a: tuple, b: tuple) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def test_points_near(spark) -> None:  # noqa: ANN001
    r = random.Random(3)
    centres = [(i, r.choice([-89.9, -89.7, -60, 0, 0.05, 45, 89.8]) + r.uniform(-0.1, 0.1), r.choice([-180, 180, 0, 30]) + r.uniform(-0.2, 0.2)) for i in range(40)]
    centres = [(i, a, (o + 180) % 360 - 180) for i, a, o in centres] + [(99, 90.0, 0.0), (98, None, 1.0), (97, 0.0, 0.0)]
    points = [(k, max(-90.0, min(90.0, a + r.uniform(-0.4, 0.4))), (o + r.uniform(-1, 1) / max(0.02, math.cos(math.radians(a))) + 180) % 360 - 180) for k, (_, a, o) in enumerate(centres[:40] * 6)]
    points += [(1000, None, 1.0), (1001, float("nan"), 0.0), (1002, 0.0, 0.0), (1003, 91.0, 0.0), points[0]]
    want = {(p[0], c[0]) for p in points for c in centres if p[0] < 1000 and c[1] is not None and c[0] != 97 and km(p[1:], c[1:]) <= 25}
    got = [tuple(x) for x in regions.points_near(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(centres, "region long, lat double, lon double"), 25.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_crossing_parity(spark) -> None:  # noqa: ANN001
    """A concave region; points on its western side are in, on its eastern side out; a corner's level crosses once."""
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    edges = [(7, 0, *corners[i], *corners[(i + 1) % 5]) for i in range(5)]
    points = [(1, 0.5, 1.0), (2, 2.5, 2.0), (3, 1.0, 2.0), (4, 1.0, 1.0), (5, 2.0, 0.0), (6, 2.0, 4.0), (7, 2.5, 0.2)]
    got = regions.points_in_regions(spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(edges, "region long, turn int, x1 double, y1 double, x2 double, y2 double"))
    assert sorted(r.p for r in got.collect()) == [1, 3, 4, 5, 7]


def test_salted_join_is_the_same(spark, monkeypatch) -> None:  # noqa: ANN001
    points = spark.createDataFrame([(i, 10 + i / 500, 20.0) for i in range(200)], "point_id long, lat double, lon double")
    centres = spark.createDataFrame([(1, 10.2, 20.1)], "region long, lat double, lon double")
    a = sorted(map(tuple, regions.points_near(points, centres, 25).collect()))
    monkeypatch.setattr(regions, "MAX_BROADCAST_ROWS", -1)
    assert sorted(map(tuple, regions.points_near(points, centres, 25).collect())) == a != []

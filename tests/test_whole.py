"""Queries do the whole job: nothing is cut by a bound on the number of rows."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from shutterlake.operators import identity
from shutterlake.plans import people
from shutterlake.sources.library import Library

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_union_equals_one_list_over_all_edges(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, (2, 500))
    e = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": rng.integers(70, 99, 500) / 100}).query("a < b").drop_duplicates(["a", "b"])
    whole = identity.ordered_union(e, set(), {i: {i % 150} for i in range(400)})
    got = identity.united(spark.createDataFrame(e), spark.createDataFrame([(i, i % 150) for i in range(400)], "cluster_id long, photo_id long"))
    assert {r.cluster_id: r.survivor for r in got.collect()} == whole
    assert len(whole) > 300


@tables
def test_clusters_are_united_by_every_edge(spark) -> None:  # noqa: ANN001
    """FC05 against one ordered list of all pairs on the driver, with its bars."""
    L = Library(spark, DATA)
    scores = identity.cluster_scores(identity.exemplars(people.vectors(L))).where("score >= 0.55").toPandas()[["a", "b", "score"]]
    photos: dict = {}
    for r in L.identities().where("photo_id is not null").collect():
        photos.setdefault(r.cluster_id, set()).add(r.photo_id)
    bars = {(r.a, r.b) for r in people._apart(L).collect()}
    assert {r.cluster_id: r.survivor for r in people.QUERIES["FC05"](spark, DATA).collect()} == identity.ordered_union(scores, bars, photos)
    assert len(scores) > 3


def test_barred_clusters_stay_apart(spark) -> None:  # noqa: ANN001
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.7)], "a long, b long, score double")
    p = spark.createDataFrame([(i, i) for i in range(6)], "cluster_id long, photo_id long")
    bars = spark.createDataFrame([(3, 1), (1, 9)], "a long, b long")
    assert {r.cluster_id: r.survivor for r in identity.united(e, p, bars).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_more_than_fifty_thousand_edges(spark) -> None:  # noqa: ANN001
    e = spark.range(50_500).selectExpr("id * 2 as a", "id * 2 + 1 as b", "0.6D as score")
    assert identity.united(e, e.selectExpr("a as cluster_id", "a as photo_id")).where("cluster_id <> survivor").count() == 50_500


@tables
def test_galleries_stream(spark) -> None:  # noqa: ANN001
    """FC09 against the rule taken literally, in memory."""
    f = people.vectors(Library(spark, DATA)).where("cluster_id is not null").collect()
    groups: dict = {}
    for r in sorted(f, key=lambda r: (-r.user_confirmed, -r.confidence, r.face_id)):
        groups.setdefault(r.cluster_id, []).append(r)
    want = set()
    for c, rows in groups.items():
        own = rows[:5]
        for r in rows[5:]:
            sims = [np.dot(o.unit, r.unit) for o in own]
            free = [k for k, o in enumerate(own) if o.user_confirmed <= 0]
            if min(sims) < 0.97 and free:
                k = max(free, key=lambda k: (sum(np.dot(o.unit, own[k].unit) for o in own), own[k].face_id))
                own[k] = r
        want |= {(c, o.face_id) for o in own}
    got = identity.diverse(people.vectors(Library(spark, DATA)), 5, 0.97).collect()
    assert {(r.cluster_id, r.exemplar) for r in got} == want


@tables
def test_rescue_leaves_no_face_alone_that_a_gallery_takes(spark) -> None:  # noqa: ANN001
    """FC06: without conflicts on a photo, rescue is retrieval with its own bands, and the rest stand alone."""
    got = {r.face_id: r.cluster_id for r in people.QUERIES["FC06"](spark, DATA).collect()}
    v = people.vectors(Library(spark, DATA)).collect()
    gallery: dict = {}
    for r in sorted((r for r in v if r.cluster_id is not None and r.user_confirmed >= 0), key=lambda r: (-r.user_confirmed, -r.confidence, r.face_id)):
        gallery.setdefault(r.cluster_id, []).append(r) if len(gallery.get(r.cluster_id, [])) < 30 else None
    held: dict = {}
    for r in v:
        if r.cluster_id is not None:
            held.setdefault(r.photo_id, set()).add(r.cluster_id)
    alone = Counter(r.photo_id for r in v if r.cluster_id is None and r.user_confirmed >= 0)
    checked = 0
    for r in v:
        if r.cluster_id is None and r.user_confirmed >= 0 and alone[r.photo_id] == 1:
            hits = []
            for c, members in gallery.items():
                sims = sorted((s for s in (round(float(np.dot(m.unit, r.unit)), 6) for m in members) if s >= 0.45), reverse=True)[:5]
                if sims and c not in held.get(r.photo_id, ()):
                    hits.append((round(sum(sims) / len(sims) + 1e-9, 6), -c))
            hits.sort(reverse=True)
            ok = hits and hits[0][0] >= 0.60 and (len(hits) == 1 or hits[0][0] - hits[1][0] >= 0.08)
            assert got[r.face_id] == (-hits[0][1] if ok else -r.face_id)
            checked += 1
    assert checked > 20


def faces(spark, rows):  # noqa: ANN001, ANN202
    """Faces (face_id, photo_id, cluster_id, embedding) with unit vectors."""
    f = spark.createDataFrame([(i, p, c, [float(v) for v in x]) for i, p, c, x in rows], "face_id long, photo_id long, cluster_id long, embedding array<double>")
    return identity.unit_vectors(f.selectExpr("*", "0 as user_confirmed", "0.9 as confidence"))


def at(axis: int, cosine: float, other: int) -> np.ndarray:
    """A unit vector of that cosine to an axis."""
    x = np.zeros(64)
    x[axis], x[other] = cosine, (1 - cosine**2) ** 0.5
    return x


@pytest.mark.parametrize("most", [256, 1])
def test_pipeline_of_faces(spark, most: int) -> None:  # noqa: ANN001
    rows = [
        (1, 1, 100, at(0, 1.0, 1)), (2, 2, 100, at(0, 1.0, 1)),
        (3, 3, None, at(0, 0.95, 2)),  # assigned to 100
        (4, 3, None, at(0, 0.95, 3)),  # 100 is on photo 3 by now
        (10, 10, None, at(5, 1.0, 6)), (11, 11, None, at(5, 0.95, 6)), (12, 12, None, at(5, 0.95, 7)),  # a new person
        (20, 20, 200, at(8, 1.0, 9)), (21, 21, 300, at(8, 0.6, 10)),  # unified
        (30, 30, None, at(8, 0.65, 11)),  # rescued
        (40, 40, None, at(20, 1.0, 21)),  # alone
    ]
    got = {r.face_id: r.cluster_id for r in identity.pipeline(faces(spark, rows), most=most).collect()}
    assert got == {1: 100, 2: 100, 3: 100, 4: -4, 10: 310, 11: 310, 12: 310, 20: 200, 21: 200, 30: 200, 40: -40}


@tables
def test_every_face_ends_in_a_cluster(spark) -> None:  # noqa: ANN001
    got = people.QUERIES["FC07"](spark, DATA).collect()
    shown = {r.face_id for r in Library(spark, DATA).faces().where("user_confirmed >= 0").collect()}
    assert shown <= {r.face_id for r in got if r.cluster_id is not None}


def test_large_clusters_are_split_as_well(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(5)
    rows = [(i, i // 2, 1, at(i % 3, 0.97, 10 + int(rng.integers(40)))) for i in range(300)]
    f = faces(spark, rows)
    got = {r.face_id: r.part for r in identity.split_clusters(f).collect()}
    roots = {r.cluster_id: r.survivor for r in identity.linked(f).collect()}
    size = Counter(roots.values())
    assert got == {i: roots[i] if i in roots and size[roots[i]] > 1 else -1 for i in range(300)}
    assert len(size) < 150
    assert {r.cluster_id for r in identity.split_clusters(f, most=299).collect()} == {1}
    near = sorted(map(tuple, identity.nearest_within(f, 0.7).collect()))
    assert sorted(map(tuple, identity.nearest_within(f, 0.7, block=40).collect())) == near
    assert len(near) > 300


@tables
def test_clusters_are_unified_by_whole_galleries(spark, monkeypatch) -> None:  # noqa: ANN001
    sizes, made = [], identity.exemplars
    monkeypatch.setattr(identity, "exemplars", lambda f, n=30: sizes.append(n) or made(f, n))
    people.QUERIES["FC05"](spark, DATA)
    assert sizes == [30]


@tables
def test_large_galleries_meet_in_blocks(spark, monkeypatch) -> None:  # noqa: ANN001
    v = people.vectors(Library(spark, DATA))
    g = identity.exemplars(v)
    whole = sorted(map(tuple, identity.matches(v, g, 0.5).collect()))
    monkeypatch.setattr(identity, "BLOCK", 30)
    assert sorted(map(tuple, identity.matches(v, g, 0.5).collect())) == whole
    assert len(whole) > 100


def crowd(spark, n: int = 60):  # noqa: ANN001, ANN202
    """Faces of clusters and of none, and the galleries."""
    rng = np.random.default_rng(11)
    v = faces(spark, [(i, i, None if i % 2 else i % 12, at(i % 5, 0.8, 10 + int(rng.integers(8)))) for i in range(n)])
    return v.where("cluster_id is null"), identity.exemplars(v)


@pytest.mark.parametrize("block", [100_000, 7])
def test_retrieval_shuffles_no_single_match(spark, monkeypatch, block: int) -> None:  # noqa: ANN001
    """Scores in one pass are those of all matches; with the best two only, bands are the same."""
    monkeypatch.setattr(identity, "BLOCK", block)
    f, g = crowd(spark)
    sims: dict = {}
    for r in identity.matches(f, g, 0.3).collect():
        sims.setdefault((r.face_id, r.cluster_id), []).append((-r.sim, r.exemplar))
    want = {k: (round(-sum(s for s, _ in sorted(v)[:5]) / min(5, len(v)) + 1e-9, 6), min(v)[1], len(v)) for k, v in sims.items()}
    all_ = identity.retrieved(f, g, 0.3)
    assert {(r.face_id, r.cluster_id): (r.score, r.best, r.n) for r in all_.collect()} == want
    assert len(want) > 50
    assert sorted(map(tuple, identity.banded(identity.retrieved(f, g, 0.3, best=2)).collect())) == sorted(map(tuple, identity.banded(all_).collect()))
    plan = identity.retrieved(f, g, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan.split("MapInArrow")[0]


def test_tiles_part_no_cluster(spark, monkeypatch) -> None:  # noqa: ANN001
    """FC06: scores are whole however small the products are, and those that no band can take aren't shuffled."""
    f, g = crowd(spark)
    whole = sorted(map(tuple, identity.retrieved(f, g, 0.3).collect()))
    for name, size in (("TILE", 3), ("FACES", 4), ("HELD", 1), ("ROWS", 2), ("PAIRS", 5)):
        monkeypatch.setattr(identity, name, size)
    assert sorted(map(tuple, identity.retrieved(f, g, 0.3).collect())) == whole
    assert sorted(map(tuple, identity.retrieved(f, g, 0.3, least=0.6).collect())) == [r for r in whole if r[2] >= 0.6] != whole


def test_a_norm_is_taken_once(spark) -> None:  # noqa: ANN001
    """The norm isn't put into the division of each element."""
    f = spark.createDataFrame([(1, [3.0] * 64)], "face_id long, embedding array<float>")
    plan = identity.unit_vectors(f)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_divide" in plan or "/" in plan
    assert " / sqrt(" not in plan and "/ SQRT(" not in plan
    assert identity.unit_vectors(f).first().unit == [0.125] * 64


def test_neighbours_and_clusters_meet_in_the_shared_folder(spark, monkeypatch) -> None:  # noqa: ANN001
    """FC07: neither faces nor exemplars are copied for the blocks they meet, and single matches aren't shuffled."""
    f, g = crowd(spark)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    one = f.selectExpr("0L as cluster_id", "face_id", "unit")
    near = identity.nearest_within(one, 0.5, 3)
    whole, x = sorted(map(tuple, near.collect())), {r.face_id: np.array(r.unit) for r in f.collect()}
    want = set()
    for a in x:
        hits = sorted((-round(float(x[a] @ x[b]), 6), b) for b in x if b != a)
        want |= {(min(a, b), max(a, b), -v) for v, b in hits[:3] if -v >= 0.5}
    assert set(whole) == want and want
    monkeypatch.setattr(identity, "QUERIES", 3)
    blocks = identity.nearest_within(one, 0.5, 3, block=7)
    assert sorted(map(tuple, blocks.collect())) == whole
    assert "CoGroup" not in plan(blocks)
    scores = identity.cluster_scores(g, 0.3)
    before = sorted(map(tuple, scores.collect()))
    monkeypatch.setattr(identity, "BLOCK", 4)
    assert sorted(map(tuple, identity.cluster_scores(g, 0.3).collect())) == before != []
    assert "Window" not in plan(scores)
    assert sorted(map(tuple, identity.cluster_scores(g, 0.3, least=0.6).collect())) == [r for r in before if r[2] >= 0.6]


@pytest.mark.parametrize("query", ["matches", "retrieved"])
def test_a_task_holds_a_bounded_part_of_its_matches(spark, monkeypatch, query: str) -> None:  # noqa: ANN001
    """JN15, FC01: nothing that a task holds grows with the gallery, though every exemplar matches every face."""
    own, g = (pa.array(range(n), pa.int64()) for n in (500, 8000))
    units = lambda n: pa.array([at(0, 0.8, 1 + i % 60).tolist() for i in range(n)])
    f = spark.createDataFrame(pa.table({"face_id": pa.compute.add(own, 10_000), "unit": units(500)}))
    gallery = pa.table({"cluster_id": pa.compute.divide(g, 16), "exemplar": g, "unit": units(8000)})
    monkeypatch.setattr(type(f), "mapInArrow", lambda _, scan, schema: scan)

    def peak(n: int) -> int:
        scan = getattr(identity, query)(f, spark.createDataFrame(gallery.slice(0, n)), 0.3)
        batch = f.toArrow().combine_chunks().to_batches()[0]
        tracemalloc.start()
        rows = sum(b.num_rows for b in scan(iter([batch])))
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert rows == 500 * (n if query == "matches" else n // 16)
        return most

    assert peak(8000) < 1.5 * peak(2000)


def test_a_worker_of_a_scan_is_small(spark, monkeypatch) -> None:  # noqa: ANN001
    """JN15: a Python worker holds a part of a large gallery, few matches, and no library that a scan doesn't use."""
    rng, parts, made = np.random.default_rng(5), [], identity._parts
    units = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(np.tile(at(0, 1, 1), n) + 0.01 * rng.standard_normal(n * 64)), 64).cast(pa.list_(pa.float64()))
    f = spark.createDataFrame(pa.table({"face_id": pa.array(np.arange(300) + 100_000), "unit": units(300)}))
    g = spark.createDataFrame(pa.table({"cluster_id": pa.array(np.arange(40_000) // 16), "exemplar": pa.array(np.arange(40_000)), "unit": units(40_000)}))
    monkeypatch.setattr(identity, "_parts", lambda t: parts.append(t.num_rows) or made(t))
    monkeypatch.setattr(type(f), "mapInArrow", lambda _, scan, schema: scan)
    scan = identity.matches(f, g, 0.3)
    batch = f.toArrow().combine_chunks().to_batches()[0]
    tracemalloc.start()
    rows = sum(b.num_rows for b in scan(iter([batch])))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 300 * 40_000 and sum(parts) == 40_000
    assert max(parts) < 10_000 and most < 48e6
    subprocess.run([sys.executable, "-c", "import shutterlake.operators.identity, sys; assert 'pandas' not in sys.modules"], check=True, cwd=Path(identity.__file__).parents[2])

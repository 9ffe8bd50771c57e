"""Faces and people: retrieval from a gallery, constrained clustering, unification and upkeep.

Scores of all pairs that matter come from blocked matrix products on the executors. The merges that depend on their order (each one changes which
next ones are allowed) run per connected component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.graph import components
from shutterlake.operators.timeline import top_per_group
from shutterlake.session import discard, in_blocks, written

if TYPE_CHECKING:  # each Python worker would hold it, some 27 MB
    import pandas as pd

col = F.col
DIMS = 64
#: Exemplars of a gallery that is broadcast (16 MB), rows of a block beyond, and rows of a block that a scan holds.
BLOCK, PART = 32_768, 8192
#: Faces and exemplars of one product, which stays in the cache, and similarities of a product at most.
FACES, TILE, CELLS = 512, 512, 4_000_000
#: Pairs whose similarities are taken in double precision at once, matches held before they are passed on, and rows of a batch returned.
PAIRS, HELD, ROWS = 1 << 14, 1 << 16, 1 << 16
#: Faces whose neighbours one task looks for, where a cluster has several blocks.
QUERIES = 8192
#: Edges of small components that one task unites.
TASK_EDGES = 20_000
LOW, HIGH, GAP = 0.40, 0.65, 0.12
#: Least score of two clusters that are united.
ALIKE = 0.55


def unit_vectors(faces: DataFrame, vec: str = "embedding") -> DataFrame:
    """``faces`` with unit, the embedding scaled to length 1 in double precision; unusable embeddings are left out."""
    x = F.transform(vec, lambda v: v.cast("double"))
    good = (F.size(vec) == DIMS) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    # The norm is the argument of a function: as a column it would be put into the division and taken anew for each element.
    unit = F.transform(F.array(norm), lambda n: F.transform(x, lambda v: F.try_divide(v, n)))[0]
    return faces.where(good).withColumn("unit", unit).drop(vec)


def _matrix(a: pa.Array) -> np.ndarray:
    return np.asarray(a.flatten(), dtype=np.float64).reshape(-1, DIMS)


def _runs(clusters: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, end) of runs of up to ``size`` rows that part no cluster; a larger cluster is a run."""
    ends = np.append(np.flatnonzero(clusters[1:] != clusters[:-1]) + 1, len(clusters))
    out, start = [], 0
    while start < len(clusters):
        k = int(np.searchsorted(ends, start + size, "right")) - 1
        end = int(ends[k] if k >= 0 and ends[k] > start else ends[k + 1])
        out.append((start, end))
        start = end
    return out


def _hits(own: np.ndarray, x: np.ndarray, clusters: np.ndarray, ids: np.ndarray, g: np.ndarray, min_sim: float | np.ndarray, step: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the face, row of the exemplar, similarity) of the pairs of at least ``min_sim`` (of all faces, or of each), by face and exemplar. What is passed on at once is bounded and has all
    matches of a face with a cluster; with ``step``, of each so many faces."""
    runs, y, h = _runs(clusters, TILE), x.astype(np.float32), g.astype(np.float32)
    step = step or max(1, min(FACES, CELLS // max([1, *(e - s for s, e in runs)])))
    low = np.broadcast_to(min_sim, len(own))
    for s in range(0, len(own), step):
        found, n = [], 0
        for start, end in runs:
            at = np.flatnonzero(y[s : s + step] @ h[start:end].T >= (low[s : s + step, None] - 1e-5).astype(np.float32))  # single precision only leaves out
            for k in range(0, len(at), PAIRS):
                i, j = np.divmod(at[k : k + PAIRS], end - start)
                i, j = i + s, j + start
                sim = np.round(np.einsum("ij,ij->i", x[i], g[j]), 6)
                keep = (sim >= low[i]) & (own[i] != ids[j])
                found.append((i[keep], j[keep], sim[keep]))
                n += len(found[-1][0])
            if n and (n >= HELD or end == len(g)):
                i, j, sim = (np.concatenate(c) for c in zip(*found))
                o = np.argsort(i, kind="stable")
                yield i[o], j[o], sim[o]
                found, n = [], 0


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns in batches of bounded size."""
    for s in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + ROWS]) for c in columns], names=names)


def _parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clusters, exemplars, units) of a gallery, by cluster and exemplar."""
    t = t.sort_by([("cluster_id", "ascending"), ("exemplar", "ascending")])
    return np.asarray(t.column("cluster_id")), np.asarray(t.column("exemplar")), _matrix(t.column("unit").combine_chunks()) if t.num_rows else np.zeros((0, DIMS))


_Found = Callable[..., Iterator[pa.RecordBatch]]


def _scanned(faces: DataFrame, gallery: DataFrame, found: _Found, out: str) -> DataFrame:
    """What ``found`` makes of each batch of faces and each block of the gallery: (faces, their units, clusters, exemplars, their units).

    A cluster's exemplars are in one block, in order of cluster and exemplar. A gallery of up to ``BLOCK`` is broadcast; the blocks of a larger one, of some ``PART`` rows, lie in the shared folder and are read one at
    a time. Faces are scanned once and never shuffled, and results stream.
    """
    n, gallery, faces = gallery.count(), gallery.select("cluster_id", "exemplar", "unit"), faces.select("face_id", "unit")

    if n <= BLOCK:
        shared = faces.sparkSession.sparkContext.broadcast(_parts(gallery.toArrow()))
        galleries = lambda: iter([shared.value])
    else:
        cut = written(gallery.withColumn("_j", F.pmod(F.xxhash64("cluster_id"), F.lit(-(-n // min(BLOCK, PART)))).cast("int")), "gallery")
        there, read = [r._j for r in cut.select("_j").distinct().collect()], in_blocks(cut, ["_j"])
        galleries = lambda: (_parts(read(j)) for j in there)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, x = np.asarray(b.column(0)), _matrix(b.column(1))
                for g in galleries():
                    yield from found(own, x, *g)

    return faces.mapInArrow(scan, out)


def matches(faces: DataFrame, gallery: DataFrame, min_sim: float) -> DataFrame:
    """(face_id, cluster_id, exemplar, sim): exemplars (cluster_id, exemplar, unit) of at least ``min_sim`` for each face (face_id, unit)."""

    def found(own: np.ndarray, x: np.ndarray, clusters: np.ndarray, ids: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j, sim in _hits(own, x, clusters, ids, g, min_sim):
            yield from _batches(["face_id", "cluster_id", "exemplar", "sim"], own[i], clusters[j], ids[j], sim)

    return _scanned(faces, gallery, found, "face_id long, cluster_id long, exemplar long, sim double")


def retrieved(faces: DataFrame, gallery: DataFrame, min_sim: float, excluded: DataFrame | None = None, top: int = 5, best: int | None = None, refused: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, least: float | None = None) -> DataFrame:
    """(face_id, cluster_id, score, best, n): per cluster the mean of a face's ``top`` best similarities, the best exemplar, the number of matches.

    A cluster's gallery is in one block, so a task finishes its scores and single matches are never shuffled. With ``best``, only scores that may be among so many best of a face are
    needed, and a task leaves out the others; ``refused`` (faces, clusters) tells pairs that don't count; scores under ``least`` aren't returned.
    """

    def found(own: np.ndarray, x: np.ndarray, clusters: np.ndarray, ids: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j, sim in _hits(own, x, clusters, ids, g, min_sim):
            c = clusters[j]
            start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (c[1:] != c[:-1]))) if len(i) else np.zeros(0, np.int64)
            if not len(start):
                continue
            n = np.diff(np.append(start, len(i)))
            run = np.repeat(np.arange(len(start)), n)
            o = np.argsort((run << 22) - np.rint(sim * 1e6).astype(np.int64), kind="stable")  # similarities have 6 decimals; exemplars come in order
            ranked, first = sim[o], ids[j[o[start]]]
            ranked[np.arange(len(i)) - start[run] >= top] = 0
            score = np.round(np.add.reduceat(ranked, start) / np.minimum(n, top) + 1e-9, 6)
            f, c = i[start], c[start]
            keep = np.ones(len(f), bool) if refused is None else ~refused(own[f], c)
            if least is not None:
                keep &= score >= least
            f, c, score, first, n = (v[keep] for v in (f, c, score, first, n))
            if best is not None:
                o = np.lexsort((c, -score, f))
                f, c, score, first, n = (v[o] for v in (f, c, score, first, n))
                keep = np.arange(len(f)) - np.searchsorted(f, f) < best
                f, c, score, first, n = (v[keep] for v in (f, c, score, first, n))
            yield from _batches(["face_id", "cluster_id", "score", "best", "n"], own[f], c, score, first, n.astype(np.int64))

    r = _scanned(faces, gallery, found, "face_id long, cluster_id long, score double, best long, n long")
    return r if excluded is None else r.join(excluded.select("face_id", "cluster_id"), ["face_id", "cluster_id"], "left_anti")


def banded(scores: DataFrame) -> DataFrame:
    """(face_id, cluster_id, score, band): the best cluster of each face; 'assign' if high, or over low by a margin to the second, 'ambiguous' if over low, else 'none'."""
    t = top_per_group(scores, ["face_id"], [col("score").desc(), col("cluster_id")], 2)
    g = t.groupBy("face_id").agg(F.min_by("cluster_id", "rn").alias("cluster_id"), F.max("score").alias("score"), F.max(F.when(col("rn") == 2, col("score"))).alias("second"))
    band = F.when(col("score") < LOW, "none").when((col("score") >= HIGH) & (col("score") - F.coalesce("second", F.lit(0.0)) >= GAP), "assign").otherwise("ambiguous")
    return g.select("face_id", "cluster_id", "score", band.alias("band"))


def complete_link(dist: np.ndarray, photos: np.ndarray, limit: float) -> np.ndarray:
    """Labels of agglomeration by the largest distance up to ``limit``; never two faces of one photo together; -1 alone."""
    n = len(dist)
    d = dist.copy()
    d[photos[:, None] == photos[None]] = np.inf
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    while n > 1:
        k = int(d.argmin())
        i, j = min(k // n, k % n), max(k // n, k % n)
        if not d[i, j] <= limit:
            break
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        label[label == j] = i
        alive[j] = False
    count = np.bincount(label, minlength=n)
    return np.where(count[label] > 1, label, -1)


def _nearest(own: np.ndarray, x: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, other, sim): the ``k`` nearest of each face (own, x) in the blocks (ids, units) of at least ``least``, ties to the smaller id."""
    others, sims, floor = np.zeros((len(own), k), np.int64), np.full((len(own), k), -np.inf), np.full(len(own), least)
    for ids, g in blocks:
        for i, j, v in _hits(own, x, ids, ids, g, floor):
            lo, hi = i[0], i[-1] + 1
            f, c = np.nonzero(sims[lo:hi] > -np.inf)
            i, o, v = np.concatenate([i, f + lo]), np.concatenate([ids[j], others[lo:hi][f, c]]), np.concatenate([v, sims[lo:hi][f, c]])
            order = np.lexsort((o, -v, i))
            i, o, v = i[order], o[order], v[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, o, v, rank = (z[rank < k] for z in (i, o, v, rank))
            others[i, rank], sims[i, rank] = o, v
            floor[lo:hi] = np.maximum(least, sims[lo:hi, k - 1])  # only what is among the best so far has a say
    f, c = np.nonzero(sims > -np.inf)
    return own[f], others[f, c], sims[f, c]


def nearest_within(faces: DataFrame, least: float, k: int = 15, block: int = 32_768) -> DataFrame:
    """(a, b, score): faces (cluster_id, face_id, unit) and their ``k`` nearest of the same cluster of at least ``least``, ties to the smaller face, each pair once.

    A cluster of one block is one task. The blocks of a larger one lie once in the shared folder; a task takes some of its faces, reads block after block and keeps ``k`` neighbours of each, so
    no face is copied for the blocks it meets and nothing that is shuffled or held grows with the square of a cluster.
    """
    names = ["face_id", "other", "sim"]
    n = faces.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    n = written(n.select("cluster_id", F.ceil(col("_n") / block).cast("int").alias("_cuts")), "cuts")
    units = lambda t: (np.asarray(t.column("face_id")), _matrix(t.column("unit").combine_chunks()))

    def whole(t: pa.Table) -> pa.Table:
        own = units(t)
        return pa.table([pa.array(c) for c in _nearest(*own, iter([own]), least, k)], names=names)

    near = faces.join(n.where("_cuts = 1"), "cluster_id", "left_semi").select("cluster_id", "face_id", "unit").groupBy("cluster_id").applyInArrow(whole, "face_id long, other long, sim double")
    many = n.where("_cuts > 1")
    if not many.isEmpty():
        cut = faces.join(F.broadcast(many), "cluster_id").select("cluster_id", F.pmod(F.xxhash64("face_id"), col("_cuts")).cast("int").alias("_own"), "face_id", "unit")
        read, there, tasks = in_blocks(cut, ["cluster_id", "_own"]), {}, []
        for r in cut.groupBy("cluster_id", "_own").agg(F.count("*").alias("_n")).orderBy("cluster_id", "_own").collect():
            there.setdefault(r.cluster_id, []).append(r._own)
            parts = -(-r._n // QUERIES)
            tasks += [(r.cluster_id, r._own, part, parts) for part in range(parts)]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for task in b.column(0).to_pylist():
                    cluster, block_, part, parts = tasks[task]
                    own, x = units(read(cluster, block_))
                    mine = own % parts == part
                    yield from _batches(names, *_nearest(own[mine], x[mine], (units(read(cluster, j)) for j in there[cluster]), least, k))

        near = near.unionByName(faces.sparkSession.range(0, len(tasks), 1, min(len(tasks), 20_000)).mapInArrow(scan, "face_id long, other long, sim double"))
    return near.select(F.least("face_id", "other").alias("a"), F.greatest("face_id", "other").alias("b"), col("sim").alias("score")).distinct()


def split_clusters(faces: DataFrame, limit: float = 0.30, most: int = 256) -> DataFrame:
    """(cluster_id, face_id, part): parts of each cluster; part is the smallest face of it, -1 alone. Clusters of up to ``most`` are split by complete link, larger ones by uniting nearest
    neighbours, best first, never two faces of one photo; their comparisons are spread over tasks, and only what is connected is united in one."""
    faces = faces.select("cluster_id", "face_id", "photo_id", "unit")
    n = faces.groupBy("cluster_id").agg(F.count("*").alias("_n"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("face_id")
        x, ids = _matrix(t.column("unit").combine_chunks()), np.asarray(t.column("face_id"))
        lab = complete_link(1 - np.round(x @ x.T, 6), np.asarray(t.column("photo_id")), limit)
        return pa.table([t.column("cluster_id"), t.column("face_id"), pa.array(np.where(lab >= 0, ids[lab], -1))], names=["cluster_id", "face_id", "part"])

    small = faces.join(n.where((col("_n") >= 2) & (col("_n") <= most)), "cluster_id", "left_semi").groupBy("cluster_id").applyInArrow(run, "cluster_id long, face_id long, part long")
    if n.where(col("_n") > most).isEmpty():
        return small
    large = faces.join(n.where(col("_n") > most), "cluster_id", "left_semi")
    roots = united(nearest_within(large, 1 - limit), large.select(col("face_id").alias("cluster_id"), "photo_id"))
    size = roots.groupBy("survivor").agg(F.count("*").alias("_k")).where("_k > 1").select("survivor")
    parts = roots.join(size, "survivor").select(col("cluster_id").alias("face_id"), "survivor")
    return small.unionByName(large.join(parts, "face_id", "left").select("cluster_id", "face_id", F.coalesce("survivor", F.lit(-1).cast("long")).alias("part")))


def ordered_union(edges: pd.DataFrame, barred: set[tuple[int, int]], photos: dict[int, set[int]]) -> dict[int, int]:
    """Root of each node after uniting edges (a, b, score), the best first, unless the two are barred or their members share a photo; the smaller id survives."""
    up: dict[int, int] = {}
    own = {k: set(v) for k, v in photos.items()}
    bars: dict[int, set[int]] = {}
    for a, b in barred:
        bars.setdefault(a, set()).add(b)
        bars.setdefault(b, set()).add(a)
    members: dict[int, set[int]] = {}
    none: set[int] = set()

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(sets: dict[int, set[int]], keep: int, gone: int) -> None:
        small, large = sorted((sets.pop(keep, none), sets.pop(gone, none)), key=len)
        if large:
            large |= small
            sets[keep] = large

    for a, b, _ in edges.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
        ra, rb = root(int(a)), root(int(b))
        if ra == rb:
            continue
        members.setdefault(ra, {ra})
        members.setdefault(rb, {rb})
        if not bars.get(ra, none).isdisjoint(members[rb]) or not own.get(ra, none).isdisjoint(own.get(rb, none)):
            continue
        keep, gone = min(ra, rb), max(ra, rb)
        up[gone] = keep
        for sets in (members, own, bars):
            join(sets, keep, gone)
    return {x: root(x) for x in up}


def united(edges: DataFrame, node_photos: DataFrame, barred: DataFrame | None = None) -> DataFrame:
    """(cluster_id, survivor) after uniting all edges (a, b, score), best first, never two that share a photo or are barred (a, b); ``node_photos``: (cluster_id, photo_id).

    No edge reaches over two connected components, so each is united by itself, on the executors, with the result of one list over all; small components share tasks.
    """
    edges = written(edges.select("a", "b", "score"), "edges")
    labels = components(edges)
    tasks = F.lit(max(1, edges.count() // TASK_EDGES))
    if barred is not None:  # a bar is an edge without a score; only one within a component has a say
        ends = labels.select(col("node").alias("a"), col("label").alias("_l")), labels.select(col("node").alias("b"), col("label").alias("_r"))
        bars = barred.select("a", "b").join(ends[0], "a").join(ends[1], "b").where("_l = _r").select("a", "b", F.lit(None).cast("double").alias("score"))
        edges = edges.unionByName(bars)

    def run(e: pa.Table, p: pa.Table) -> pa.Table:
        photos: dict[int, set[int]] = {}
        for node, photo in zip(p.column("cluster_id").to_pylist(), p.column("photo_id").to_pylist()):
            if photo is not None:
                photos.setdefault(node, set()).add(photo)
        e = e.select(["a", "b", "score"]).to_pandas()
        bar = e.score.isna()
        roots = ordered_union(e[~bar], set(zip(e.a[bar], e.b[bar])), photos)
        return pa.table([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["cluster_id", "survivor"])

    labels = labels.select("node", F.pmod(F.xxhash64("label"), tasks).alias("task"))
    e = edges.join(labels.withColumnRenamed("node", "a"), "a")
    p = node_photos.join(labels.withColumnRenamed("node", "cluster_id"), "cluster_id").select(col("task").alias("of"), "cluster_id", "photo_id")
    return e.groupBy("task").cogroup(p.groupBy("of")).applyInArrow(run, "cluster_id long, survivor long")


def cluster_scores(gallery: DataFrame, min_sim: float = 0.4, top: int = 3, least: float | None = None) -> DataFrame:
    """(a, b, score): for pairs of clusters the mean of the ``top`` best similarities between their exemplars; scores under ``least`` aren't returned.

    Clusters lie whole in blocks in the shared folder; each pair of blocks is one task, which finishes the scores of its clusters, so no single match is shuffled and no exemplar copied.
    """
    gallery = gallery.select("cluster_id", "exemplar", "unit")
    gallery = written(gallery.withColumn("_j", F.pmod(F.xxhash64("cluster_id"), F.lit(max(1, -(-gallery.count() // BLOCK)))).cast("int")), "gallery")
    there, read = sorted(r._j for r in gallery.select("_j").distinct().collect()), in_blocks(gallery, ["_j"])
    pairs = [(p, q) for k, p in enumerate(there) for q in there[k:]]
    parts = max(1, min(16, 64 // max(1, len(pairs))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                (p, q), part = pairs[task // parts], task % parts
                (ca, ia, x), (cb, ib, g) = _parts(read(p)), _parts(read(q))
                mine = ca % parts == part
                ca, ia, x = ca[mine], ia[mine], x[mine]
                for start, end in _runs(ca, FACES):  # whole clusters meet whole clusters
                    for i, j, sim in _hits(ia[start:end], x[start:end], cb, ib, g, min_sim, end - start):
                        u, v = ca[start:end][i], cb[j]
                        keep = u < v if p == q else u != v
                        u, v, sim = np.minimum(u, v)[keep], np.maximum(u, v)[keep], sim[keep]
                        o = np.lexsort((-sim, v, u))
                        u, v, sim = u[o], v[o], sim[o]
                        first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, np.int64)
                        if not len(first):
                            continue
                        n = np.diff(np.append(first, len(u)))
                        sim[np.arange(len(u)) - np.repeat(first, n) >= top] = 0
                        score = np.round(np.add.reduceat(sim, first) / np.minimum(n, top) + 1e-9, 6)
                        ok = np.flatnonzero(score >= (-1.0 if least is None else least))
                        yield from _batches(["a", "b", "score"], u[first][ok], v[first][ok], score[ok])

    return gallery.sparkSession.range(0, len(pairs) * parts, 1, max(1, min(len(pairs) * parts, 20_000))).mapInArrow(scan, "a long, b long, score double")


def unified(scores: DataFrame, cluster_photos: DataFrame, barred: DataFrame | None = None, least: float = ALIKE) -> DataFrame:
    """(cluster_id, survivor) after uniting pairs of clusters (a, b, score) of at least ``least``, best first, but for those barred (a, b) and those that share a photo."""
    return united(scores.where(col("score") >= least), cluster_photos.select("cluster_id", "photo_id").distinct(), barred)


def linked(faces: DataFrame, least: float = 0.7, k: int = 15) -> DataFrame:
    """(cluster_id, survivor): faces united along their ``k`` nearest neighbours of at least ``least``, best first, never two of one photo."""
    e = nearest_within(faces.select(F.lit(0).cast("long").alias("cluster_id"), "face_id", "unit"), least, k)
    return united(e, faces.select(col("face_id").alias("cluster_id"), "photo_id"))


def exemplars(faces: DataFrame, n: int = 30) -> DataFrame:
    """(cluster_id, exemplar, unit): the ``n`` best faces of each cluster by confidence, confirmed ones first."""
    t = top_per_group(faces.where("cluster_id is not null and user_confirmed >= 0"), ["cluster_id"], [col("user_confirmed").desc(), col("confidence").desc(), col("face_id")], n)
    return t.select("cluster_id", col("face_id").alias("exemplar"), "unit")


def diverse(faces: DataFrame, most: int = 30, alike: float = 0.70) -> DataFrame:
    """(cluster_id, exemplar) of a gallery kept diverse: when it is full, a face whose least similarity to it is under ``alike`` replaces the unconfirmed member most similar to the rest.

    Faces come in order of confidence, confirmed ones first. They are sorted by the shuffle, which spills, and stream through a task that holds one gallery only, however large a
    cluster is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sure, g = None, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, DIMS))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now] * len(ids), pa.int64()), pa.array(ids)], names=["cluster_id", "exemplar"])

        for b in batches:
            x = _matrix(b.column("unit"))
            for c, i, u, v in zip(b.column("cluster_id").to_pylist(), b.column("face_id").to_pylist(), b.column("user_confirmed").to_pylist(), x):
                if c != now:
                    if now is not None:
                        yield done()
                    now, ids, sure, g = c, ids[:0], sure[:0], g[:0]
                if len(ids) < most:
                    ids, sure, g = np.append(ids, i), np.append(sure, u > 0), np.vstack([g, v])
                elif (g @ v).min() < alike and not sure.all():
                    mean = (g @ g.T).sum(1)
                    k = max(np.flatnonzero(~sure), key=lambda k: (mean[k], ids[k]))
                    ids[k], sure[k], g[k] = i, u > 0, v
        if now is not None:
            yield done()

    f = faces.where("cluster_id is not null").select("cluster_id", "face_id", "user_confirmed", "confidence", "unit")
    f = f.repartition("cluster_id").sortWithinPartitions("cluster_id", col("user_confirmed").desc(), col("confidence").desc(), "face_id")
    return f.mapInArrow(run, "cluster_id long, exemplar long")


def centroid(faces: DataFrame, cluster: int) -> DataFrame:
    """(unit,): the mean direction of a cluster's confirmed faces, or of all its faces if none is confirmed; one row."""
    f = faces.where(col("cluster_id") == cluster)
    sums = lambda d: d.select(F.posexplode("unit")).groupBy("pos").agg(F.avg("col").alias("m"))
    best = f.agg(F.max("user_confirmed").alias("_c"))
    f = f.crossJoin(F.broadcast(best)).where((col("_c") < 1) | (col("user_confirmed") == 1))
    return sums(f).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("unit"))


def similar_to(faces: DataFrame, cluster: int, k: int) -> DataFrame:
    """(face_id, score): the ``k`` faces most like a cluster that are unassigned or unconfirmed, not of it and not refused by the user."""
    c = centroid(faces, cluster).select(col("unit").alias("_c"))
    f = faces.where((col("cluster_id").isNull() | (col("user_confirmed") == 0)) & (F.coalesce("cluster_id", F.lit(-1)) != cluster) & (col("user_confirmed") >= 0)).crossJoin(F.broadcast(c))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return f.select("face_id", F.round(dot("unit", "_c") / F.sqrt(dot("_c", "_c")), 6).alias("score")).orderBy(col("score").desc(), "face_id").limit(k)


def cooccurrence_bonus(n: str) -> Column:
    """0.30 at most, growing with the number of photos that two people share."""
    return F.lit(0.30) * F.least(F.log(F.coalesce(n, F.lit(0)) + 1.0) / 5, F.lit(1.0))


def reranked(scores: DataFrame, together: DataFrame, near: DataFrame) -> DataFrame:
    """(face_id, cluster_id, score): scores plus the bonus of people already on the photo and 0.05 for the same person nearby in time.

    ``together``: (face_id, cluster_id, n); ``near``: (face_id, cluster_id).
    """
    s = scores.join(together, ["face_id", "cluster_id"], "left").join(near.select("face_id", "cluster_id", F.lit(1).alias("_t")).distinct(), ["face_id", "cluster_id"], "left")
    return s.select("face_id", "cluster_id", F.round(col("score") + cooccurrence_bonus("n") + F.when(col("_t") == 1, 0.05).otherwise(0.0), 6).alias("score"))


def seen_nearby(hits: DataFrame, held: DataFrame, times: DataFrame, width: int = 60) -> DataFrame:
    """(face_id, cluster_id) of the hits (face_id, cluster_id, photo_id) whose cluster is held (photo_id, cluster_id) by another photo at most ``width`` seconds away; ``times``: photo_id, t.

    Each side is joined by cluster and bucket of time, so only moments of the same person meet.
    """
    h = hits.join(times, "photo_id").withColumn("_k", F.floor(col("t") / width))
    o = held.join(times, "photo_id").select("cluster_id", col("photo_id").alias("_p"), col("t").alias("_t"), F.explode(F.array(*[F.floor(col("t") / width) + k for k in (-1, 0, 1)])).alias("_k"))
    return h.join(o, ["cluster_id", "_k"]).where((col("photo_id") != col("_p")) & (F.abs(col("t") - col("_t")) <= width)).select("face_id", "cluster_id").distinct()


def inferred_identities(photos: DataFrame, faces: DataFrame, width: int = 60) -> DataFrame:
    """(photo_id, cluster_id, score): people likely on a photo without faces, from photos of its folder at most ``width`` seconds away; the best per person, at least 0.5.

    ``photos``: photo_id, folder, t, brightness. Score: 0.5 + 0.4 for closeness in time + 0.1 for closeness in brightness.
    """
    with_face = photos.join(faces.where("cluster_id is not null").select("photo_id", "cluster_id").distinct(), "photo_id")
    bare = photos.join(faces.select("photo_id"), "photo_id", "left_anti")
    b = with_face.select("folder", "cluster_id", col("t").alias("_t"), col("brightness").alias("_b"), F.explode(F.array(*[F.floor(col("t") / width) + k for k in (-1, 0, 1)])).alias("_k"))
    j = bare.withColumn("_k", F.floor(col("t") / width)).join(b, ["folder", "_k"])
    d, light = F.abs(col("t") - col("_t")), F.abs(col("brightness") - col("_b"))
    score = F.lit(0.5) + F.lit(0.4) * (1 - d.cast("double") / width) + F.lit(0.1) * (1 - F.least(light / 0.3, F.lit(1.0)))
    return j.where(d <= width).groupBy("photo_id", "cluster_id").agg(F.round(F.max(score), 6).alias("score")).where("score >= 0.5")


def iou(a: list[str], b: list[str]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (col(x[2]) - col(x[0])) * (col(x[3]) - col(x[1]))
    return F.when(area(a) + area(b) - w * h > 0, w * h / (area(a) + area(b) - w * h)).otherwise(0.0)


def yaw(left: Column, right: Column, nose: Column) -> Column:
    """Degrees by which a face is turned, from its eyes and nose (x, y): how far the nose lies beside the eyes' middle, in distances of the eyes; 0 for eyes less than a pixel apart."""
    apart = F.sqrt(F.pow(right["x"] - left["x"], 2) + F.pow(right["y"] - left["y"], 2))
    return F.when(apart < 1, 0.0).otherwise(F.abs(F.degrees(F.atan((nose["x"] - (left["x"] + right["x"]) / 2) / apart))))


def suppressed(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Boxes (photo_id, box_id, x1, y1, x2, y2, score) left after non-maximum suppression within each photo: greedy by score, ties to the smaller id."""

    def run(t: pa.Table) -> pa.Table:
        d = t.to_pandas().sort_values(["score", "box_id"], ascending=[False, True])
        kept: list[int] = []
        v = d[["x1", "y1", "x2", "y2"]].to_numpy()
        for i in range(len(d)):
            ok = True
            for k in kept:
                w, h = min(v[i, 2], v[k, 2]) - max(v[i, 0], v[k, 0]), min(v[i, 3], v[k, 3]) - max(v[i, 1], v[k, 1])
                inter = max(w, 0.0) * max(h, 0.0)
                union = (v[i, 2] - v[i, 0]) * (v[i, 3] - v[i, 1]) + (v[k, 2] - v[k, 0]) * (v[k, 3] - v[k, 1]) - inter
                ok = ok and not (union > 0 and inter / union > threshold)
            if ok:
                kept.append(i)
        return pa.Table.from_pandas(d.iloc[kept], schema=t.schema, preserve_index=False)

    return boxes.groupBy("photo_id").applyInArrow(run, boxes.schema)


def recount(faces: DataFrame) -> DataFrame:
    """(cluster_id, faces, photos) after a change of faces."""
    return faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("faces"), F.countDistinct("photo_id").alias("photos"))


def confirmed(faces: DataFrame, ids: list[int]) -> DataFrame:
    return faces.withColumn("user_confirmed", F.when(col("face_id").isin(ids), 1).otherwise(col("user_confirmed")))


def rejected(faces: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(faces, negatives): the faces leave their cluster, and the pair is remembered so that it isn't proposed again."""
    gone = col("face_id").isin(ids) & col("cluster_id").isNotNull()
    out = faces.withColumn("user_confirmed", F.when(gone, -1).otherwise(col("user_confirmed"))).withColumn("cluster_id", F.when(~gone | col("cluster_id").isNull(), col("cluster_id")))
    return out, faces.where(gone).select("face_id", "cluster_id")


def reassigned(faces: DataFrame, ids: list[int], cluster: int) -> DataFrame:
    mine = col("face_id").isin(ids)
    return faces.withColumn("cluster_id", F.when(mine, F.lit(cluster).cast("long")).otherwise(col("cluster_id"))).withColumn("user_confirmed", F.when(mine, 1).otherwise(col("user_confirmed")))


def merged(faces: DataFrame, into: int, others: list[int]) -> DataFrame:
    return faces.withColumn("cluster_id", F.when(col("cluster_id").isin(others), F.lit(into).cast("long")).otherwise(col("cluster_id")))


def dissolved(faces: DataFrame, cluster: int) -> DataFrame:
    mine = col("cluster_id") == cluster
    return faces.withColumn("user_confirmed", F.when(mine, 0).otherwise(col("user_confirmed"))).withColumn("cluster_id", F.when(~mine, col("cluster_id")))


def with_singletons(faces: DataFrame) -> DataFrame:
    """Faces that no cluster holds become clusters of their own, numbered by their negative id, unless the user hid them."""
    alone = col("cluster_id").isNull() & (col("user_confirmed") >= 0)
    return faces.withColumn("cluster_id", F.when(alone, -col("face_id")).otherwise(col("cluster_id")))


def assigned(faces: DataFrame, gallery: DataFrame, min_sim: float) -> DataFrame:
    """Faces with the cluster that retrieval assigns to those without one."""
    open_ = faces.where("cluster_id is null and user_confirmed >= 0")
    b = banded(retrieved(open_, gallery, min_sim)).where("band = 'assign'").select("face_id", col("cluster_id").alias("_c"))
    return faces.join(b, "face_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_c")).drop("_c")




def assigned_apart(faces: DataFrame, gallery: DataFrame, min_sim: float, high: float = HIGH, gap: float = GAP, barred: DataFrame | None = None, context: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Faces with the cluster that retrieval assigns to those without one, never one that their photo already holds or that is barred (a, b) from one it holds.

    The faces of a photo come in order of their id, and each bars its cluster to the next ones. ``context`` turns scores (face_id, cluster_id, score) into those that bands are taken of; it sees the
    faces as they were before.
    """
    open_ = faces.where("cluster_id is null and user_confirmed >= 0")
    held = faces.where("cluster_id is not null").select("photo_id", "cluster_id").distinct()
    not_these = open_.select("face_id", "photo_id").join(held, "photo_id").select("face_id", "cluster_id")
    if barred is not None:
        bars = barred.select(F.inline(F.array(F.struct(col("a").alias("cluster_id"), col("b").alias("other")), F.struct(col("b").alias("cluster_id"), col("a").alias("other")))))
        not_these = not_these.unionByName(not_these.join(bars, "cluster_id").select("face_id", col("other").alias("cluster_id"))).distinct()
    # Only scores that can be the best or too near to it have a say.
    r = retrieved(open_, gallery, min_sim, not_these, least=high - gap - 1e-6 if context is None else None)
    r = r if context is None else context(r.drop("n"))
    r = r.join(open_.select("face_id", "photo_id"), "face_id").select("photo_id", "face_id", "cluster_id", "score")

    def run(t: pa.Table) -> pa.Table:
        hits: dict[int, list[tuple[float, int]]] = {}
        for f, c, v in zip(*(t.column(n).to_pylist() for n in ("face_id", "cluster_id", "score"))):
            hits.setdefault(f, []).append((-v, c))
        apart = t.column("photo_id")[0].as_py() is not None
        taken: set[int] = set()
        out: list[tuple[int, int]] = []
        for f in sorted(hits):
            h = sorted(x for x in hits[f] if x[1] not in taken)
            if h and -h[0][0] >= high and (len(h) == 1 or h[1][0] - h[0][0] >= gap):
                out.append((f, h[0][1]))
                if apart:
                    taken.add(h[0][1])
        return pa.table([pa.array([f for f, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], names=["face_id", "_c"])

    b = r.groupBy("photo_id").applyInArrow(run, "face_id long, _c long")
    return faces.join(b, "face_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_c")).drop("_c")


def rescued(faces: DataFrame, gallery: DataFrame, barred: DataFrame | None = None) -> DataFrame:
    """Faces that still have no cluster are given to one by laxer bands, and those left are clusters of their own."""
    return with_singletons(assigned_apart(faces, gallery, 0.45, 0.60, 0.08, barred))


def pipeline(faces: DataFrame, limit: float = 0.30, most: int = 256, barred: DataFrame | None = None, context: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Faces after assign (with ``context``), cluster, refresh, unify, rescue and singletons; clusters barred (a, b) from each other never meet on a photo nor unite. New clusters are numbered after the present ones, by their smallest face."""
    unit = faces.select("face_id", "unit")
    first = faces = written(assigned_apart(faces, exemplars(faces), 1 - limit, barred=barred, context=context), "assigned")
    rest = faces.where("cluster_id is null and user_confirmed >= 0")
    if rest.count() <= most:
        parts = split_clusters(rest.withColumn("cluster_id", F.lit(0).cast("long")), limit, most).where("part >= 0").select("face_id", "part")
    else:
        parts = linked(rest, 1 - limit)
        parts = parts.join(parts.groupBy("survivor").agg(F.count("*").alias("n")).where("n > 1"), "survivor").select(col("cluster_id").alias("face_id"), col("survivor").alias("part"))
    last = max(0, faces.agg(F.max("cluster_id")).first()[0] or 0)
    faces = faces.join(parts, "face_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(last) + col("part"))).drop("part")
    second = faces = written(faces, "clustered")
    discard(first)

    def gallery(f: DataFrame) -> DataFrame:
        g = diverse(f.where("user_confirmed >= 0"))
        return written(g.join(unit.withColumnRenamed("face_id", "exemplar"), "exemplar").select("cluster_id", "exemplar", "unit"), "gallery")

    held = faces.where("cluster_id is not null").select("cluster_id", "photo_id")
    now = gallery(faces)
    roots = unified(cluster_scores(now, least=ALIKE), held, barred)
    faces = written(faces.join(roots, "cluster_id", "left").withColumn("cluster_id", F.coalesce("survivor", "cluster_id")).drop("survivor"), "unified")
    discard(second)
    discard(now)
    return rescued(faces, gallery(faces), barred)

"""Groups of linked vectors: cells from cluster features, links within cells, and links between the groups of cells.

1. Each partition builds a cluster-feature tree; the trees' leaves are merged in a tree of tasks, and Ward's agglomeration of the last leaves gives
   centroids, of a number that grows with the data up to a bound. 2. One assignment pass sends each vector to its nearest centroid's cell, where exact links make
   leaves: sets of linked vectors with a leader and a radius. A leaf is core if all its members lie within ``CORE`` of the centroid, else stray.
3. By the triangle inequality a core leaf can only be linked with leaves whose leader lies within the link's angle, CORE and their radius of its centroid, so exactly
   these visit its cell, and all stray leaves meet each other in blocks: no link is lost, whatever the data. Where leaves meet, leaders that
   are linked join, and leaves too close to exclude a link between members are checked member by member. Meetings are split into pairs of
   blocks of bounded size, so no task gets a whole cell. 4. Components of leaves are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.features import FeatureTree, ward
from shutterlake.operators.graph import components
from shutterlake.session import in_blocks, written

DIMS = 64
FAN = 16
#: Cells at least and at most, and vectors per cell between.
CELLS, MOST_CELLS, PER_CELL = 1024, 8192, 2000
#: Rows of a cell compared at once, and rows of a cell that one task gets.
CHUNK, TASK_ROWS = 4096, 400_000
#: Leaves that a chunk is compared with at once; they are of like radius.
TILE = 1024
MIN_SIM = 0.9
THETA = float(np.arccos(MIN_SIM)) + 1e-6
SALTS = 1 << 20
#: Cosine within which a vector is at the core of its cell.
CORE = 0.9
#: Leaves of a block, and blocks of one meeting up to which that holds; beyond, blocks grow to LARGE leaves, so that none is sent to too many tasks.
BLOCK, MOST_BLOCKS, LARGE = 8192, 64, 262_144


def unpack(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary float32 vectors as a matrix of unit vectors in double precision."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    buf = b"".join(x.as_buffer() for x in col) if col.offset or len(col) == 0 else col.buffers()[2]
    x = np.frombuffer(buf, np.float32)[: len(col) * DIMS].reshape(-1, DIMS).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vec): rows with a key and an embedding of DIMS finite numbers, not all 0, as packed float32."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, e = b.column(0), b.column(1)
            e = e.cast(pa.list_(pa.float32()))
            n, off = np.asarray(e.value_lengths().fill_null(0)), np.asarray(e.offsets)[:-1]
            good = np.flatnonzero((n == DIMS) & np.asarray(ids.is_valid()))
            flat = np.asarray(e.values.fill_null(np.nan), dtype=np.float32)
            x = flat[off[good][:, None] + np.arange(DIMS)]
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            x = np.ascontiguousarray(x[fine])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good[fine])), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "vec"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>")).mapInArrow(pick, "id long, vec binary")


def _leaf_batch(t: FeatureTree, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(t.n), pa.int64()), pa.array(t.n), pa.array([s.tobytes() for s in t.sums], pa.binary()), pa.array([t.radius] * len(t.n))], names=["part", "n", "sums", "radius"])


_LEAF = "part long, n double, sums binary, radius double"


def centroids(vectors: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(at most ``cells`` unit centroids, about how many vectors each has): feature trees per partition, merged FAN by FAN, agglomerated by Ward."""
    most = 2 * cells

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = FeatureTree(DIMS, most)
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(0))
                t.add(np.ones(len(x)), x)
        yield _leaf_batch(t, TaskContext.get().partitionId())

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = FeatureTree(DIMS, most)
        for b in batches:
            if b.num_rows:
                t.radius = max(t.radius, max(b.column("radius").to_pylist()) if not len(t.n) else t.radius)
                t.add(np.asarray(b.column("n")), np.array([np.frombuffer(s.as_buffer(), np.float64) for s in b.column("sums")]))
        yield _leaf_batch(t, key[0].as_py())

    parts = max(1, vectors.rdd.getNumPartitions())
    leaves = vectors.select("vec").mapInArrow(build, _LEAF)
    while parts > 1:
        parts = -(-parts // FAN)
        leaves = leaves.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(merge, _LEAF)
    rows = leaves.select("n", "sums").collect()  # at most 2 * cells rows
    if not rows:
        return np.zeros((1, DIMS)), np.zeros(1)
    n, sums = np.array([r.n for r in rows]), np.array([np.frombuffer(bytes(r.sums), np.float64) for r in rows])
    group = ward(n, sums, cells)
    c = np.zeros((group.max() + 1, DIMS))
    np.add.at(c, group, sums)
    length = np.linalg.norm(c, axis=1)
    return c / np.where(length > 0, length, 1)[:, None], np.bincount(group, n)


def linked(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Whether each pair's similarity in double precision, rounded to 6 decimals, reaches MIN_SIM."""
    y = x if y is None else y
    s = x.astype(np.float32) @ y.astype(np.float32).T
    out = s >= MIN_SIM
    i, j = np.nonzero(np.abs(s - MIN_SIM) < 5e-5)  # single precision can't decide these
    out[i, j] = np.round((x[i] * y[j]).sum(1), 6) >= MIN_SIM
    return out


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its component, given edges (i, j)."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


_PART = "kind int, leaf long, id long, n long, radius double, vec binary, core int"


def _leaves_of(ids: np.ndarray, vec: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, float, int, list[int]]]]:
    """(leaf of each vector, [(leaf, n, radius, row of its leader, its rows)]) of a chunk with distinct ids."""
    x = unpack(vec)
    i, j = np.nonzero(linked(x))
    part = labels_of(len(x), i[i < j], j[i < j])
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.diff(part[order], append=-1))
    leaf, heads, start = np.empty(len(ids), np.int64), [], 0
    for e in ends + 1:
        rows = order[start:e]
        start = e
        name = int(ids[rows].min())
        leaf[rows] = name
        if len(rows) == 1:
            heads.append((name, 1, 0.0, int(rows[0]), rows))
            continue
        own = x[rows]
        to_mean = own @ own.mean(0)
        k = int(to_mean.argmax())
        heads.append((name, len(rows), float(np.arccos(np.clip((own @ own[k]).min(), -1, 1))) + 1e-7, int(rows[k]), rows))
    return leaf, heads


def _in_cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of a cell, in chunks; rows of kind 0 are members, of kind 1 leaves with their leader's vector. core is the cell of a core leaf, else -1."""
    cell = key[0].as_py() // SALTS

    def done(t: pa.Table) -> pa.RecordBatch:
        ids = np.asarray(t.column("id"))
        first = np.unique(ids, return_index=True)[1]
        t = t.take(pa.array(np.sort(first)))
        ids, vec, inner = np.asarray(t.column("id")), t.column("vec").combine_chunks(), np.asarray(t.column("inner"))
        leaf, heads = _leaves_of(ids, vec)
        k = len(heads)
        none = np.zeros(len(ids))
        at = [h[3] for h in heads]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([0, 1], [len(ids), k]), pa.int32()),
                pa.array(np.concatenate([leaf, [h[0] for h in heads]]).astype(np.int64)),
                pa.array(np.concatenate([ids, ids[at]]).astype(np.int64)),
                pa.array(np.concatenate([none, [h[1] for h in heads]]).astype(np.int64)),
                pa.array(np.concatenate([none, [h[2] for h in heads]])),
                pa.concat_arrays([vec, vec.take(pa.array(at))]),
                pa.array(np.concatenate([none - 1, [cell if inner[h[4]].all() else -1 for h in heads]]).astype(np.int32)),
            ],
            names=["kind", "leaf", "id", "n", "radius", "vec", "core"],
        )

    held, n = [], 0
    for b in batches:
        b = b.select(["id", "vec", "inner"])
        while b.num_rows:
            take = min(b.num_rows, CHUNK - n)
            held.append(b.slice(0, take))
            b, n = b.slice(take), n + take
            if n == CHUNK:
                yield done(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield done(pa.Table.from_batches(held))


def placed(vectors: DataFrame) -> tuple[DataFrame, Broadcast]:
    """((cell, salt, id, vec, inner), (centroids, tasks of each)): each vector's nearest of centroids whose number grows with the data, and whether it is at the core of its cell.

    The rows of a crowded cell are spread by salt over tasks of about TASK_ROWS.
    """
    c, n = centroids(vectors, int(min(MOST_CELLS, max(CELLS, vectors.count() // PER_CELL))))
    shared = vectors.sparkSession.sparkContext.broadcast((c.astype(np.float32), np.clip(np.ceil(n / TASK_ROWS), 1, SALTS).astype(np.int64)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, salts = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                p = b.slice(s, 2048)
                sim = unpack(p.column(1)).astype(np.float32) @ c.T
                k = sim.argmax(1)
                salt = np.asarray(p.column(0)) % 1_000_003 % salts[k]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(salt), *p.columns, pa.array(sim[np.arange(len(k)), k] >= CORE + 1e-5)], names=["cell", "salt", "id", "vec", "inner"])

    return vectors.mapInArrow(assign, "cell long, salt long, id long, vec binary, inner boolean"), shared


def visits(rows: DataFrame, cents: Broadcast) -> DataFrame:
    """(space, side, leaf, radius, vec): where the rows (core, leaf, radius, vec) meet.

    Rows at the core of a cell are on side 0 of it, and on side 1 of each cell before it whose core they can reach. The others are on side 1 of each cell they can reach, and all on side 0 of
    space -1. Rows of side 0 meet each other and those of side 1, so any two that can be linked meet once.
    """
    theta = float(np.arccos(MIN_SIM) + np.arccos(CORE)) + 1e-4

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cents.value[0]
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                p = b.slice(s, 2048)
                core = np.asarray(p.column("core"))
                sim = unpack(p.column("vec")).astype(np.float32) @ c.T
                near = sim >= np.cos(np.minimum(theta + np.asarray(p.column("radius")), np.pi))[:, None]
                near &= (core < 0)[:, None] | (np.arange(len(c))[None] < core[:, None])
                row, cell = np.nonzero(near)
                row, space = np.concatenate([np.arange(len(core)), row]), np.concatenate([core, cell])
                side = np.repeat([0, 1], [len(core), len(cell)])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(space, pa.int64()), pa.array(side, pa.int32()), *(p.column(n).take(take) for n in ("leaf", "radius", "vec"))], names=["space", "side", "leaf", "radius", "vec"])

    return rows.select("core", "leaf", "radius", "vec").mapInArrow(visit, "space long, side int, leaf long, radius double, vec binary")


def meetings(met: DataFrame, block: int = BLOCK) -> DataFrame:
    """``met`` with p, q and role: the rows of a space in pairs of blocks. Task (p, q) has the rows of role 0 of block p, and those of role 1 of block q.

    Rows of role 0 meet each other where p = q, and always those of role 1.
    """
    n = met.groupBy("space").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / LARGE), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col(c) / block))).cast("int")
    n = n.select("space", blocks("n0").alias("b0"), blocks("n1").alias("b1"))
    x = met.join(F.broadcast(n), "space")  # one row per cell
    to = lambda p, q, role: F.struct(p.alias("p"), q.alias("q"), F.lit(role).alias("role"))
    zero, own = F.lit(0), F.col("_own")
    first = F.transform(F.sequence(zero, F.col("b0") - 1), lambda j: F.when(j < own, to(j, own, 1)).otherwise(to(own, j, 0)))
    # The first block of visitors joins the tasks of one block; the others have tasks of their own.
    more = F.when(F.col("b1") > 1, F.transform(F.sequence(F.lit(1), F.col("b1") - 1), lambda v: to(own, F.col("b0") + v, 0))).otherwise(F.array().cast("array<struct<p:int,q:int,role:int>>"))
    second = F.transform(F.sequence(zero, F.col("b0") - 1), lambda j: F.when(own == 0, to(j, j, 1)).otherwise(to(j, F.col("b0") + own, 1)))
    x = x.withColumn("_own", F.pmod(F.xxhash64("leaf"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int"))
    return x.withColumn("_t", F.explode(F.when(F.col("side") == 0, F.concat(first, more)).otherwise(second))).select("space", "_t.*", "leaf", "radius", "vec")


@dataclass(frozen=True)
class Groups:
    """members: (leaf, id, vec); labels: (leaf, label) of the leaves that are joined with others; leaves: (leaf, n)."""

    members: DataFrame
    labels: DataFrame
    leaves: DataFrame

    def labelled(self, *columns: str) -> DataFrame:
        """Members with cluster_key, the smallest id of the group, and the columns named."""
        m = self.members.select("leaf", "id", *columns).join(self.labels, "leaf", "left")
        return m.select(F.coalesce("label", "leaf").alias("cluster_key"), "id", *columns)


_PAIRS = "sure boolean, a long, b long, ra double, rb double"


def _meet(t: pa.Table, alike: bool) -> pa.Table:
    """Certain edges that span the components of leaders, and pairs of leaves still to be checked: rows of role 0 meet those of role 1, and each other if ``alike``."""
    role = np.asarray(t.column("role"))
    t = t.take(pa.array(np.lexsort((np.asarray(t.column("radius")), role))))  # leaves of like radius together
    n0 = int((role == 0).sum())
    leaf, r = np.asarray(t.column("leaf")), np.asarray(t.column("radius"))
    x = unpack(t.column("vec").combine_chunks())
    y, n = x.astype(np.float32), len(leaf)
    sure, open_ = [], []
    for s in range(0, n0, CHUNK):
        for q in range(s if alike else n0, n, TILE):
            a, b = slice(s, min(s + CHUNK, n0)), slice(q, q + TILE)
            sim = y[a] @ y[b].T
            reach = np.cos(np.minimum(THETA + r[a] + r[b].max(), np.pi))
            i, j = np.nonzero(sim >= np.minimum(reach, MIN_SIM).astype(np.float32)[:, None] - np.float32(5e-5))
            v = sim[i, j].astype(np.float64)
            i, j = i + a.start, j + q
            keep = i < j
            i, j, v = i[keep], j[keep], v[keep]
            doubt = np.abs(v - MIN_SIM) < 5e-5  # single precision can't decide these
            v[doubt] = np.round((x[i[doubt]] * x[j[doubt]]).sum(1), 6)
            hit = v >= MIN_SIM
            sure.append(np.stack([i[hit], j[hit]]))
            wide = ~hit & (r[i] + r[j] > 0) & (v >= np.cos(np.minimum(THETA + r[i] + r[j], np.pi)) - 5e-5)
            open_.append(np.stack([i[wide], j[wide]]))
    z = lambda e: np.concatenate(e, axis=1) if e else np.zeros((2, 0), np.int64)
    root = labels_of(n, *z(sure))
    a, b = z(open_)
    k = (root[a] != root[b]) & (leaf[a] != leaf[b])  # an open pair only matters between components of leaders
    a, b = a[k], b[k]
    e = np.flatnonzero(root != np.arange(n))  # one link per leaf and component
    ia, ib = np.concatenate([e, a]), np.concatenate([root[e], b])
    return pa.table([pa.array(np.repeat([True, False], [len(e), len(a)])), pa.array(leaf[ia]), pa.array(leaf[ib]), pa.array(r[ia]), pa.array(r[ib])], names=["sure", "a", "b", "ra", "rb"])


def met_pairs(met: DataFrame) -> DataFrame:
    """What ``_meet`` finds in each space of ``met``: a space of one block is one task; the blocks of others lie in the shared folder, where each pair's task reads them."""
    n = met.groupBy("space").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    n = written(n.select("space", blocks("n0").alias("b0"), blocks("n1").alias("b1")), "spaces")
    one = (F.col("b0") == 1) & (F.col("b1") == 1)
    whole = lambda key, t: _meet(t, True)
    few = met.join(F.broadcast(n.where(one)), "space").select("space", F.col("side").alias("role"), "leaf", "radius", "vec").groupBy("space").applyInArrow(whole, _PAIRS)
    many = n.where(~one)
    if many.isEmpty():
        return few
    own = F.pmod(F.xxhash64("leaf"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    read = in_blocks(met.join(F.broadcast(many), "space").select("space", "side", own.alias("own"), "leaf", "radius", "vec"), ["space", "side", "own"])
    # Blocks that hash to nothing have no files.
    there = met.join(F.broadcast(many), "space").select("space", "side", own.alias("own")).distinct()
    there = written(there, "there")
    first = there.where("side = 0").select("space", F.col("own").alias("p"))
    pairs = first.join(there, "space").where("side = 1 or own >= p").select("space", "p", "side", F.col("own").alias("q"))
    tasks = max(1, min(20_000, pairs.count() // 4))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda t, role: t.append_column("role", pa.array(np.full(t.num_rows, role, np.int32)))
        for b in batches:
            for space, p, side, q in zip(*(b.column(c).to_pylist() for c in ("space", "p", "side", "q"))):
                alike = side == 0 and p == q
                t = [at(read(space, 0, p), 0)] + ([] if alike else [at(read(space, side, q), 1)])
                yield from _meet(pa.concat_tables(t), alike).combine_chunks().to_batches()

    return few.unionByName(pairs.repartition(tasks, F.xxhash64("space", "p", "side", "q")).mapInArrow(meet, _PAIRS))


def linked_groups(vectors: DataFrame) -> Groups:
    """The groups of vectors (id, vec) connected by similarities of at least MIN_SIM."""
    home, shared = placed(vectors)
    home = home.select((F.col("cell") * SALTS + F.col("salt")).alias("cell"), "id", "vec", "inner")
    base = written(home.groupBy("cell").applyInArrow(_in_cell, _PART), "leaves")
    members = base.where("kind = 0").select("leaf", "id", "vec")
    leaves = base.where("kind = 1").select("leaf", "n", "radius", "vec", "core")
    theta = THETA
    met = written(visits(leaves, shared), "met")
    pairs = written(met_pairs(met), "pairs")
    edges = pairs.where("sure").select("a", "b")
    labels = components(edges.where("a <> b"))
    doubtful = pairs.where("not sure").dropDuplicates(["a", "b", "ra", "rb"])
    for end in ("a", "b"):  # a pair whose leaves other links have joined needs no check
        doubtful = doubtful.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end, "left")
    doubtful = written(doubtful.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b"), "doubtful")
    small = (lambda d: F.broadcast(d)) if doubtful.count() <= 100_000 else (lambda d: d)
    held = doubtful.select(F.explode(F.array("a", "b")).alias("leaf")).distinct()
    for end in ("a", "b"):
        doubtful = leaves.select(F.col("leaf").alias(end), F.col("radius").alias(f"r{end}"), F.col("vec").alias(f"v{end}")).join(small(doubtful) if end == "a" else doubtful, [end, f"r{end}"])
    doubtful = written(doubtful, "ends")
    ends = doubtful.select(F.col("a").alias("leaf"), "a", "b", F.lit(0).alias("side"), F.col("rb").alias("r"), F.col("vb").alias("other")).unionByName(
        doubtful.select(F.col("b").alias("leaf"), "a", "b", F.lit(1).alias("side"), F.col("ra").alias("r"), F.col("va").alias("other"))
    )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only members that can reach the other leaf."""
        for b in batches:
            if b.num_rows:
                cos = (unpack(b.column("vec")) * unpack(b.column("other"))).sum(1)
                ok = cos >= np.cos(np.minimum(theta + np.asarray(b.column("r")), np.pi))
                yield b.filter(pa.array(ok)).select(["a", "b", "side", "vec"])

    def verify(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        side, x = np.asarray(t.column("side")), unpack(t.column("vec"))
        p, q = x[side == 0], x[side == 1]
        hit = any(linked(p[s : s + CHUNK], q[z : z + CHUNK]).any() for s in range(0, len(p), CHUNK) for z in range(0, len(q), CHUNK))
        return pa.table([pa.array([k.as_py()] if hit else [], pa.int64()) for k in key], names=["a", "b"])

    candidates = members.join(small(held), "leaf", "left_semi").join(ends, "leaf").select("a", "b", "side", "r", "vec", "other")
    proven = candidates.mapInArrow(within, "a long, b long, side int, vec binary").groupBy("a", "b").applyInArrow(verify, "a long, b long")
    proven = written(proven, "proven")
    if not proven.isEmpty():
        labels = components(edges.unionByName(proven).where("a <> b"))
    return Groups(members, labels.select(F.col("node").alias("leaf"), "label"), leaves.select("leaf", "n"))

"""Exact and near-duplicate groups, keep suggestions, stacks and their synchronisation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.operators.graph import components

col = F.col
# Words in a path that speak against keeping the file.
BAD_WORDS = ["backup", "copy", "old", "duplicate", "temp", "tmp"]
MAX_DISTANCE = 4
#: Segments (first bit, bits) of a hash. With six, four differing bits leave two alike, so each pair of segments is a key.
SEGMENTS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def exact_groups(photos: DataFrame) -> DataFrame:
    """(file_hash, photo_id): photos of equal size and content, groups of at least two. Sizes prune before contents are compared."""
    p = photos.where("file_hash is not null and file_size is not null")
    sizes = p.groupBy("file_size").agg(F.count("*").alias("n")).where("n > 1").select("file_size")
    p = p.join(sizes, "file_size", "left_semi")
    groups = p.groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1").select("file_hash")
    return p.join(groups, "file_hash", "left_semi")


def penalty(path: str) -> Column:
    """100 for each bad word that the path contains as a whole word."""
    words = F.split(F.lower(path), "[^a-z0-9]+")
    return sum((F.array_contains(words, w).cast("int") * 100 for w in BAD_WORDS), F.lit(0))


def keep_suggestions(groups: DataFrame) -> DataFrame:
    """(file_hash, keep): no bad words, the larger file, the shorter path, then the earlier photo and path."""
    w = W.partitionBy("file_hash").orderBy(penalty("file_path"), col("file_size").desc(), F.length("file_path"), col("taken").asc_nulls_last(), "file_path", "photo_id")
    return groups.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file_hash", col("photo_id").alias("keep"))


def sign_hash(vec: str) -> Column:
    """64 bits: bit i says whether number i of the vector is positive."""
    bits = F.transform(F.slice(vec, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: str, b: str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def near_pairs(hashes: DataFrame) -> DataFrame:
    """(a, b): hashes (phash, distinct) that differ in at most 4 bits, each pair once.

    Each of the 15 pairs of six segments is a key of 20 to 22 bits; 4 flips leave two segments alike, so the join is lossless. Candidates per hash are some four
    millionths of the hashes, and a value that many hashes share is split by the adaptive join.
    """
    part = lambda x, k: F.shiftrightunsigned(x, SEGMENTS[k][0]).bitwiseAND(F.lit((1 << SEGMENTS[k][1]) - 1))
    keys = list(combinations(range(len(SEGMENTS)), 2))
    b = hashes.select("phash", F.posexplode(F.array(*[F.shiftleft(part(col("phash"), i), 11).bitwiseOR(part(col("phash"), j)) for i, j in keys])).alias("k", "v"))
    x, y = b.select("k", "v", col("phash").alias("a")), b.select("k", "v", col("phash").alias("b"))
    j = x.join(y, ["k", "v"]).where((col("a") < col("b")) & (hamming("a", "b") <= MAX_DISTANCE))
    # A pair counts only under the first key it shares, so no distinct() is needed.
    diff = col("a").bitwiseXOR(col("b"))
    alike = [part(diff, k) == 0 for k in range(len(SEGMENTS))]
    first = F.lit(None).cast("int")
    for k, (p, q) in reversed(list(enumerate(keys))):
        first = F.when(alike[p] & alike[q], k).otherwise(first)
    return j.where(col("k") == first).select("a", "b")


def near_groups(items: DataFrame, key: str) -> DataFrame:
    """(key, phash, group_key): items (key, phash) linked over any number of steps by hashes at most 4 bits apart, groups of at least two.

    Equal hashes are one node, so copies never pair with each other. group_key is the smallest hash of the group.
    """
    distinct = items.where("phash is not null").select("phash").distinct()
    labels = components(near_pairs(distinct))
    g = items.where("phash is not null").join(labels.select(col("node").alias("phash"), "label"), "phash", "left").withColumn("group_key", F.coalesce("label", "phash"))
    big = g.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return g.join(big, "group_key", "left_semi").select(key, "phash", "group_key")


def synced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action): kept, new or stale, from the keys of the stored and the detected groups."""
    o, n = old.select(key, F.lit(1).alias("_o")).distinct(), new.select(key, F.lit(1).alias("_n")).distinct()
    action = F.when(col("_o").isNull(), "new").when(col("_n").isNull(), "stale").otherwise("kept")
    return o.join(n, key, "full").select(key, action.alias("action"))


def member_set_key(groups: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, set_key): a digest that two groups share if and only if their members are the same."""
    return groups.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(member)).cast("array<string>"), ","), 256).alias("set_key"))


def claimed(kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """(kind, group_key, photo_id) of stacks: kinds claim in order, a photo is claimed once, and a group left with fewer than two claims none."""
    taken, out = None, None
    for kind, groups in kinds:
        g = groups.select("group_key", "photo_id").distinct()
        g = g.join(taken, "photo_id", "left_anti") if taken is not None else g
        big = g.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
        g = g.join(big, "group_key", "left_semi").select(F.lit(kind).alias("kind"), col("group_key").cast("string"), "photo_id")
        out = g if out is None else out.unionByName(g)
        taken = out.select("photo_id")
    return out


def quality(n_faces: str, suggested: Column | None = None, sharp: Column | None = None, brightness: Column | None = None) -> Column:
    """Points: 20 for a pick, up to 72 for resolution, 4 for size, 10 for faces, 40 for sharpness and 8 for a medium brightness (0 to 1)."""
    mp = F.coalesce(F.when((col("width") > 0) & (col("height") > 0), col("width").cast("double") * col("height") / 1e6), F.lit(0.0))
    size = F.coalesce(F.when(col("file_size") > 0, F.least(F.log(col("file_size").cast("double")) / 20, F.lit(4.0))), F.lit(0.0))
    points = F.lit(1.2) * F.least(mp, F.lit(60.0)) + size + F.lit(2.0) * F.least(n_faces, F.lit(5))
    if suggested is not None:
        points = points + F.when(suggested, 20.0).otherwise(0.0)
    if sharp is not None:
        points = points + F.coalesce(F.least(sharp, F.lit(40.0)), F.lit(0.0))
    if brightness is not None:
        points = points + F.coalesce(8.0 * F.greatest(F.lit(0.0), 1.0 - F.abs(brightness - 0.5) * 2.0), F.lit(0.0))
    return points


def covers(members: DataFrame) -> DataFrame:
    """(group_key, cover): of members (group_key, photo_id, score, suggested, file_size) the best by score, then the pick, the larger file and the smaller id."""
    return members.groupBy("group_key").agg(F.min_by("photo_id", F.struct(-col("score"), ~col("suggested"), -F.coalesce("file_size", F.lit(0)), "photo_id")).alias("cover"))


def synced_stacks(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(group_key, cover, action) after a detection: stored stacks (group_key, cover, dismissed) that were dismissed stay so and get no members; a stored cover stays while it is a member;
    stacks not found again go, unless dismissed. ``found``: group_key, photo_id, best (the cover by score)."""
    g = found.join(stored.withColumnRenamed("cover", "_old"), "group_key", "left")
    g = g.groupBy("group_key").agg(F.count("*").alias("n"), F.first("best").alias("best"), F.max(F.when(col("photo_id") == col("_old"), col("_old"))).alias("_kept"), F.max("_old").alias("_old"), F.max("dismissed").alias("dismissed")).where("n > 1")
    new = g.select("group_key", F.when(col("dismissed"), col("_old")).otherwise(F.coalesce("_kept", "best")).alias("cover"), F.when(col("dismissed"), "dismissed").when(col("_old").isNull(), "new").otherwise("kept").alias("action"))
    gone = stored.join(g, "group_key", "left_anti").select("group_key", "cover", F.when(col("dismissed"), "dismissed").otherwise("removed").alias("action"))
    return new.unionByName(gone)


def sharpness(images: DataFrame, key: str, luma: str, side: int) -> DataFrame:
    """(key, blur, brightness): variance of the 4-neighbour Laplacian and mean, of square images given as arrays of luma."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(1).cast(pa.list_(pa.float64()))
            ok = np.flatnonzero(np.asarray(a.value_lengths().fill_null(0)) == side * side)
            x = np.array([v.values.to_numpy(zero_copy_only=False) for v in a.take(pa.array(ok))]).reshape(-1, side, side)
            lap = x[:, :-2, 1:-1] + x[:, 2:, 1:-1] + x[:, 1:-1, :-2] + x[:, 1:-1, 2:] - 4 * x[:, 1:-1, 1:-1]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(lap.var(axis=(1, 2))), pa.array(x.mean(axis=(1, 2)))], names=[key, "blur", "brightness"])

    return images.select(col(key).cast("long"), luma).mapInArrow(run, f"{key} long, blur double, brightness double")

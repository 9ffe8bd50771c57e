"""References to records that do not exist, or that arrived only after the reference.

A Bloom filter over the parent keys, of bounded size, is broadcast and proves most dangling references
at once, without a shuffle. Only the references that pass it are joined with the parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter never exceeds this many bits (32 MB), however many parents there are. With more parents it
#: lets more references through to the exact join; the result stays the same.
MAX_BITS = 1 << 28
BITS_PER_KEY = 10
HASHES = 4


@dataclass(frozen=True)
class References:
    """One referring table, its columns already named record_key, ref and at."""

    name: str
    rows: DataFrame


def norm_hash(c: Column) -> Column:
    """A content hash without outer blanks and in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x00]+|[\s\p{Z}\x00]+$", ""))


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    for i in range(HASHES):
        yield (a + np.uint64(i) * b) & np.uint64(bits - 1)


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(17)).alias("_h1"), F.xxhash64(F.col(key), F.lit(4099)).alias("_h2")]


def bloom_filter(parents: DataFrame, key: str) -> tuple[bytes, int]:
    """(bit set, number of bits) of the keys. Each task fills one bit set; sets are merged by OR on executors.

    There are at most two tasks per core, however many files, and a task sends the slices of its set as bit offsets where these are shorter, so that merging moves at most
    16 bytes per key and at most two sets per core.
    """
    n = parents.count()
    bits = 1 << 13
    while bits < min(n * BITS_PER_KEY, MAX_BITS):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = np.zeros(bits // 8, np.uint8), False
        for b in batches:
            some = some or b.num_rows > 0
            for p in _positions(np.asarray(b.column(0)), np.asarray(b.column(1)), bits):
                np.bitwise_or.at(own, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        if some:
            step = 1 << 16  # slices, so that no merging task holds whole filters of many partitions
            for k in range(0, len(own), step):
                at = np.flatnonzero(np.unpackbits(own[k : k + step], bitorder="little")).astype(np.uint32)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([at.tobytes() if 4 * len(at) < step else own[k : k + step].tobytes()], pa.binary()), pa.array([4 * len(at) < step])], names=["k", "part", "sparse"])

    def merge(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(min(1 << 16, bits // 8), np.uint8)
        for b in batches:
            for x, sparse in zip(b.column("part"), b.column("sparse").to_pylist()):
                if sparse:
                    at = np.frombuffer(x.as_buffer(), np.uint32)
                    np.bitwise_or.at(whole, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
                else:
                    whole |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key_[0].as_py()], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["k", "part"])

    keys = parents.where(F.col(key).isNotNull()).select(*_hashes(key)).coalesce(2 * parents.sparkSession.sparkContext.defaultParallelism)
    slices = keys.mapInArrow(fill, "k long, part binary, sparse boolean")
    rows = slices.groupBy("k").applyInArrow(merge, "k long, part binary").collect()  # at most MAX_BITS / 8 bytes
    out = bytearray(bits // 8)
    for r in rows:
        out[r.k : r.k + len(r.part)] = r.part
    return bytes(out), bits


def orphan_references(refs: list[References], parents: DataFrame) -> DataFrame:
    """(src_table, record_key, period, kind) of each reference whose parent is missing or late.

    ``parents`` has the columns key and known_at. A reference with a null ref is none. kind is 'missing' if no
    parent has the key, 'late' if the parent's earliest known_at is after the reference's own time (both known).
    period is the month of that time, or 'unknown'. Repeated rows of a record count once, with its earliest time.
    Empty tables give no rows; with no parents every reference is missing. Other columns are ignored.
    """
    spark = parents.sparkSession
    parents = parents.select("key", "known_at")
    bits_, n = bloom_filter(parents, "key")
    shared = spark.sparkContext.broadcast(bits_)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            hit = np.ones(b.num_rows, bool)
            for p in _positions(np.asarray(b.column("_h1")), np.asarray(b.column("_h2")), n):
                hit &= (f[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(hit)], names=[*b.schema.names[:-2], "maybe"])

    every = None
    for r in refs:
        x = r.rows.select(F.lit(r.name).alias("src_table"), F.col("record_key").cast("string"), "ref", F.col("at").cast("timestamp_ntz"))
        every = x if every is None else every.unionByName(x)
    every = every.where(F.col("ref").isNotNull())
    schema = every.limit(0).withColumn("maybe", F.lit(True)).schema
    probed = every.select("*", *_hashes("ref")).mapInArrow(probe, schema)

    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period")
    sure = probed.where(~F.col("maybe")).select("src_table", "record_key", "at", F.lit("missing").alias("kind"))
    known = parents.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("ref")).agg(F.min("known_at").alias("known_at"), F.lit(True).alias("there"))
    checked = probed.where("maybe").join(known, "ref", "left").select(
        "src_table", "record_key", "at",
        F.when(F.col("there").isNull(), "missing").when(F.col("known_at") > F.col("at"), "late").alias("kind"),
    )
    found = sure.unionByName(checked.where(F.col("kind").isNotNull()))
    # Copies of a record say the same; 'late' of a copy with a later time must not remain beside the earliest one.
    one = found.groupBy("src_table", "record_key").agg(F.min("at").alias("at"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    return one.select("src_table", "record_key", period, F.when(F.col("k2") == "missing", "missing").otherwise(F.col("k1")).alias("kind"))


def orphan_report(found: DataFrame) -> DataFrame:
    """(src_table, period, kind, n): the orphans of ``orphan_references`` counted per table and month."""
    return found.groupBy("src_table", "period", "kind").agg(F.count("*").alias("n"))

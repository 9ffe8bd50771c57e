"""Streams of a library: files that arrive, sessions in event time, and idempotent merges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shutterlake.operators.ingest import extension, wanted
from shutterlake.session import shared_dir

col = F.col


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the files below a folder that are wanted: (path, length, modificationTime, ext)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return s.where(wanted("path", "length")).select("path", "length", "modificationTime", extension("path").alias("ext"))


def tables(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a table as they arrive."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windows(events: DataFrame, time: str, late: str, size: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per window and keys; rows later than ``late`` behind the newest are dropped once their window is closed."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(col("w.start").alias("start"), col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions per keys, closed by a gap in event time."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(col("w.start").alias("start"), col("w.end").alias("end"), *keys, "n")


def bursts(events: DataFrame, key: str, time: str, late: str, gap_s: float, span_s: float) -> DataFrame:
    """(key, burst_start, burst_end, n): a burst ends at a gap of more than ``gap_s`` or when it gets longer than ``span_s``, or once the watermark is a gap past it.

    The state of a key is its open burst only. Rows of a batch are taken in order of time; a row from before the open burst's end is added to it.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((k[0], *state.get))
            state.remove()
        else:
            start, last, n = state.get if state.exists else (None, None, 0)
            times = sorted(t.timestamp() for f in frames for t in f[time])
            for t in times:
                if start is not None and (t - last > gap_s or t - start > span_s):
                    out.append((k[0], start, last, n))
                    start = None
                start, last, n = (t, t, 1) if start is None else (start, max(last, t), n + 1)
            state.update((start, last, n))
            state.setTimeoutTimestamp(max(int((last + gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "burst_start", "burst_end", "n"])

    e = events.select(key, time).withWatermark(time, late)
    return e.groupBy(key).applyInPandasWithState(step, f"{key} long, burst_start double, burst_end double, n long", "start double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over what is there now, each batch through ``write``; what a checkpoint remembers isn't read again."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the data that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-out-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    spark.createDataFrame([], stream.schema).write.parquet(path)
    run_once(stream, write, mode)
    return spark.read.schema(stream.schema).parquet(path)


def merging(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the last row of each key in a table; a batch delivered twice changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/{batch_id - 1}")
            batch = old.unionByName(batch)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return write

"""Session helpers: shared-folder tables that cut lineage, and sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent in local mode (as in tests) a temporary folder is made; on a cluster its absence is an error, as the
    executors' own disks aren't shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
        spark.sparkContext.setCheckpointDir(base)
        _made.append((spark, base))
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stamp(spark: SparkSession, path: str) -> str:
    """The state of a file or folder: its path, and size and time of what lies in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path}|" + "|".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in fs.listStatus(p)))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(step: DataFrame) -> None:
    """Remove the files of a step that ``written`` made, once nothing reads it any more."""
    spark = step.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in step.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_blocks(df: DataFrame, by: list[str], name: str = "blocks") -> Callable[..., pa.Table]:
    """A function for the executors: given values of the whole numbers ``by``, the rows of ``df`` that have them, from the shared folder.

    Tasks that meet in pairs read blocks from there, so no row is copied for each pair it is part of.
    """
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh(spark, name))
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    df.repartition(*by).write.partitionBy(*by).parquet(root)
    columns = [c for c in df.columns if c not in by]

    def read(*values: int) -> pa.Table:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(root)
        return ds.dataset("/".join([path, *(f"{c}={v}" for c, v in zip(by, values))]), filesystem=fs, format="parquet").to_table(columns=columns, use_threads=False)

    return read


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return

"""Reliable lineage cuts for iterative jobs and shared intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only for local sessions that name none; a cluster
    session without one is an error, because files on one machine would not
    survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[context.applicationId]


#: Delete the shuffles of a query when it ends instead of when the driver collects them.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back.

    Like a checkpoint it survives the loss of executors, and it gives the planner
    the true size: a checkpointed frame keeps the size estimate of its old plan,
    which multiplies with every join and is useless after a few rounds.  ``tidy`` deletes
    the shuffles behind the table, which nothing reads any more, with the end of the job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._is_cut = True
    return kept


def once(df: DataFrame) -> DataFrame:
    """``df`` itself if :func:`cut` returned it, else the table that :func:`cut` makes of it."""
    return df if getattr(df, "_is_cut", False) is True else cut(df)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`cut` returned and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a frame that :func:`cut` returned (what the planner knows of it)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_small(df: DataFrame, small: DataFrame, on, how: str = "left", limit: int = 8 << 20) -> DataFrame:
    """Join a per-group table that is usually small.

    The table is written first; up to ``limit`` bytes on disk it is broadcast, above
    it the join shuffles and adaptive execution splits partitions of hot keys.
    """
    kept = cut(small)
    return df.join(F.broadcast(kept) if stored_bytes(kept) <= limit else kept, on, how)

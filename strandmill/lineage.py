"""Dealing out small inputs, and lineage cutting in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Seconds between two requests for a garbage collection.
_PAUSE = 5.0
_collected = 0.0


def spread(df: DataFrame) -> DataFrame:
    """Deals out rows of an input that fills fewer splits than there are cores, such as a file of a single row group.

    Anything larger is left as it is read, so what is shuffled here is bounded by the cores' number of splits.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * split else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one only on a local master, where that setting is absent."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    Shuffle files go, and with `spark.cleaner.referenceTracking.cleanCheckpoints` checkpoints too, when nothing refers to
    them and the driver collects its garbage, so it is asked to every few seconds: what a long chain of steps keeps on disk is
    then about the widest step, not all of them.
    """
    global _collected
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    if time.monotonic() - _collected > _PAUSE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    return out


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes rows as a compressed table in the shared folder and reads them again; for wide rows, smaller than a checkpoint."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

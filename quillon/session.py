"""Session helpers: shared scratch space, partition spreading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, where that is unset on a local master (tests), a new local one.

    On a cluster an unset folder is an error: what one executor wrote to its own disk the others would not find.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_quillon_scratch", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        folder = tempfile.mkdtemp(prefix="quillon-")
        sc._quillon_scratch = folder
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not getattr(sc, "_quillon_checkpointing", False):
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(folder)
        sc._quillon_checkpointing = True
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its rows and their partitions fixed in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read back, so that it is computed once; removed when the session ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, scanned: bool = True) -> DataFrame:
    """df in at least as many partitions as there are cores; df itself where its scan has them.

    For scans feeding Python work: a table of one small file would otherwise occupy one core. Give scanned=False for
    what comes out of a shuffle, whose partitions are chosen at run time: counting them would run it.
    """
    if not scanned:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

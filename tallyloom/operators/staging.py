"""Written intermediate tables.

A staged table cuts lineage: it survives lost executors, has file statistics and supports column
pruning. It lives in the shared folder named by `spark.checkpoint.dir`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tallyloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def stage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Stage `df` and count its rows from the written files."""
    table = stage(df)
    return table, table.count()


def staged_paths() -> list[str]:
    """Folders of the staged tables of this process that still exist."""
    return list(_STAGED)


def release_staged(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete staged tables of this process, all or those in some folders, once their readers are done."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path  # the only public way to reach the cluster's file system
    removed = 0
    for path in staged_paths() if paths is None else paths:
        if path in _STAGED:
            _STAGED.remove(path)
            target = hadoop(path)
            removed += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return removed


def unstage(*tables: DataFrame | None) -> None:
    """Delete tables made by `stage` that nothing reads any more, as those of earlier rounds of an iteration."""
    for table in tables:
        if table is not None:
            release_staged(table.sparkSession, [table.staged_path])


def release_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files that no plan can read any more.

    Spark deletes them when the driver's garbage collector has found their plans unused, which on a quiet driver
    comes long after a large step. To be called after those, not in every round of an iteration.
    """
    spark._jvm.System.gc()

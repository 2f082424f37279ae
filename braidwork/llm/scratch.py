"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one under the warehouse, which must not be a local folder on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (":" not in warehouse or warehouse.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset, and the warehouse is a local folder")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete what stands at ``path`` when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)


def written(df: DataFrame, *, name: str = "part", release: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing.

    The table goes when the driver's JVM ends. ``release`` is for steps with large
    shuffles: Spark deletes their files once the driver's objects for them are gone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    if release:
        gc.collect()
        spark._jvm.System.gc()
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    if _open:
        _open[-1].append(found)
    return found


#: Tables written in each of the steps that are open, the innermost last.
_open: list[list[DataFrame]] = []


@contextmanager
def step():
    """A step whose tables go when it ends, but for the written ones given to the function it yields."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept.append
    finally:
        mine = _open.pop()
        drop(*[df for df in mine if not any(df is k for k in kept)])
        if _open:
            _open[-1].extend(kept)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

"""Tables that a query writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on this machine alone (tests) gets a temporary
    one; on a cluster, whose executors could not read that, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what materialize() wrote, when no later plan reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that queries have left in the shared folder, when no result reads them any more."""
    drop_path(spark, f"{shared_folder(spark)}/tidemark")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors, runs df once."""
    return materialize_at(df, fresh_path(df.sparkSession, tag))


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of plans that are done with, so that Spark deletes their shuffle files, which would else lie on the executors'
    disks until the driver's heap happens to be collected. For use after a materialize() with a large exchange below it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the files and folders in a folder; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []

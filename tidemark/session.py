"""A session with the settings that the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource


def session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Adaptive execution with skew-join splitting, UTC, Arrow; a cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def add_sources(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Makes Python data sources formats of the session, for the calling thread too: Spark looks formats up in the session that
    is active in the thread, and in one that did not make the session none is until it has made a table from local rows."""
    for source in sources:
        spark.dataSource.register(source)
    spark.createDataFrame([], "none int")

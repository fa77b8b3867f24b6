"""Session factory: UTC, adaptive execution, partition counts from the configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "harvest", master: str | None = None, shuffle_partitions: int | None = None, warehouse: str | None = None, memory: str | None = None) -> SparkSession:
    """A session with the settings that the library's results depend on (UTC) or profit from (AQE).

    ``master``, ``shuffle_partitions`` and ``memory`` stay as the cluster sets them unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in (("spark.master", master), ("spark.sql.shuffle.partitions", shuffle_partitions), ("spark.sql.warehouse.dir", warehouse), ("spark.driver.memory", memory)):
        if value is not None:
            builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

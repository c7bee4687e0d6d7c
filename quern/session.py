"""Session builder with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quern", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Get a session: UTC, adaptive execution, skew-join splitting.

    ``master`` is left to spark-submit when None. ``partitions`` sets the shuffle
    partitions; on a cluster leave it to the deployment (about one per 128 MB shuffled).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.ui.enabled": "false",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    if master and master.startswith("local"):
        base["spark.driver.memory"] = os.environ.get("QUERN_DRIVER_MEMORY", "8g")
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, for work that costs far more than moving them.

    Only a table of few row groups has fewer tasks than there are cores and is dealt anew;
    one of many, as any large one, is read where it lies, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

"""Incremental appends: what a run has done is known by its checkpoint, and the next goes on from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def append_new(
    spark: SparkSession, schema: StructType, source: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d
) -> None:
    """``work`` on the Parquet files of ``source`` that no earlier run has read, appended to ``target``; ends when all are read.

    A run that is stopped is taken up by the next at its last finished batch; a file counts once.
    """
    new = work(spark.readStream.schema(schema).parquet(source))
    q = new.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(target)
    q.awaitTermination()

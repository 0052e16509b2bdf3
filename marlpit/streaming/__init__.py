"""Queries over growing folders, run as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def catch_up(spark: SparkSession, source: str, target: str, checkpoint: str, query: Callable[[DataFrame], DataFrame]) -> None:
    """Applies ``query``, of projections, selections and joins with tables, to the Parquet files of ``source`` that no call before has seen, and adds its rows to ``target``.

    ``checkpoint`` keeps what has been read, so a call that was broken off goes
    on where it was, and each file counts once.
    """
    schema = spark.read.parquet(source).schema
    stream = query(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target).awaitTermination()

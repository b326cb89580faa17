"""The trace log as a stream of appended files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.jsonl import TRACE


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of the log as they are appended; feedback rows are left out."""
    return spark.readStream.schema(TRACE).json(path).where("type IS NULL OR type <> 'feedback'")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived and stop; a later call goes on from there."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

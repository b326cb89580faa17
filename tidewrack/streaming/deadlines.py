"""Stages with a deadline: what of a stage arrives in time counts, the rest is left out, and partial stages stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stages(arrivals: DataFrame, boards: Sequence[str], at: str = "ts", board: str = "event_type", length: str = "1 hour", deadline: str = "20 minutes", delay: str = "1 hour") -> DataFrame:
    """start, boards, on_time, late, complete of each stage, as a stream or as a batch.

    A stage begins every ``length``; what arrives until ``deadline`` after its start, that
    moment included, is in time.  boards lists, in order, those of the asked ones that were;
    on_time and late count their arrivals, and a stage is complete if no board is missing.
    Boards that aren't asked, and rows without a time, are left out; a stage of late
    arrivals only has its row.  A stream forgets a stage when its watermark, the latest
    arrival less ``delay``, passes the stage's end; what arrives for it then is dropped.
    Times without a zone are the session's.  The state holds a few numbers and at most ``boards`` names for each open stage.
    """
    asked = arrivals.where(F.col(at).isNotNull() & F.col(board).isin(list(boards))).select(F.col(at).cast("timestamp").alias("_at"), F.col(board).alias("_board"))
    if asked.isStreaming:
        asked = asked.withWatermark("_at", delay)
    start = F.window("_at", length)
    in_time = F.col("_at") <= F.col("_start") + F.expr(f"INTERVAL {deadline}")
    rows = asked.withColumn("stage", start).withColumn("_start", F.col("stage.start"))
    out = rows.groupBy("stage").agg(F.array_sort(F.collect_set(F.when(in_time, F.col("_board")))).alias("boards"), F.count_if(in_time).alias("on_time"), F.count_if(~in_time).alias("late"))
    return out.select(F.col("stage.start").cast(arrivals.schema[at].dataType).alias("start"), F.array_join("boards", ",").alias("boards"), "on_time", "late", (F.size("boards") == len(set(boards))).alias("complete"))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the stages that are over to files and stop; a later call goes on with those that are open."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def closed(spark: SparkSession, path: str, kind: str = "timestamp") -> DataFrame:
    """The stages that were written; ``kind`` is the type of their start."""
    return spark.read.schema(f"start {kind}, boards string, on_time long, late long, complete boolean").parquet(path)

"""Runs from a stream of steps that come late and more than once, with state that does not grow.

A step may come any number of times, and up to ``delay`` after the newest step seen. Steps that come
again are dropped within that time, and a run is given out once, when nothing of its day can come any
more. What the stream keeps are the steps of about ``delay`` and the runs that are still open; both are
dropped as the watermark passes. Steps later than that are dropped too: their number is in the query's
progress (``numRowsDroppedByWatermark``).

The rows are those that `audit.run_status` gives for all steps at once, whatever the order of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerline.operators.audit import run_status_columns


def final_runs(steps: DataFrame, delay: str, window: str = "1 day") -> DataFrame:
    """The finished runs of a stream of ``steps`` with a timestamp ``at``; a run lies within one ``window``.

    Rows without a ``run_id`` are no steps: they only tell how far the time has come.
    """
    once = steps.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "step_position"])
    return (
        once.groupBy(F.window("at", window).alias("within"), "run_id")
        .agg(*run_status_columns())
        .where("run_id IS NOT NULL")
        .drop("within")
    )


def read_steps(spark: SparkSession, source: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The step files of a folder as a stream, with their time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source).withColumn("at", F.try_to_timestamp("started_at"))


def take_in(runs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the runs that are finished to ``out``, for all files that have come; exactly once each.

    State and progress are in ``checkpoint``, so the next call goes on where this one ended.
    """
    return (
        runs.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

"""Progress of running jobs as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import EVENT

TERMINAL = ("completed", "failed", "cancelled", "RECONSTRUCTION_BLOCKED")


def events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Complete lines of the progress logs below a folder, as they arrive."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def snapshots(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events with the row of their job (a static table); events of unknown jobs drop."""
    j = jobs.select(F.col("id").alias("job_id"), "name", "status")
    return log.join(j, "job_id").withColumn("final", F.col("status").isin(*TERMINAL))


def follow(rows: DataFrame, checkpoint: str, table_path: str, once: bool = False) -> StreamingQuery:
    """Append snapshots to a Parquet folder, exactly once each."""
    w = rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def without_copies(samples: DataFrame, time: str, keys: list[str], lateness: str = "1 minute") -> DataFrame:
    """Drops samples seen before within the lateness; later ones are let through as new."""
    return samples.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, time])


def latest_state(log: DataFrame, by: str = "job_id") -> DataFrame:
    """Last stage and progress of each job; state is one row a job (complete or update mode)."""
    return log.groupBy(by).agg(F.max_by("stage", F.col("elapsed_sec")).alias("stage"), F.max("progress").alias("progress"))


def windowed_rates(samples: DataFrame, time: str, size: str, lateness: str, *keys: Column) -> DataFrame:
    """Samples per window and key, each window once when it is over."""
    return samples.withWatermark(time, lateness).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))

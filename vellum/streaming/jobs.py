"""Job queue as streams: state of jobs, micro-batches with retries, cache with time to live, windowed counts.

The state machine of a job is a fold over its status events: the last event wins, terminal ones stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def job_state(log: DataFrame, job: str, status: str, ts: str) -> DataFrame:
    """Current state of each job: its first terminal event, else its last one. Works on batches and on streams."""
    rank = F.when(F.col(status).isin(*TERMINAL), F.struct(F.lit(1).alias("t"), (-F.unix_micros(F.col(ts))).alias("o"))).otherwise(F.struct(F.lit(0).alias("t"), F.unix_micros(F.col(ts)).alias("o")))
    return log.groupBy(job).agg(F.max_by(F.col(status), rank).alias("state"), F.max(ts).alias("changed"))


def windowed_counts(stream: DataFrame, ts: str, late: str, size: str, key: str) -> DataFrame:
    """Counts per tumbling window and key, final once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def first_within(stream: DataFrame, key: list[str], ts: str, ttl: str) -> DataFrame:
    """Drops repeats of a key that come within its time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, most: int = 3):
    """Each micro-batch goes to ``handle``, at most ``most`` times; the checkpoint makes a restart go on from there."""

    def batch(df: DataFrame, number: int) -> None:
        for attempt in range(1, most + 1):
            try:
                return handle(df, number)
            except Exception:
                if attempt == most:
                    raise

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def await_done(query, seconds: float) -> bool:
    """Wait for a query at most so long; whether it ended."""
    return bool(query.awaitTermination(seconds))


def queue_head(jobs: DataFrame, status: str, created: str, position: str) -> DataFrame:
    """The job that is next: the oldest pending one."""
    return jobs.filter(F.col(status) == "pending").orderBy(created, position).limit(1)


def retry_ladder(scored: DataFrame, doc: str, attempt: str, score: str, most: int = 3) -> DataFrame:
    """Which documents go again: the last attempt of each, below 85 but at least 70, with attempts left."""
    w = Window.partitionBy(doc).orderBy(F.desc(attempt))
    last = scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return last.withColumn("again", (F.col(score) < 85) & (F.col(score) >= 70) & (F.col(attempt) < most))

"""Scoring over streams: the batch functions are stateless per row, so a stream runs the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import prepare_jobs, prepare_resumes, score_pairs


def read_pairs(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of JSON-lines files of (resume, job) records."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def score(stream: DataFrame, criteria: list[tuple[str, float]] | None = None) -> DataFrame:
    """Scored pairs of a batch or stream of rows with structs `resume` and `job`."""
    return score_pairs(prepare_jobs(prepare_resumes(stream)), criteria)


def latest_only(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Repeated submissions of a key within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))

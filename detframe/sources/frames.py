"""Frames as rows: every n-th frame, source and retained numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.operators.ranking import ranked


def checked_rate(drop_rate: int) -> int:
    if drop_rate <= 0:
        raise ValueError("drop_rate must be greater than 0")
    return drop_rate


def every_nth(frames: DataFrame, drop_rate: int) -> DataFrame:
    """Frames whose source number is a multiple of ``drop_rate``, with their running number."""
    rate = F.lit(checked_rate(drop_rate))
    kept = frames.where(F.col("frame_number") % rate == 0)
    return kept.withColumn("frame_count", F.floor(F.col("frame_number") / rate))


def numbered(frames: DataFrame, *order: str) -> DataFrame:
    """Number unnumbered frames from 0 in a unique order."""
    rows = ranked(frames, [], [F.col(c) for c in order], "_n")
    return rows.withColumn("frame_number", F.col("_n") - 1).drop("_n")


def frame_stream(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """Unbounded frame rows from a folder of Parquet files."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)

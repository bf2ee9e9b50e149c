"""The frame pipeline as Structured Streaming jobs: stateless decode and suppression, log, running total."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.operators.suppress import suppress_array
from detframe.session import path_exists, work_dir


def suppressed_frames(frames: DataFrame, iou: float = 0.4, score: float = 0.5) -> DataFrame:
    """Surviving detections of each frame row; no shuffle and no state, so it scales with the source."""
    return frames.withColumn("kept", suppress_array(F.col("dets"), iou, score))


def detection_log(kept: DataFrame) -> DataFrame:
    """One row per surviving detection, best score first."""
    return kept.select("frame_number", F.posexplode("kept").alias("order", "d")).select(
        "frame_number", "order", "d.class_id", "d.x", "d.y", "d.w", "d.h", "d.score"
    )


def frame_counts(kept: DataFrame) -> DataFrame:
    return kept.select("frame_number", F.size("kept").cast("bigint").alias("detections"))


def _folder(stream: DataFrame, label: str) -> str:
    return f"{work_dir(stream.sparkSession)}/detframe/streams/{label}-{uuid.uuid4().hex}"


def _places(stream: DataFrame, label: str, path: str | None, checkpoint: str | None) -> tuple[str, str]:
    """Output and state folders; a restarted job passes its own again and goes on where it stopped."""
    folder = _folder(stream, label)
    return path or f"{folder}/data", checkpoint or f"{folder}/state"


def run_to_table(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Append a stream to Parquet, then scan the result. ``trigger`` as for ``writeStream.trigger``; by default all there is now."""
    path, checkpoint = _places(stream, label, path, checkpoint)
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


#: Frame numbers of one folder of the log, the least that a batch has to look through.
LOG_SPAN = 100_000


def logged_frames(kept: DataFrame, path: str) -> DataFrame:
    """What a log holds: one row per frame with its ``detections`` and the boxes ``kept``; ``kept`` gives the types."""
    spark = kept.sparkSession
    schema = kept.select("frame_number", F.size("kept").cast("bigint").alias("detections"), "kept", F.lit(0).cast("bigint").alias("span")).schema
    stored = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    return stored


def run_log(
    kept: DataFrame, label: str = "log", path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None,
    span: int = LOG_SPAN,
) -> DataFrame:
    """Write the detection log, each numbered frame once, whatever batch brings it and however often.

    A frame is one row of the stored log, in a folder for its range of ``span`` numbers. A batch adds the frames that the folders
    it touches do not hold yet; so a repeated batch, a half-written one and a new start without its checkpoint add nothing twice.
    One job writes to a path at a time. Returns the log with one row per detection; :func:`logged_frames` gives it with counts.
    """
    path, checkpoint = _places(kept, label, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            "frame_number", F.size("kept").cast("bigint").alias("detections"), "kept",
            F.floor(F.col("frame_number") / span).alias("span"),
        ).dropDuplicates(["frame_number"]).persist()
        ends = rows.agg(F.min("span").alias("low"), F.max("span").alias("high")).first()
        if ends.low is not None:
            there = logged_frames(kept, path).where(F.col("span").between(ends.low, ends.high)).select("span", "frame_number")
            rows.join(there, ["span", "frame_number"], "left_anti").write.mode("append").partitionBy("span").parquet(path)
        rows.unpersist()

    query = (
        kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    return detection_log(logged_frames(kept, path))


def running_total(frames: DataFrame) -> DataFrame:
    """Frames processed so far; for ``complete`` or ``update`` output."""
    return frames.groupBy().agg(F.count("*").alias("frames"))


def run_total(frames: DataFrame, name: str = "frame_total", path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Drive :func:`running_total` over what the source holds now; one row.

    The total is state of the stream, so it goes on where the checkpoint left it. Each batch writes it to a folder of its own.
    """
    path, checkpoint = _places(frames, name, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        running_total(frames).writeStream.foreachBatch(write).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    # totals only grow, so the latest is the largest
    return frames.sparkSession.read.parquet(path).agg(F.coalesce(F.max("frames"), F.lit(0)).cast("bigint").alias("frames"))

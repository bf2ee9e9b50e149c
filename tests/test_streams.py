"""The numbered frame source, the log that holds each frame once, and tables whose write was interrupted."""

import os

import pytest
from pyspark.sql import functions as F

from detframe.sources.numbered import numbered_stream
from detframe.sources.tables import write_table
from detframe.streaming import frames

BOXES = "frame_number long, dets array<struct<pos:int,class_id:int,x:double,y:double,w:double,h:double,score:double>>"


def frame_rows(spark, first, end):
    return spark.range(first, end).select(F.col("id").alias("frame_number"), (F.col("id") * 10).alias("ts"))


def test_frame_source_counts_on_after_a_restart(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run():
        stream = numbered_stream(spark, source, "ts long, frame_number long", drop_rate=3, part_frames=4)
        return sorted(map(tuple, frames.run_to_table(stream, "t", out, state).collect()))

    frame_rows(spark, 0, 11).repartition(3).write.parquet(source)
    assert run() == [(10 * n, n, n // 3) for n in (0, 3, 6, 9)]
    frame_rows(spark, 11, 20).write.mode("append").parquet(source)
    assert run() == [(10 * n, n, n // 3) for n in (0, 3, 6, 9, 12, 15, 18)]
    assert len(run()) == 7  # nothing new


def test_frame_source_refuses_what_it_cannot_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="cannot be opened"):
        numbered_stream(spark, f"{tmp_path}/nothing", "frame_number long")
    frame_rows(spark, 0, 1).write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="drop_rate"):
        numbered_stream(spark, f"{tmp_path}/in", "frame_number long", drop_rate=0)


def test_frame_source_without_rows(spark, tmp_path):
    frame_rows(spark, 0, 0).write.parquet(f"{tmp_path}/in")
    assert frames.run_to_table(numbered_stream(spark, f"{tmp_path}/in", "frame_number long"), "t").count() == 0


def boxes(n):
    return [(k, 0, 100.0 * k, 0.0, 10.0, 10.0, 0.9) for k in range(n)]


def test_log_holds_each_frame_once(spark, tmp_path):
    """Frames come again in other batches, twice in a batch, and after the checkpoint is lost."""
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"

    def put(*numbers):
        spark.createDataFrame([(n, boxes(n % 4)) for n in numbers], BOXES).coalesce(1).write.mode("append").parquet(source)

    def run(state):
        rows = frames.run_log(stream, path=log, checkpoint=f"{tmp_path}/{state}", span=5).collect()
        counts = {r.frame_number: r.detections for r in frames.logged_frames(stream, log).collect()}
        assert len(rows) == len({(r.frame_number, r.order) for r in rows}) == sum(counts.values())
        return counts

    put(0, 1, 2, 3, 3)
    stream = frames.suppressed_frames(spark.readStream.schema(BOXES).option("maxFilesPerTrigger", 1).parquet(source))
    put(2, 3, 11, 12)
    assert run("a") == {0: 0, 1: 1, 2: 2, 3: 3, 11: 3, 12: 0}
    put(12, 13)
    assert run("a") == {0: 0, 1: 1, 2: 2, 3: 3, 11: 3, 12: 0, 13: 1}
    assert run("lost") == {0: 0, 1: 1, 2: 2, 3: 3, 11: 3, 12: 0, 13: 1}
    assert frames.logged_frames(stream, log).count() == 7


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_an_interrupted_table_is_written_again(spark, tmp_path, fmt):
    one, two = frame_rows(spark, 0, 4), frame_rows(spark, 0, 6)
    assert write_table(one, f"{tmp_path}/t", "full", fmt=fmt).count() == 4
    assert write_table(two, f"{tmp_path}/t", "full", fmt=fmt).count() == 4
    os.remove(f"{tmp_path}/t/run_label=full/_SUCCESS")
    assert write_table(two, f"{tmp_path}/t", "full", fmt=fmt).count() == 6
    assert write_table(one, f"{tmp_path}/t", "full", force=True, fmt=fmt).count() == 4
    os.makedirs(f"{tmp_path}/t/run_label=begun/_temporary")
    assert write_table(one, f"{tmp_path}/t", "begun", fmt=fmt).count() == 4

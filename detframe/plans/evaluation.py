"""Evaluation of one or many runs: match, curves, AP, counts.

A *run* is any key carried by the detections (a model, a threshold, a
condition). All runs are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.operators.compare import run_frame
from detframe.operators.curves import average_precision_of, mean_average_precision
from detframe.operators.match import label_runs
from detframe.operators.pairs import LIMIT
from detframe.operators.suppress import suppress
from detframe.session import materialize


def runs_table(like: DataFrame, key: str, values: Sequence) -> DataFrame:
    """A short run list as rows."""
    options = F.array(*[F.lit(v) for v in values])
    return like.sparkSession.range(1).select(F.explode(options).alias(key))


def _numbered(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """``run``, the place of the row's key in ``values``; rows of runs that are not there are left out."""
    options = F.array(*[F.lit(v) for v in values])
    return df.withColumn("run", F.array_position(options, F.col(key)).cast("int") - 1).where("run >= 0")


def run_rows(
    detections: DataFrame, ground_truth: DataFrame, num_classes: int, key: str, values: Sequence, iou_threshold: float = 0.5,
    eval_type: str = "combined", limit: int = LIMIT,
) -> DataFrame:
    """Stored evaluation rows of every run, with ``key``. Boxes are paired once for all runs, see :func:`label_runs`.

    Rows depend on their image alone, so those of a subset of images are a filter of these.
    """
    options = F.array(*[F.lit(v) for v in values])
    dets = _numbered(detections, key, values)
    truth = _numbered(ground_truth, key, values) if key in ground_truth.columns else ground_truth
    rows = label_runs(dets, truth, len(values), num_classes, iou_threshold, eval_type, limit)
    return _stored_rows(rows.select(F.get(options, F.col("run")).alias(key), *[c for c in rows.columns if c != "run"]))


def _stored_rows(rows: DataFrame) -> DataFrame:
    """Evaluation rows stored by image, missed boxes as a table without vectors, so that a reader of either kind reads no other."""
    found = materialize(rows.where(F.col("kind") == 0).drop("kind"), "eval-found", "image_id").withColumn("kind", F.lit(0))
    missed = materialize(rows.where(F.col("kind") == 1).drop("kind", "det_score", "scores"), "eval-missed", "image_id").withColumns(
        {"kind": F.lit(1), "det_score": F.lit(0.0), "scores": F.lit(None).cast("array<double>")}
    )
    return found.select(rows.columns).unionAll(missed.select(rows.columns))


def summarise_runs(
    rows: DataFrame, detections: DataFrame, ground_truth: DataFrame, classes: DataFrame, num_classes: int, key: str, values: Sequence,
    points: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """``(summary, per_class)`` of every run from its evaluation rows and the tables they were made of."""
    by = [key]
    dets = _numbered(detections, key, values)
    runs = runs_table(detections, key, values)
    ap = average_precision_of(rows, run_frame(runs, classes), num_classes, points, by)
    shared = key not in ground_truth.columns
    # a truth that all runs share is counted once, then given to each
    truth = ground_truth.groupBy("class_id").agg(F.count("*").alias("n")) if shared else _numbered(ground_truth, key, values).groupBy(key, "class_id").agg(F.count("*").alias("n"))
    truth = materialize(truth.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values]))) if shared else truth, "truth-counts")
    found = dets.groupBy(key, "class_id").agg(F.count("*").alias("n"))
    counts = run_frame(runs, classes).join(truth.withColumnRenamed("n", "ground_truth_count"), [key, "class_id"], "left").join(
        found.withColumnRenamed("n", "prediction_count"), [key, "class_id"], "left"
    )
    zero = F.lit(0).cast("bigint")
    counts = counts.select(key, "class_id", *[F.coalesce(F.col(c), zero).alias(c) for c in ("ground_truth_count", "prediction_count")])
    per_class = materialize(ap.join(counts, [key, "class_id"]), "per-class")
    row_counts = rows.groupBy(key).agg(F.count("*").alias("evaluation_rows"))
    boxes = truth.groupBy(key).agg(F.sum("n").alias("ground_truth"))
    predictions = found.groupBy(key).agg(F.sum("n").alias("predictions"))
    summary = (
        mean_average_precision(per_class, by).join(boxes, key, "left").join(predictions, key, "left").join(row_counts, key, "left")
        .withColumns({c: F.coalesce(F.col(c), zero) for c in ("ground_truth", "predictions", "evaluation_rows")})
    )
    return summary, per_class


def evaluate_runs(
    detections: DataFrame,
    ground_truth: DataFrame,
    classes: DataFrame,
    num_classes: int,
    key: str,
    values: Sequence,
    iou_threshold: float = 0.5,
    eval_type: str = "combined",
    points: int = 11,
    limit: int = LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """``(summary, per_class)`` of every run.

    ``detections`` carry ``key``; ``ground_truth`` carries it too, or is shared
    by all runs. Images may have keys of any type that can be ordered.
    """
    rows = run_rows(detections, ground_truth, num_classes, key, values, iou_threshold, eval_type, limit)
    return summarise_runs(rows, detections, ground_truth, classes, num_classes, key, values, points)


def evaluate_model(
    raw: DataFrame, ground_truth: DataFrame, classes: DataFrame, num_classes: int,
    score_threshold: float = 0.5, nms_threshold: float = 0.4, iou_threshold: float = 0.5, eval_type: str = "combined",
    limit: int = LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Suppress, match and score one model; the summary repeats the parameters."""
    kept = materialize(suppress(raw, nms_threshold, score_threshold, limit), "kept", "image_id").withColumn("model", F.lit("model"))
    summary, per_class = evaluate_runs(
        kept, ground_truth, classes, num_classes, "model", ["model"], iou_threshold, eval_type, limit=limit
    )
    settings = {
        "score_threshold": F.lit(float(score_threshold)), "nms_threshold": F.lit(float(nms_threshold)),
        "map_iou_threshold": F.lit(float(iou_threshold)), "eval_type": F.lit(eval_type),
    }
    return summary.drop("model").withColumns(settings), per_class.drop("model")


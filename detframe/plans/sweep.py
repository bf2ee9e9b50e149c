"""Threshold sweep: suppress once for all thresholds, evaluate them in one job, count duplicates, judge subsets of images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.functions.geometry import BOX
from detframe.operators.compare import change_from
from detframe.operators.match import run_mask
from detframe.operators.pairs import duplicate_pairs
from detframe.operators.suppress import SWEEP_THRESHOLDS, suppress_sweep
from detframe.plans.evaluation import evaluate_runs, run_rows, summarise_runs
from detframe.session import materialize

KEY = "nms_threshold"


def duplicate_counts(kept: DataFrame, key: str = KEY, iou_threshold: float = 0.5) -> DataFrame:
    """Stored: per run and image with predictions, its same-class pairs above the threshold.

    A box that several runs keep is one row with a bit set of its runs, so its pairs are found once.
    """
    values = [r[0] for r in kept.select(key).distinct().orderBy(key).collect()]  # one row for each run
    options = F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit(None).cast(kept.schema[key].dataType))
    numbered = kept.withColumn("run", (F.array_position(options, F.col(key)) - 1).cast("int"))
    pairs = duplicate_pairs(run_mask(numbered, ["image_id", "pos", "class_id", *BOX]), iou_threshold, mask="mask")
    bits = F.filter(F.sequence(F.lit(0), F.lit(max(0, len(values) - 1))), lambda r: F.getbit("mask", r) == 1)
    found = pairs.select("image_id", F.explode(bits).alias("run")).select("image_id", F.get(options, F.col("run")).alias(key))
    counted = found.groupBy(key, "image_id").agg(F.count("*").alias("n"))
    return materialize(
        kept.select(key, "image_id").distinct().join(counted, [key, "image_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))), "duplicates"
    )


def duplicates_of(counts: DataFrame, key: str = KEY) -> DataFrame:
    """Per run: pairs, images with pairs, pairs per image that has predictions, from :func:`duplicate_counts`."""
    return counts.groupBy(key).agg(
        F.sum("n").alias("duplicate_pairs"), F.count_if(F.col("n") > 0).alias("images_with_pairs"), (F.sum("n") / F.count("*")).alias("mean_pairs_per_image")
    )


def duplicate_summary(kept: DataFrame, key: str = KEY, iou_threshold: float = 0.5) -> DataFrame:
    """Per run: same-class pairs above the threshold, images with such pairs, pairs per image that has predictions."""
    return duplicates_of(duplicate_counts(kept, key, iou_threshold), key)


def threshold_sweep(
    raw: DataFrame, ground_truth: DataFrame, classes: DataFrame, num_classes: int, thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    score_threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, summary, per_class)``: stored survivors, one summary row per threshold with its duplicates, AP per class."""
    kept = materialize(suppress_sweep(raw, thresholds, score_threshold), "swept", "image_id")
    summary, per_class = evaluate_runs(kept, ground_truth, classes, num_classes, KEY, list(thresholds))
    return kept, summary.join(duplicate_summary(kept), KEY, "left"), per_class


def subset_summary(
    kept: DataFrame, ground_truth: DataFrame, classes: DataFrame, num_classes: int, images: DataFrame, subsets: dict[str, DataFrame],
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
) -> DataFrame:
    """The sweep's summary over all images (``all_selected``) and over each named subset of them (``image_id`` rows)."""
    values, out = list(thresholds), None
    rows = run_rows(kept, ground_truth, num_classes, KEY, values)
    pairs = duplicate_counts(kept)
    for name, chosen in {"all_selected": images, **subsets}.items():
        ids = materialize(chosen.select("image_id").distinct(), "subset", "image_id")
        own_rows, own_kept, own_truth, own_pairs = (x.join(ids, "image_id", "left_semi") for x in (rows, kept, ground_truth, pairs))
        summary, _ = summarise_runs(own_rows, own_kept, own_truth, classes, num_classes, KEY, values)
        part = summary.join(duplicates_of(own_pairs), KEY, "left").withColumns({"subset_name": F.lit(name), "images": ids.agg(F.count("*")).scalar()})
        out = part if out is None else out.unionByName(part)
    return out


def threshold_decision(summary: DataFrame, reference: float) -> DataFrame:
    """Thresholds from the reference on, with the change in mAP and predictions against it and their duplicates."""
    near = change_from(summary, KEY, reference).where(F.col(KEY) >= reference)
    return near.select(KEY, "map", "map_change", "predictions", "prediction_change", "duplicate_pairs", "images_with_pairs")

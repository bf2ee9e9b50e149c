"""Robustness under image conditions: suppress and evaluate each condition, then hold it against the original."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from detframe.functions.conditions import CONDITIONS
from detframe.operators.augment import ground_truth_by_condition
from detframe.operators.compare import ap_change_from, change_from
from detframe.operators.suppress import suppress_sweep
from detframe.plans.evaluation import evaluate_runs
from detframe.session import materialize


def suppress_by(raw: DataFrame, key: str, iou_threshold: float, score_threshold: float = 0.5) -> DataFrame:
    """Survivors where ``key`` (a condition) and image together make one picture."""
    return suppress_sweep(raw, [iou_threshold], score_threshold, by=key).drop("nms_threshold")


def condition_robustness(
    raw: DataFrame, normalised: DataFrame, images: DataFrame, classes: DataFrame, num_classes: int, nms_threshold: float = 0.5,
    conditions: Sequence = CONDITIONS, reference: str = "original", clip: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, change, ap_change)`` from raw detections with a ``condition`` column and normalised ground truth."""
    kept = materialize(suppress_by(raw, "condition", nms_threshold), "condition-kept", "image_id")
    truth = ground_truth_by_condition(normalised, images, conditions, clip).drop("condition_order")
    summary, per_class = evaluate_runs(kept, truth, classes, num_classes, "condition", [c[0] for c in conditions])
    return kept, change_from(summary, "condition", reference), ap_change_from(per_class, "condition", reference)

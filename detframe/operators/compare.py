"""Tables that set evaluations side by side: models, thresholds, conditions, subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class_counts(classes: DataFrame, detections: DataFrame, ground_truth: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Ground-truth boxes and predictions per class; ``by`` lists runs present in both inputs."""
    keys = [*(by.columns if by is not None else []), "class_id"]
    # Each run (a short parameter list) carries the class dimension as one array.
    frame = classes if by is None else _frame(by, classes)
    truth = ground_truth.groupBy(*keys).agg(F.count("*").alias("ground_truth_count"))
    found = detections.groupBy(*keys).agg(F.count("*").alias("prediction_count"))
    zero = F.lit(0).cast("bigint")
    return frame.join(truth, keys, "left").join(found, keys, "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("ground_truth_count", "prediction_count")}
    )


def _frame(by: DataFrame, classes: DataFrame) -> DataFrame:
    """Runs times classes: the class list becomes one array and is exploded per run."""
    listed = classes.agg(F.collect_list(F.struct(*classes.columns))).scalar()
    return by.withColumn("_c", F.explode(listed)).select(*by.columns, "_c.*")


def run_frame(by: DataFrame, classes: DataFrame) -> DataFrame:
    return _frame(by, classes)


def model_comparison(per_class: DataFrame, first: str, second: str) -> DataFrame:
    """AP of two models per class, difference and the better one, largest gain first."""
    wide = (
        per_class.groupBy("class_id", "class_name", "ground_truth_count")
        .pivot("model", [first, second]).agg(F.first("ap"))
        .withColumnsRenamed({first: f"{first}_ap", second: f"{second}_ap"})
    )
    diff = F.col(f"{second}_ap") - F.col(f"{first}_ap")
    better = F.when(diff > 0, second).when(diff < 0, first).otherwise("tie")
    return wide.withColumns({"ap_difference": diff, "better_model": better}).orderBy(F.desc("ap_difference"), "class_id")


def change_from(summary: DataFrame, key: str, reference) -> DataFrame:
    """mAP, percentage and prediction change of each run against a reference run."""
    at_ref = F.col(key) == F.lit(reference)
    base = summary.agg(F.struct(F.max(F.when(at_ref, F.col("map"))).alias("m"), F.max(F.when(at_ref, F.col("predictions"))).alias("p"))).scalar()
    rows = summary.withColumn("_ref", base)
    change = F.col("map") - F.col("_ref.m")
    percent = F.when(F.col("_ref.m") != 0, change / F.col("_ref.m") * 100).otherwise(0.0)
    return rows.withColumns({
        "map_change": change, "map_percent_change": percent,
        "prediction_change": F.col("predictions") - F.col("_ref.p"),
    }).drop("_ref")


def ap_change_from(per_class: DataFrame, key: str, reference) -> DataFrame:
    """AP change per class against a reference run."""
    base = per_class.where(F.col(key) == F.lit(reference)).select("class_id", F.col("ap").alias("reference_ap"))
    return per_class.join(base, "class_id", "left").withColumn("ap_change", F.col("ap") - F.col("reference_ap"))


def largest_drops(changes: DataFrame, key: str, reference, n: int = 15) -> DataFrame:
    return changes.where(F.col(key) != F.lit(reference)).orderBy("ap_change", key, "class_id").limit(n)


def threshold_sensitivity(per_class: DataFrame, reference: float, others: Sequence[float]) -> DataFrame:
    """Classes improved, unchanged and worsened at each threshold against the reference one."""
    changes = ap_change_from(per_class, "nms_threshold", float(reference))
    return changes.where(F.col("nms_threshold").isin([float(t) for t in others])).groupBy("nms_threshold").agg(
        F.count_if(F.col("ap_change") > 0).alias("improved"), F.count_if(F.col("ap_change") == 0).alias("unchanged"),
        F.count_if(F.col("ap_change") < 0).alias("worsened"),
    )

"""Per-image loss components, diagnostic counts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions.scores import class_score
from detframe.operators.pairs import LIMIT, best_ground_truth
from detframe.operators.ranking import column_quantiles, exact_quantiles

COMPONENTS = ("loc_loss", "conf_loss_obj", "conf_loss_noobj", "class_loss")
COUNTS = (
    "raw_prediction_count", "ground_truth_count", "matched_prediction_count",
    "false_positive_prediction_count", "matched_gt_count", "missed_gt_count",
)


def _square(c: Column) -> Column:
    return c * c


def loss_components(
    images: DataFrame, detections: DataFrame, ground_truth: DataFrame, iou_threshold: float = 0.5, limit: int = LIMIT
) -> DataFrame:
    """``images`` columns plus the four components and six counts.

    A matched prediction adds squared corner differences, ``(1-o)^2`` and
    ``(1-p)^2`` of the target class; any other adds ``o^2``. An image without
    predictions has zero loss even when it has ground truth.
    """
    best = best_ground_truth(detections, ground_truth, iou_threshold, limit)
    rows = detections.select("image_id", "pos", "x", "y", "w", "h", "score", "cs").join(best, ["image_id", "pos"], "left")
    matched = F.col("gt_pos").isNotNull()
    moved = (
        _square(F.col("x") - F.col("gt_x")) + _square(F.col("y") - F.col("gt_y"))
        + _square(F.col("x") + F.col("w") - F.col("gt_x") - F.col("gt_w"))
        + _square(F.col("y") + F.col("h") - F.col("gt_y") - F.col("gt_h"))
    )
    target = class_score(F.col("cs"), F.col("gt_class_id"))
    per_box = rows.select(
        "image_id", "gt_pos", matched.cast("bigint").alias("matched"),
        F.when(matched, moved).otherwise(0.0).alias("loc"),
        F.when(matched, _square(1 - F.col("score"))).otherwise(0.0).alias("obj"),
        F.when(matched, 0.0).otherwise(_square(F.col("score"))).alias("noobj"),
        F.when(matched, _square(1 - target)).otherwise(0.0).alias("cls"),
    )
    # Distinct matched boxes without a count-distinct expansion: group by box first.
    sums = [F.sum(c).alias(c) for c in ("loc", "obj", "noobj", "cls", "matched")]
    by_box = per_box.groupBy("image_id", "gt_pos").agg(F.count("*").alias("n"), *sums)
    by_image = by_box.groupBy("image_id").agg(
        F.sum("loc").alias("loc_loss"), F.sum("obj").alias("conf_loss_obj"), F.sum("noobj").alias("conf_loss_noobj"),
        F.sum("cls").alias("class_loss"), F.sum("n").alias("raw_prediction_count"),
        F.sum("matched").alias("matched_prediction_count"), F.count("gt_pos").alias("matched_gt_count"),
    )
    truth = ground_truth.groupBy("image_id").agg(F.count("*").alias("ground_truth_count"))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS}
    none = {
        c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        for c in ("raw_prediction_count", "ground_truth_count", "matched_prediction_count", "matched_gt_count")
    }
    return (
        images.join(by_image, "image_id", "left").join(truth, "image_id", "left").withColumns({**zero, **none})
        .withColumns({
            "false_positive_prediction_count": F.col("raw_prediction_count") - F.col("matched_prediction_count"),
            "missed_gt_count": F.col("ground_truth_count") - F.col("matched_gt_count"),
        })
        .select(*images.columns, *COMPONENTS, *COUNTS)
    )


def total_loss(
    components: DataFrame,
    lambda_coord: float = 0.5, lambda_obj: float = 0.5, lambda_noobj: float = 0.5, lambda_cls: float = 0.5,
) -> DataFrame:
    """Add ``total_loss``, the weighted sum of the components."""
    weights = (lambda_coord, lambda_obj, lambda_noobj, lambda_cls)
    total = None
    for weight, name in zip(weights, COMPONENTS):
        term = F.lit(float(weight)) * F.col(name)
        total = term if total is None else total + term
    return components.withColumn("total_loss", total)


def stacked(components: DataFrame, columns, *keep: str) -> DataFrame:
    """Long form ``component, value`` of the named columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in columns])
    return components.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.component", "e.value")


def describe_components(components: DataFrame, columns=(*COMPONENTS, *COUNTS)) -> DataFrame:
    """Count, mean, std, min, quartiles and max of each column, one row per column."""
    long = stacked(components, columns)
    basic = long.groupBy("component").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = column_quantiles(components, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "component")


def nonzero_components(components: DataFrame) -> DataFrame:
    return stacked(components, COMPONENTS).groupBy("component").agg(F.count_if(F.col("value") > 0).alias("nonzero"))


def component_scales(components: DataFrame, prob: float = 0.95) -> DataFrame:
    """Per component its ``prob`` quantile as ``scale`` (1 when not positive) and its mean."""
    long = stacked(components, COMPONENTS)
    high = column_quantiles(components, COMPONENTS, {"p": prob})
    means = long.groupBy("component").agg(F.avg("value").alias("mean"))
    scale = F.when(F.col("p") > 0, F.col("p")).otherwise(1.0)
    return high.join(means, "component").select("component", scale.alias("scale"), "mean")


def zero_prediction_profile(components: DataFrame) -> DataFrame:
    """One row: how many images have no prediction, and their ground-truth counts."""
    empty = components.where(F.col("raw_prediction_count") == 0).select(F.col("ground_truth_count").alias("n"))
    basic = empty.agg(F.count("*").alias("images"), F.avg("n").alias("mean_gt"), F.max("n").alias("max_gt"))
    middle = exact_quantiles(empty, [], "n", {"median_gt": 0.5})
    return basic.withColumn("median_gt", middle.scalar())


def false_negative_images(components: DataFrame, n: int) -> DataFrame:
    """The ``n`` images with most ground truth among those with ground truth and no prediction."""
    blind = components.where((F.col("raw_prediction_count") == 0) & (F.col("ground_truth_count") > 0))
    return blind.select("image_id", "ground_truth_count").orderBy(F.desc("ground_truth_count"), "image_id").limit(n)

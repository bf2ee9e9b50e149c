"""Whole analyses as one call: two or more models, a dataset, its overlaps, the weightings of hard examples.

Each stores what its parts read several times and returns the parts by name; a part that is not used costs nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.operators import loss, mining, profile
from detframe.operators.compare import model_comparison
from detframe.operators.pairs import LIMIT
from detframe.operators.suppress import suppress
from detframe.plans.evaluation import evaluate_runs
from detframe.session import materialize


class ModelReport(NamedTuple):
    summary: DataFrame
    per_class: DataFrame
    comparison: DataFrame


def compare_models(
    models: dict[str, DataFrame], ground_truth: DataFrame, classes: DataFrame, num_classes: int, score_threshold: float = 0.5,
    nms_threshold: float = 0.4, iou_threshold: float = 0.5, eval_type: str = "combined", limit: int = LIMIT,
) -> ModelReport:
    """Raw detections of several models suppressed, then evaluated in one job; the first two are set side by side."""
    if len(models) < 2:
        raise ValueError("a comparison needs two models")
    both = None
    for name, raw in models.items():
        kept = suppress(raw, nms_threshold, score_threshold, limit).withColumn("model", F.lit(name))
        both = kept if both is None else both.unionByName(kept)
    names = list(models)
    summary, per_class = evaluate_runs(
        materialize(both, "models", "image_id"), ground_truth, classes, num_classes, "model", names, iou_threshold, eval_type, limit=limit
    )
    return ModelReport(summary, per_class, model_comparison(per_class, *names[:2]))


class DatasetReport(NamedTuple):
    index: DataFrame
    summary: DataFrame
    classes: DataFrame
    object_counts: DataFrame
    density: DataFrame


def profile_dataset(images: DataFrame, ground_truth: DataFrame, classes: DataFrame) -> DatasetReport:
    """Index of the images, totals, class shares, counts of objects and of density buckets."""
    index = materialize(profile.dataset_index(images, ground_truth, classes), "index")
    return DatasetReport(
        index, profile.dataset_summary(index), profile.class_distribution(ground_truth, classes, images),
        profile.object_count_distribution(index), profile.density_distribution(index),
    )


class OverlapReport(NamedTuple):
    profile: DataFrame
    summary: DataFrame
    crowding: DataFrame


def profile_overlap(images: DataFrame, ground_truth: DataFrame, limit: int = LIMIT) -> OverlapReport:
    """Overlap of the boxes of each image, its summary and the crowding buckets."""
    stored = materialize(profile.overlap_profile(images.select("image_id"), ground_truth, limit=limit), "overlap")
    return OverlapReport(stored, profile.overlap_summary(stored), profile.crowding_distribution(stored))


class WeightingReport(NamedTuple):
    components: DataFrame
    scales: DataFrame
    top: DataFrame
    summary: DataFrame
    overlap: DataFrame
    density: DataFrame
    class_presence: DataFrame


def sweep_weightings(
    images: DataFrame, detections: DataFrame, ground_truth: DataFrame, classes: DataFrame, n: int = 250, digits: int | None = 6,
    iou_threshold: float = 0.5, limit: int = LIMIT,
) -> WeightingReport:
    """Loss components of each image, the ``n`` hardest images of every weighting, and what these have in common.

    ``digits`` rounds the stored components; None keeps them as they are.
    """
    index = profile.dataset_index(images, ground_truth, classes).drop("class_ids_present")
    table = loss.loss_components(index, detections, ground_truth, iou_threshold, limit)
    if digits is not None:
        table = table.withColumns({c: F.round(c, digits) for c in loss.COMPONENTS})
    table = materialize(table, "components")
    scales = materialize(loss.component_scales(table), "scales")
    top = materialize(mining.top_images(mining.scored_runs(table, scales), n), "top")
    return WeightingReport(
        table, scales, top, mining.run_summary(top), mining.run_overlap(top), mining.run_density(top), mining.run_class_presence(top)
    )


def image_lists(images: DataFrame, detections: DataFrame, ground_truth: DataFrame, chunk: int = LIMIT) -> DataFrame:
    """What a metric reads of an image, as lists in the order of ``pos``: ``image_id, chunk, detections, boxes``.

    Positions of ``chunk`` numbers make one row, so no image is gathered whole; every image has a row for chunk 0, with empty
    lists where it has nothing. Rows of images that are not listed are left out.
    """
    ids = images.select("image_id")
    by = ["image_id", "chunk"]

    def lists(rows: DataFrame, name: str) -> DataFrame:
        entry = F.struct("pos", *[c for c in rows.columns if c not in ("image_id", "pos")])
        part = rows.join(ids, "image_id", "left_semi").withColumn("chunk", F.floor(F.col("pos") / chunk))
        return part.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias(name))

    first = ids.withColumn("chunk", F.lit(0).cast("bigint"))
    out = first.join(lists(detections, "detections"), by, "full_outer").join(lists(ground_truth, "boxes"), by, "full_outer")
    return out.withColumns({n: F.coalesce(n, F.array().cast(out.schema[n].dataType)) for n in ("detections", "boxes")})

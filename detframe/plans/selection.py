"""Sample selection: three candidates of one size, each judged against the full set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.operators import profile, sampling
from detframe.session import materialize

CLASS_MEASURES = ("object_count", "image_count", "object_share_pct", "image_share_pct")


def candidates(index: DataFrame, ground_truth: DataFrame, targets: DataFrame, size: int, seed: int) -> dict[str, DataFrame]:
    """Stored samples ``random``, ``stratified`` (by density bucket) and ``rare_aware``."""
    stratified = materialize(sampling.stratified_sample(index, "density_bucket", size, seed), "sample")
    presence = profile.class_counts(ground_truth).select("image_id", "class_id")
    return {
        "random": materialize(sampling.random_sample(index, size, seed), "sample"),
        "stratified": stratified,
        "rare_aware": materialize(sampling.enforce_rare_targets(stratified, index, presence, targets, size, seed), "sample"),
    }


def quality_of(sample: DataFrame, index: DataFrame, ground_truth: DataFrame, classes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: how far the sample's class and density shares are from those of the full set."""
    full, part = (profile.class_distribution(ground_truth, classes, x) for x in (index.select("image_id"), sample.select("image_id")))
    by_class = materialize(profile.compare_shares(full, part, ["class_id", "class_name"], CLASS_MEASURES), "class-cmp")
    by_density = profile.compare_shares(
        profile.density_distribution(index), profile.density_distribution(sample), ["density_bucket"], ("image_count", "image_share_pct")
    )
    return sampling.sample_quality(by_class, by_density, sampling.rare_class_coverage(by_class, targets), sample)


def candidate_quality(
    index: DataFrame, ground_truth: DataFrame, classes: DataFrame, size: int, seed: int, rare_fraction: float = 0.5
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The candidates, and one quality row for each (``candidate``)."""
    targets = materialize(sampling.rare_class_targets(profile.class_distribution(ground_truth, classes), rare_fraction), "rare-targets")
    samples, judged = candidates(index, ground_truth, targets, size, seed), None
    for name, sample in samples.items():
        row = quality_of(sample, index, ground_truth, classes, targets).withColumn("candidate", F.lit(name))
        judged = row if judged is None else judged.unionByName(row)
    return samples, judged

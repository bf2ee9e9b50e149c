"""Dataset profile: index rows, class and density distributions, overlap and crowding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.functions.buckets import (
    CROWDING_BUCKETS, DENSITY_BUCKETS, bucket_table, crowding_bucket, density_bucket,
)
from detframe.functions.geometry import clamp_unit
from detframe.operators.pairs import LIMIT, weighted_pairs
from detframe.operators.ranking import exact_quantiles


def class_counts(ground_truth: DataFrame) -> DataFrame:
    """Objects per image and class, in long form: the primary count table."""
    return ground_truth.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))


def dataset_index(images: DataFrame, ground_truth: DataFrame, classes: DataFrame) -> DataFrame:
    """Per image: object count, bucket, sorted class ids and names present (at most one entry per class)."""
    counts = class_counts(ground_truth).join(classes, "class_id")
    present = counts.groupBy("image_id").agg(
        F.sum("n").alias("num_objects"),
        F.array_sort(F.collect_list(F.struct("class_id", "class_name"))).alias("present"),
    )
    empty = F.array()
    return (
        images.join(present, "image_id", "left")
        .withColumn("num_objects", F.coalesce("num_objects", F.lit(0).cast("bigint")))
        .withColumns({
            "class_ids_present": F.coalesce(F.col("present.class_id"), empty.cast("array<int>")),
            "class_names_present": F.coalesce(F.col("present.class_name"), empty.cast("array<string>")),
            "density_bucket": density_bucket(F.col("num_objects")),
        })
        .drop("present")
    )


def dataset_index_wide(images: DataFrame, ground_truth: DataFrame, columns: dict[int, str]) -> DataFrame:
    """One count column per class, for export; ``columns`` maps class id to column name."""
    counts = ground_truth.groupBy("image_id").agg(
        *[F.count_if(F.col("class_id") == i).alias(name) for i, name in columns.items()]
    )
    return images.join(counts, "image_id", "left").fillna(0, list(columns.values()))


def class_distribution(ground_truth: DataFrame, classes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Objects and images per class, all classes listed; ``images`` restricts to a subset.

    With ``images`` the shares of objects and images are added (0 for an empty set).
    """
    if images is not None:
        ground_truth = ground_truth.join(images.select("image_id"), "image_id", "left_semi")
    counts = class_counts(ground_truth).groupBy("class_id").agg(
        F.sum("n").alias("object_count"), F.count("*").alias("image_count")
    )
    zero = F.lit(0).cast("bigint")
    listed = classes.join(counts, "class_id", "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("object_count", "image_count")}
    )
    return listed if images is None else class_shares(listed, images)


def class_shares(distribution: DataFrame, images: DataFrame) -> DataFrame:
    """Add each class's share of objects and of images, in percent."""
    objects = distribution.agg(F.sum("object_count")).scalar()
    total = images.agg(F.count("*")).scalar()
    return distribution.withColumns({"_objects": objects, "_images": total}).withColumns({
        "object_share_pct": F.when(F.col("_objects") > 0, 100 * F.col("object_count") / F.col("_objects")).otherwise(0.0),
        "image_share_pct": F.when(F.col("_images") > 0, 100 * F.col("image_count") / F.col("_images")).otherwise(0.0),
    }).drop("_objects", "_images")


def object_count_distribution(index: DataFrame) -> DataFrame:
    return index.groupBy("num_objects").agg(F.count("*").alias("image_count"))


def dataset_summary(index: DataFrame) -> DataFrame:
    """One row of image and object totals."""
    n = F.col("num_objects")
    at_least = [F.count_if(n >= k).alias(f"images_ge_{k}_objects") for k in (5, 10, 15, 20)]
    basic = index.agg(
        F.count("*").alias("images"), F.sum(n).alias("total_objects"),
        F.count_if(n == 0).alias("images_with_zero_objects"), F.avg(n).alias("mean_objects_per_image"),
        F.max(n).alias("max_objects_per_image"), *at_least,
    )
    middle = exact_quantiles(index, [], "num_objects", {"median_objects_per_image": 0.5})
    return basic.withColumn("median_objects_per_image", middle.scalar())


def bucket_distribution(rows: DataFrame, bucket: str, buckets, by: DataFrame | None = None) -> DataFrame:
    """Images and share per bucket in fixed order, empty buckets kept.

    ``by`` is a small table of groups (a config, a subset): every group then
    lists every bucket and shares are within the group.
    """
    keys = by.columns if by is not None else []
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("image_count"))
    options = F.array(*[F.struct(F.lit(b).alias(bucket), F.lit(i).alias("bucket_order")) for i, (b, _) in enumerate(buckets)])
    if by is None:
        frame = bucket_table(rows.sparkSession, bucket, buckets)
    else:
        frame = by.select("*", F.explode(options).alias("o")).select(*keys, "o.*")
    zero = F.lit(0).cast("bigint")
    filled = frame.join(counts, [*keys, bucket], "left").withColumn("image_count", F.coalesce("image_count", zero))
    if by is None:
        total = filled.withColumn("_total", rows.agg(F.count("*")).scalar())
    else:
        total = filled.join(filled.groupBy(*keys).agg(F.sum("image_count").alias("_total")), keys)
    share = F.when(F.col("_total") > 0, 100 * F.col("image_count") / F.col("_total")).otherwise(0.0)
    return total.withColumn("image_share_pct", share).drop("_total")


def density_distribution(index: DataFrame) -> DataFrame:
    return bucket_distribution(index, "density_bucket", DENSITY_BUCKETS)


def dense_image_counts(index: DataFrame, thresholds: Sequence[int] = (5, 10, 15, 20)) -> DataFrame:
    """Images holding at least each number of objects, with their share: one aggregate, then one row per threshold."""
    counts = index.agg(F.count("*").alias("total"), *[F.count_if(F.col("num_objects") >= t).alias(f"n{t}") for t in thresholds])
    entries = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("image_count")) for t in thresholds])
    share = F.when(F.col("total") > 0, 100 * F.col("e.image_count") / F.col("total")).otherwise(0.0)
    return counts.select("total", F.explode(entries).alias("e")).select("e.*", share.alias("image_share_pct"))


def extreme_classes(distribution: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    """The n most (or least) frequent classes by object count, ties by class id."""
    order = F.col("object_count").desc() if largest else F.col("object_count").asc()
    return distribution.orderBy(order, "class_id").limit(n)


# ---- overlap ----------------------------------------------------------------

def overlap_profile(images: DataFrame, ground_truth: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per image: box pairs, largest and mean IoU, pairs above 0.1, 0.3 and 0.5, crowding bucket.

    Pair counts follow from box counts; only touching pairs are joined, the
    others contribute IoU 0.
    """
    iou, pairs = clamp_unit(F.col("iou")), F.col("pairs")
    touched = weighted_pairs(ground_truth, limit).groupBy("image_id").agg(
        F.max(iou).alias("max_pairwise_iou"), F.sum(iou * pairs).alias("_sum"),
        *[F.sum(F.when(iou > F.lit(t), pairs).otherwise(0)).alias(f"pairs_iou_gt_0_{d}") for d, t in ((1, 0.1), (3, 0.3), (5, 0.5))],
    )
    sizes = ground_truth.groupBy("image_id").agg(F.count("*").alias("num_objects"))
    whole, real = F.lit(0).cast("bigint"), F.lit(0.0)
    n = F.col("num_objects")
    counts = [f"pairs_iou_gt_0_{d}" for d in (1, 3, 5)]
    return (
        images.join(sizes, "image_id", "left").join(touched, "image_id", "left")
        .withColumn("num_objects", F.coalesce(n, whole))
        .withColumn("pair_count", (n * (n - 1) / 2).cast("bigint"))
        .withColumns({c: F.coalesce(F.col(c), whole) for c in counts})
        .withColumns({
            "max_pairwise_iou": F.coalesce("max_pairwise_iou", real),
            "mean_pairwise_iou": F.when(F.col("pair_count") > 0, F.coalesce("_sum", real) / F.col("pair_count")).otherwise(0.0),
            "crowding_bucket": crowding_bucket(F.col("pairs_iou_gt_0_1")),
        })
        .select(*images.columns, "num_objects", "pair_count", "max_pairwise_iou", "mean_pairwise_iou", *counts, "crowding_bucket")
    )


def overlap_summary(profile: DataFrame) -> DataFrame:
    above = [F.count_if(F.col(f"pairs_iou_gt_0_{d}") > 0).alias(f"images_with_any_iou_gt_0_{d}") for d in (1, 3, 5)]
    return profile.agg(
        F.count("*").alias("images"), F.avg("pair_count").alias("mean_pair_count"),
        F.avg("max_pairwise_iou").alias("mean_max_pairwise_iou"), F.avg("pairs_iou_gt_0_1").alias("mean_pairs_iou_gt_0_1"),
        *above, F.count_if(F.col("pairs_iou_gt_0_1") >= 20).alias("images_with_20plus_iou_gt_0_1_pairs"),
    )


def crowding_distribution(profile: DataFrame) -> DataFrame:
    return bucket_distribution(profile, "crowding_bucket", CROWDING_BUCKETS)


def crowded_images(profile: DataFrame) -> DataFrame:
    """Images with at least one pair of boxes above IoU 0.1."""
    return profile.where(F.col("pairs_iou_gt_0_1") > 0).select("image_id")


def compare_shares(full: DataFrame, sample: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Full and sample distributions side by side, with ``<share>_diff_pp`` for every percentage."""
    left = full.select(*keys, *[F.col(m).alias(f"{m}_full") for m in measures])
    right = sample.select(*keys, *[F.col(m).alias(f"{m}_sample") for m in measures])
    shares = [m for m in measures if m.endswith("_pct")]
    diffs = {f"{m[:-4]}_diff_pp": F.col(f"{m}_sample") - F.col(f"{m}_full") for m in shares}
    return left.join(right, list(keys)).withColumns(diffs)

"""Exact-size, repeatable samples: random, stratified, and rare-class aware.

Rows are drawn in a seeded hash order of ``image_id``, so every sample has its
exact size, can be repeated on any engine, and needs no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detframe.operators.ranking import seeded_hash, take_by_hash
from detframe.session import materialize


def random_sample(index: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, all equally likely."""
    return take_by_hash(index, [], "image_id", seed, F.lit(n))


def stratified_targets(index: DataFrame, stratum: str, n: int) -> DataFrame:
    """Rows to draw per stratum: the floor of its share, the rest by largest remainder, ties by name.

    Strata are few (six density buckets), so the ranking runs on the counts.
    """
    counts = index.groupBy(stratum).agg(F.count("*").alias("available"))
    every = Window.partitionBy(F.lit(0))
    raw = F.col("available") / F.sum("available").over(every) * n
    shares = counts.withColumn("raw_target", raw).withColumn("base", F.floor("raw_target"))
    left = F.lit(n) - F.sum("base").over(every)
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("raw_target") - F.col("base")).desc(), stratum)
    extra = (F.row_number().over(order) <= left).cast("bigint")
    return shares.withColumn("target", F.least("available", F.col("base") + extra)).select(stratum, "available", "target")


def stratified_sample(index: DataFrame, stratum: str, n: int, seed: int) -> DataFrame:
    """n rows spread over the strata in proportion; a shortfall is filled from the rest."""
    targets = stratified_targets(index, stratum, n).select(stratum, "target")
    drawn = take_by_hash(index.join(targets, stratum), [stratum], "image_id", seed, F.col("target")).drop("target")
    picked = materialize(drawn.select(*index.columns), "stratified")
    rest = index.join(picked.select("image_id"), "image_id", "left_anti")
    short = F.lit(n) - picked.agg(F.count("*")).scalar()
    fill = take_by_hash(rest.withColumn("_short", short), [], "image_id", seed + 1, F.col("_short"))
    return picked.unionAll(fill.select(*index.columns))


def rare_class_targets(distribution: DataFrame, fraction: float, n: int = 8, floor: int = 100) -> DataFrame:
    """The n rarest classes by object count with the images to keep of each."""
    images = F.col("image_count")
    target = F.least(images, F.greatest(F.ceil(images * F.lit(float(fraction))), F.least(F.lit(floor), images)))
    return (
        distribution.orderBy("object_count", "class_id").limit(n).withColumn("target_image_count", target.cast("bigint"))
    )


def enforce_rare_targets(
    base: DataFrame, index: DataFrame, presence: DataFrame, targets: DataFrame, size: int, seed: int
) -> DataFrame:
    """A sample of exactly ``size`` images that meets the rare-class targets where images allow.

    ``presence`` is ``(image_id, class_id)``. Classes are handled one after
    another, rarest first, because each sees the images added before it; the
    target list is a report of at most eight rows. Excess leaves images without
    rare objects first; a shortfall is filled from the rest.
    """
    wanted = targets.orderBy("object_count", "class_id").select("class_id", "target_image_count").collect()
    sample = materialize(base.select("image_id"), "rare")
    for step, row in enumerate(wanted):
        having = presence.where(F.col("class_id") == row["class_id"]).select("image_id")
        current = sample.join(having, "image_id", "left_semi").agg(F.count("*")).scalar()
        outside = having.join(sample, "image_id", "left_anti")
        needed = F.lit(row["target_image_count"]) - current
        added = take_by_hash(outside.withColumn("_need", needed), [], "image_id", seed + step, F.col("_need"))
        sample = materialize(sample.unionAll(added.select("image_id")), "rare")
    rare = presence.where(F.col("class_id").isin([r["class_id"] for r in wanted])).select("image_id").distinct()
    protected = sample.join(rare.withColumn("rare", F.lit(1)), "image_id", "left").withColumn(
        "rare", F.coalesce("rare", F.lit(0))
    )
    total = F.lit(size)
    # How many of each kind stay: rare images first, others as far as room is left.
    sizes = protected.groupBy("rare").agg(F.count("*").alias("n"))
    keep_rare = F.least(total, F.coalesce(sizes.where("rare = 1").select("n").scalar(), F.lit(0)))
    quota = F.when(F.col("rare") == 1, keep_rare).otherwise(total - keep_rare)
    trimmed = take_by_hash(protected.withColumn("_quota", quota), ["rare"], "image_id", seed, F.col("_quota"))
    kept = materialize(trimmed.select("image_id"), "rare")
    rest = index.select("image_id").join(kept, "image_id", "left_anti")
    short = total - kept.agg(F.count("*")).scalar()
    fill = take_by_hash(rest.withColumn("_short", short), [], "image_id", seed, F.col("_short"))
    chosen = materialize(kept.unionAll(fill.select("image_id")), "rare")
    found, unique = chosen.agg(F.count("*"), F.count_distinct("image_id")).first()
    if found != size or unique != size:
        raise ValueError(f"expected {size} distinct images, got {found} rows and {unique} images")
    return index.join(chosen, "image_id", "left_semi")


def unselected(index: DataFrame, sample: DataFrame) -> DataFrame:
    return index.join(sample.select("image_id"), "image_id", "left_anti")


def deduplicate(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in ``order``; a partial aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = F.min(F.struct(order, *[c for c in rest if c != order])).alias("best")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in rest])


def rare_class_coverage(comparison: DataFrame, targets: DataFrame) -> DataFrame:
    """Per rare class: images in the full set and the sample, target, and retention in percent."""
    kept = F.when(F.col("image_count_full") > 0, 100 * F.col("image_count_sample") / F.col("image_count_full"))
    return (
        comparison.join(targets.select("class_id", "target_image_count"), "class_id")
        .withColumn("sample_image_retention_pct", kept)
    )


def sample_quality(class_cmp: DataFrame, density_cmp: DataFrame, coverage: DataFrame, sample: DataFrame) -> DataFrame:
    """One row judging a sample against the full set."""
    n = F.col("num_objects")
    base = sample.agg(
        F.count("*").alias("images"), F.sum(n).alias("total_objects"), F.avg(n).alias("mean_objects_per_image"),
        F.count_if(n >= 10).alias("images_ge_10_objects"), F.count_if(n >= 20).alias("images_ge_20_objects"),
    )
    off, bucket_off = F.abs("object_share_diff_pp"), F.abs("image_share_diff_pp")
    return base.withColumns({
        "class_object_share_mae_pp": class_cmp.agg(F.avg(off)).scalar(),
        "class_object_share_max_error_pp": class_cmp.agg(F.max(off)).scalar(),
        "density_share_mae_pp": density_cmp.agg(F.avg(bucket_off)).scalar(),
        "density_share_max_error_pp": density_cmp.agg(F.max(bucket_off)).scalar(),
        "min_rare_class_image_retention_pct": coverage.agg(F.min("sample_image_retention_pct")).scalar(),
    })

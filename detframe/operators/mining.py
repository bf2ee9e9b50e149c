"""Hard-example ranking: weighted scores over a fixed set of weightings, top lists and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detframe.functions.buckets import DENSITY_BUCKETS
from detframe.operators.loss import COMPONENTS, component_scales, stacked
from detframe.operators.profile import bucket_distribution
from detframe.session import materialize

# The nine weightings of the sweep
# (name, display name, coord, obj, noobj, cls, family).
CONFIGS = [
    ("balanced_default", "Balanced", 0.5, 0.5, 0.5, 0.5, "main"),
    ("localization_heavy", "Localization-heavy", 2.0, 0.5, 0.5, 0.5, "main"),
    ("objectness_heavy", "Objectness-heavy", 0.5, 2.0, 0.5, 0.5, "main"),
    ("no_object_heavy", "No-object-heavy", 0.5, 0.5, 2.0, 0.5, "main"),
    ("classification_heavy", "Classification-heavy", 0.5, 0.5, 0.5, 2.0, "main"),
    ("localization_only", "Localization-only", 1.0, 0.0, 0.0, 0.0, "component_only"),
    ("objectness_only", "Objectness-only", 0.0, 1.0, 0.0, 0.0, "component_only"),
    ("no_object_only", "No-object-only", 0.0, 0.0, 1.0, 0.0, "component_only"),
    ("classification_only", "Classification-only", 0.0, 0.0, 0.0, 1.0, "component_only"),
]
CONFIG_FIELDS = (
    "config_name", "display_name", "lambda_coord", "lambda_obj", "lambda_noobj", "lambda_cls", "family", "config_order",
)
LAMBDAS = ("lambda_coord", "lambda_obj", "lambda_noobj", "lambda_cls")
MODES = ("raw", "normalized")
# Labels of the dominant component, in the order ties are decided.
DOMINANT = ("Localization", "Objectness", "No-object", "Classification")
CONTRIBUTIONS = ("contrib_loc", "contrib_obj", "contrib_noobj", "contrib_cls")
RUN = ("score_mode", "config_name")


def config_array(modes=MODES) -> Column:
    """All (mode, weighting) runs as one array literal; exploding it is bounded by its 18 entries."""
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown score mode: {sorted(unknown)}")
    runs = []
    for mode in modes:
        for order, config in enumerate(CONFIGS):
            named = zip(CONFIG_FIELDS, (*config, order))
            runs.append(F.struct(F.lit(mode).alias("score_mode"), *[F.lit(v).alias(k) for k, v in named]))
    return F.array(*runs)


def run_table(spark: SparkSession, modes=MODES) -> DataFrame:
    """The runs as rows, for filling in runs that have no images."""
    return spark.range(1).select(F.explode(config_array(modes)).alias("c")).select("c.*")


def scored_runs(components: DataFrame, scales: DataFrame | None = None, modes=MODES) -> DataFrame:
    """Every image under every run: score, contributions and dominant component.

    ``normalized`` divides each component by its scale (:func:`component_scales`).
    """
    scales = component_scales(components) if scales is None else scales
    pick = scales.agg(*[F.max(F.when(F.col("component") == c, F.col("scale"))).alias(c) for c in COMPONENTS])
    scale_row = pick.select(F.struct(*COMPONENTS)).scalar()
    rows = components.withColumn("_scales", scale_row).withColumn("_run", F.explode(config_array(modes)))
    rows = rows.select(*components.columns, "_scales", "_run.*")
    parts = {}
    for lam, comp, name in zip(LAMBDAS, COMPONENTS, CONTRIBUTIONS):
        base = F.when(F.col("score_mode") == "raw", F.col(comp)).otherwise(F.col(comp) / F.col(f"_scales.{comp}"))
        parts[name] = F.col(lam) * base
    loc, obj, noobj, cls = [F.col(c) for c in CONTRIBUTIONS]
    first = (
        F.when((loc >= obj) & (loc >= noobj) & (loc >= cls), DOMINANT[0])
        .when((obj >= noobj) & (obj >= cls), DOMINANT[1])
        .when(noobj >= cls, DOMINANT[2]).otherwise(DOMINANT[3])
    )
    return rows.withColumns(parts).withColumns(
        {"hnm_score": loc + obj + noobj + cls, "dominant_contribution": first}
    ).drop("_scales")


#: Shares of a run, each half of the one before, whose least scores are tried as bounds of its top list.
SHARES = [2.0**-k for k in range(1, 14)]


def contenders(scored: DataFrame, n: int) -> DataFrame:
    """The rows of every run that can be among its ``n`` best-scored: all down to a bound that at least ``n`` rows reach.

    Sketches propose bounds, exact counts pick the highest that holds, so nothing is sorted for it. Some ``n`` to 2n rows are left,
    or about one of 8,192 where that is more, besides those that tie with the bound; a run without a bound keeps all its rows.
    ``scored`` is read three times: store what it is made of.
    """
    proposed = scored.groupBy(*RUN).agg(F.percentile_approx("hnm_score", [1 - s for s in SHARES], 10_000).alias("bounds"))
    tried = scored.select(*RUN, "hnm_score").join(materialize(proposed, "score-bounds"), [*RUN])
    reached = tried.groupBy(*RUN).agg(
        F.max("bounds").alias("bounds"),
        *[F.count_if(F.col("hnm_score") >= F.get("bounds", F.lit(k))).alias(f"reach_{k}") for k in range(len(SHARES))],
    )
    holds = [F.when(F.col(f"reach_{k}") >= n, F.get("bounds", F.lit(k))) for k in range(len(SHARES))]
    bound = materialize(reached.select(*RUN, F.greatest(*holds).alias("_bound")), "score-bound")
    above = F.col("_bound").isNull() | (F.col("hnm_score") >= F.col("_bound"))
    return scored.join(bound, [*RUN]).where(above).select(scored.columns)


def top_images(scored: DataFrame, n: int = 250) -> DataFrame:
    """The n best-scored images of every run with their rank, ties by file name.

    Only :func:`contenders` are ranked; Spark limits each partition to n rows per run before the shuffle.
    """
    order = Window.partitionBy(*RUN).orderBy(F.col("hnm_score").desc(), "image_file")
    return contenders(scored, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def run_summary(top: DataFrame) -> DataFrame:
    """Means, medians and shares per run over its top images (n rows per run at most)."""
    empty = F.col("raw_prediction_count") == 0
    means = ("num_objects", "raw_prediction_count", "matched_prediction_count",
             "false_positive_prediction_count", "missed_gt_count", *COMPONENTS)
    return top.groupBy(*RUN, "display_name", "family", *LAMBDAS).agg(
        F.count("*").alias("top_n"), F.avg("hnm_score").alias("mean_hnm_score"),
        F.median("hnm_score").alias("median_hnm_score"), F.median("num_objects").cast("double").alias("median_num_objects"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        F.count_if(empty).alias("zero_prediction_images"),
        F.avg(empty.cast("int")).alias("share_zero_prediction_images"),
        *[F.avg((F.col("dominant_contribution") == d).cast("int")).alias(f"dominant_{d}_share") for d in DOMINANT],
    )


def run_overlap(top: DataFrame) -> DataFrame:
    """Shared images and Jaccard index of every ordered pair of runs in a mode, itself included.

    Runs are joined through the image they share; pairs sharing nothing come
    from the run list (at most nine per mode).
    """
    sizes = top.groupBy(*RUN).agg(F.count("*").alias("n"))
    own = top.select("image_id", *RUN)
    shared = (
        own.withColumnRenamed("config_name", "config_a")
        .join(own.withColumnRenamed("config_name", "config_b"), ["image_id", "score_mode"])
        .groupBy("score_mode", "config_a", "config_b").agg(F.count("*").alias("intersection_count"))
    )
    a = sizes.withColumnsRenamed({"config_name": "config_a", "n": "n_a"})
    b = sizes.withColumnsRenamed({"config_name": "config_b", "n": "n_b"})
    both = F.col("intersection_count")
    return (
        a.join(b, "score_mode").join(shared, ["score_mode", "config_a", "config_b"], "left")
        .withColumn("intersection_count", F.coalesce(both, F.lit(0).cast("bigint")))
        .select("score_mode", "config_a", "config_b", "intersection_count",
                (both / (F.col("n_a") + F.col("n_b") - both)).alias("jaccard_overlap"))
    )


def run_density(top: DataFrame) -> DataFrame:
    """Images per run and density bucket, empty buckets kept."""
    runs = top.select(*RUN, "display_name").distinct()
    filled = bucket_distribution(top, "density_bucket", DENSITY_BUCKETS, runs)
    return filled.withColumn("image_share", F.col("image_share_pct") / 100).drop("image_share_pct")


def run_class_presence(top: DataFrame) -> DataFrame:
    """Share of a run's images that show each class; absent classes are left out."""
    sizes = top.groupBy(*RUN).agg(F.count("*").alias("n"))
    named = top.select(*RUN, "display_name", F.explode("class_names_present").alias("class_name"))
    counts = named.groupBy(*RUN, "display_name", "class_name").agg(F.count("*").alias("image_count"))
    return counts.join(sizes, [*RUN]).withColumn("image_share", F.col("image_count") / F.col("n")).drop("n")


MAIN = [c[0] for c in CONFIGS if c[-1] == "main"]


def class_presence_matrix(presence: DataFrame, mode: str = "normalized", n: int = 10) -> DataFrame:
    """Ten most present classes (rows) by main run (columns)."""
    sub = presence.where((F.col("score_mode") == mode) & F.col("config_name").isin(MAIN))
    top = sub.groupBy("class_name").agg(F.sum("image_count").alias("total")).orderBy(F.desc("total"), "class_name").limit(n)
    return (
        sub.join(top.select("class_name"), "class_name", "left_semi")
        .groupBy("class_name").pivot("config_name", MAIN).agg(F.first("image_share")).fillna(0.0, MAIN)
    )


def overlap_matrix(overlap: DataFrame, mode: str = "normalized") -> DataFrame:
    sub = overlap.where((F.col("score_mode") == mode) & F.col("config_a").isin(MAIN) & F.col("config_b").isin(MAIN))
    return sub.groupBy("config_a").pivot("config_b", MAIN).agg(F.first("jaccard_overlap"))


def density_matrix(density: DataFrame, mode: str = "normalized") -> DataFrame:
    labels = [label for label, _ in DENSITY_BUCKETS]
    sub = density.where((F.col("score_mode") == mode) & F.col("config_name").isin(MAIN))
    return sub.groupBy("config_name").pivot("density_bucket", labels).agg(F.first("image_share"))


def hard_negatives(table: DataFrame, n: int, criterion: str) -> DataFrame:
    """The n rows with the largest ``criterion``; ties by image."""
    if criterion not in table.columns:
        raise KeyError(f"no column {criterion!r} in the table")
    return table.orderBy(F.col(criterion).desc(), "image_id").limit(max(n, 0))


def top_by_component(components: DataFrame, columns=(*COMPONENTS, "missed_gt_count"), n: int = 10) -> DataFrame:
    """The n images with the largest value of each column."""
    long = stacked(components, columns, "image_id")
    order = Window.partitionBy("component").orderBy(F.col("value").desc(), "image_id")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)



"""Precision/recall curves and interpolated average precision.

Every evaluation row is a point on every class's curve; equal scores are not
merged. Counts per class and score bucket come first, so twenty classes do not
mean twenty tasks, and a large group of equal scores (the zero rows of missed
boxes) is spread by the tie order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from detframe.operators.curvebuckets import (
    POSITIVE, SLOTS, TIE_BUCKETS, TIE_MARKS, ZERO, count_buckets, count_zeros, missed_in, points_in, zero_points, zero_rows,
)
from detframe.operators.ranking import running_totals
from detframe.session import materialize


# Later evaluation rows come first among equal scores.
def evaluation_order() -> list[Column]:
    return [F.col("image_id").desc(), F.col("kind").desc(), F.col("det_score").asc(), F.col("pos").desc()]


# Nonzero points that a task makes, and that a partition orders.
SPREAD = 1 << 22
ORDERED = 1 << 18


def _stored(rows: DataFrame, by, keep) -> tuple[DataFrame, DataFrame]:
    """Detections and missed boxes as tables of their own, the latter without vectors."""
    found = rows.where(F.col("kind") == 0).select(*by, *keep, "y_true", "scores")
    missed = rows.where(F.col("kind") == 1).select(*by, *keep, "y_true")
    return materialize(found, "eval-found"), materialize(missed, "eval-missed").withColumn("scores", F.lit(None).cast("array<double>"))


def _zero_points(rows: DataFrame, num_classes: int, by, keep, before: DataFrame, parts: int) -> DataFrame:
    """Curve points of score zero with ``_rank, _tp``, where ``before`` (``n, t`` per class) come first.

    Their order is the same for all classes, so rows are ordered, not points: over slices, each counted from the ones before it.
    """
    order = evaluation_order()
    zeros = zero_rows(rows, num_classes, by, keep).repartitionByRange(parts, *[F.col(c) for c in by], *order)
    zeros = materialize(zeros.withColumn("_slice", F.spark_partition_id()), "zero-rows")
    upto = Window.partitionBy(*by, "class_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    inner = count_zeros(zeros, num_classes, [*by, "_slice"])
    earlier = materialize(
        inner.select(*by, "_slice", "class_id", *[(F.sum(c).over(upto) - F.col(c)).alias(f"_{c}_inner") for c in ("n", "t")])
        .join(before, [*by, "class_id"])
        .select(*by, "_slice", "class_id", (F.col("_n_inner") + F.col("n")).alias("_n"), (F.col("_t_inner") + F.col("t")).alias("_t")),
        "zero-offsets",
    )
    sliced = zeros.repartition(parts, *by, "_slice").sortWithinPartitions(*by, "_slice", *order)
    placed = zero_points(sliced, num_classes, [*by, "_slice"], keep).join(earlier, [*by, "_slice", "class_id"])
    return placed.select(
        *by, *keep, "class_id", F.lit(0.0).alias("score"), "hit",
        (F.col("_n") + F.col("_rank")).alias("_rank"), (F.col("_t") + F.col("_tp")).alias("_tp"),
    )


def pr_curve(rows: DataFrame, num_classes: int, by=(), bucket: int = 1 << 20) -> DataFrame:
    """Curve of every class from evaluation rows, which are stored once.

    Points are counted per class and score bucket first, so what comes before a bucket is known and each bucket is ordered by
    itself, its points shuffled once; one of more than ``bucket`` points goes over slices. Points of score zero, those of all
    missed boxes among them, are ordered as rows and become points where they are counted.
    """
    by, groups = list(by), [*by, "class_id"]
    keep = [c for c in rows.columns if c not in (*by, "y_true", "scores")]
    found, missed = _stored(rows, by, keep)
    held = found.unionByName(missed)
    numeric = isinstance(held.schema["image_id"].dataType, NumericType)
    bounds, low, high = _bounds(held, numeric)
    tie = _tie_bucket(numeric)
    histogram = materialize(count_buckets(held.withColumn("_b", bounds), num_classes, tie, low, high, by), "curve-buckets")
    upto = Window.partitionBy(*groups).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    spans = materialize(
        histogram.withColumns({"_n": F.sum("n").over(upto) - F.col("n"), "_t": F.sum("t").over(upto) - F.col("t")}), "curve-spans"
    )
    positive = F.col("slot") >= POSITIVE
    totals = histogram.groupBy(*groups).agg(
        *[F.coalesce(F.sum(F.when(positive, F.col(c))), F.lit(0)).alias(c) for c in ("n", "t")], F.sum("t").alias("positives")
    )
    totals = materialize(totals, "curve-totals")
    zero = F.col("slot").between(ZERO, POSITIVE - 1)
    sizes = histogram.agg(F.sum(F.when(~zero, F.col("n"))), F.sum(F.when(zero, F.col("n")))).first()
    scored, tied = [int(n or 0) for n in sizes]
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = scored // SPREAD + 1
    if tasks > found.rdd.getNumPartitions():  # rows are dealt before they become points, so that no task makes too many
        found = found.repartition(tasks, "image_id", "pos")

    tagged, code = found.withColumn("_b", bounds), (F.col("class_id") * SLOTS + F.col("slot")).cast("int")
    # all have the same kind, and class and slot are one number, so that little is shuffled for a point
    own = [c for c in keep if c != "kind"]
    order = [F.col("score").desc(), F.col("image_id").desc(), F.col("det_score").asc(), F.col("pos").desc()]
    counts = {"_rank": F.lit(1).cast("bigint"), "_tp": F.col("hit").cast("bigint")}

    def points(part: DataFrame) -> DataFrame:
        made = points_in(tagged, num_classes, tie, low, high, _codes(part, code, by), by, own)
        return made.select(*by, *own, code.alias("_bucket"), "score", F.col("hit").cast("boolean").cast("int").alias("hit"))

    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = points(histogram.where(~zero & (F.col("n") <= bucket))).repartition(max(least, scored // ORDERED + 1), *by, "_bucket")
    running = dealt.withColumns({name: F.sum(value).over(inside) for name, value in counts.items()})
    large = histogram.where(~zero & (F.col("n") > bucket))
    if not large.isEmpty():
        running = running.unionByName(running_totals(points(large), [*by, "_bucket"], order, counts, "curve"))
    columns = [*by, *keep, "class_id", "score", "hit", "_rank", "_tp"]
    placed = running.join(spans.select(*by, code.alias("_bucket"), "class_id", "_n", "_t"), [*by, "_bucket"]).withColumns({
        "_rank": F.col("_n") + F.col("_rank"), "_tp": F.col("_t") + F.col("_tp"), "hit": F.col("hit").cast("bigint"),
        "kind": F.lit(0).cast(rows.schema["kind"].dataType),
    }).select(columns)
    if tied:
        zeros = _zero_points(held, num_classes, by, keep, totals.select(*groups, "n", "t"), max(least, tied // num_classes // ORDERED + 1))
        placed = placed.unionAll(zeros.select(columns))
    rank, tp, positives = F.col("rank"), F.col("tp"), F.col("positives")
    known = placed.withColumnsRenamed({"_rank": "rank", "_tp": "tp"}).join(totals.select(*groups, "positives"), groups)
    return known.withColumns(
        {"precision": tp / rank, "recall": F.when(positives > 0, tp / positives).otherwise(0.0), "threshold": F.col("score")}
    )


def _grid(index: Column, points: int) -> Column:
    """Recall level ``index`` of an evenly spaced grid from 0 to 1; the last one is exactly 1."""
    if points == 1:
        return F.lit(0.0)
    step = 1.0 / (points - 1)
    return F.when(index >= points - 1, F.lit(1.0)).otherwise(index * F.lit(step))


def _level(recall: Column, points: int) -> Column:
    """Highest grid level a recall reaches."""
    guess = F.floor(recall * (points - 1)).cast("int")
    return (
        F.when((guess + 1 < points) & (_grid(guess + 1, points) <= recall), guess + 1)
        .when(_grid(guess, points) > recall, guess - 1)
        .otherwise(guess)
    )


def average_precision(curves: DataFrame, classes: DataFrame, points: int = 11, by=()) -> DataFrame:
    """Interpolated AP per class; classes without points get 0.

    A point with recall R serves every grid level up to R, so points are first
    reduced to the best precision per highest level served (``points`` rows per
    class), and only those rows are spread over the levels. ``classes`` holds
    ``class_id`` and the ``by`` columns.
    """
    groups = [*by, "class_id"]
    best = curves.groupBy(*groups, _level(F.col("recall"), points).alias("level")).agg(F.max("precision").alias("p"))
    served = best.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("level"))))
    ap = (
        served.groupBy(*groups, "level").agg(F.max("p").alias("p"))
        .groupBy(*groups).agg((F.sum("p") / F.lit(points)).alias("ap"))
    )
    return classes.join(ap, groups, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


# Points of a bucket that one task may order.
BUCKET = 1 << 20


def _tie_bucket(numeric: bool) -> Column:
    """Order-keeping bucket of the image, the first tie key: by its distance from the first number, or by the marks it has reached."""
    if not numeric:
        return F.size(F.filter(F.col("_b.marks"), lambda m: m <= F.col("image_id")))
    span = (F.col("_b.last") - F.col("_b.first") + 1).cast("double")
    return F.floor((F.col("image_id") - F.col("_b.first")) / span * TIE_BUCKETS).cast("int")


def _bounds(rows: DataFrame, numeric: bool) -> tuple[Column, float, float]:
    """What the buckets need, as constants: the image bounds as a struct ``_b``, the lowest and the highest score.

    For keys that are no numbers, marks are the images with the smallest hashes, so they fall evenly into any kind of key.
    """
    ends = [F.min("image_id").alias("first"), F.max("image_id").alias("last")] if numeric else []
    known = rows.agg(F.max(F.array_max("scores")).alias("high"), F.min(F.array_min("scores")).alias("low"), *ends)
    found, kinds = known.first(), dict(known.dtypes)
    fields = [F.lit(found[n]).cast(kinds[n]).alias(n) for n in known.columns]
    if not numeric:
        marks = rows.select("image_id").distinct().orderBy(F.xxhash64("image_id"), "image_id").limit(TIE_MARKS)
        fields.append(marks.agg(F.array_sort(F.collect_list("image_id"))).scalar().alias("marks"))
    return F.struct(*fields), float(found["low"] or 0.0), float(found["high"] or 0.0)


def _codes(buckets: DataFrame, code: Column, by) -> dict[tuple, np.ndarray]:
    """The buckets of each run as numbers: at most ``SLOTS`` for a class."""
    listed = buckets.groupBy(*by).agg(F.collect_list(code).alias("codes")).collect()
    return {tuple(r[name] for name in by): np.array(r["codes"], dtype=np.int32) for r in listed if r["codes"]}


def deciding_points(rows: DataFrame, num_classes: int, points: int = 11, by=(), bucket: int = BUCKET) -> DataFrame:
    """The curve points that can decide an interpolated AP, without sorting the whole curve.

    1. Count rows and hits per class and bucket of the curve order, a batch of
       rows at a time: the points of a row never become rows here.
    2. Running totals over the buckets (a bounded table) bound the precision of
       the hits in each bucket from both sides. A bucket whose upper bound is
       below what its recall level surely reaches cannot decide anything.
    3. Only the rows of the remaining buckets are ordered, each bucket by
       itself, one of more than ``bucket`` rows over many tasks. Their list is
       bounded by runs, classes and buckets, so tasks get it as a constant.

    The result holds the exact ``precision`` and ``recall`` of the hits in
    those buckets; :func:`average_precision` gives the same value from it as
    from the full curve.
    """
    groups = [*by, "class_id"]
    numeric = isinstance(rows.schema["image_id"].dataType, NumericType)
    bounds, low, high = _bounds(rows, numeric)
    tagged = rows.withColumn("_b", bounds)
    tie = _tie_bucket(numeric)
    histogram = count_buckets(tagged, num_classes, tie, low, high, by)
    ordered = Window.partitionBy(*groups).orderBy(F.col("slot").desc())
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    spans = histogram.withColumns({
        "n_end": F.sum("n").over(upto), "t_end": F.sum("t").over(upto), "positives": F.sum("t").over(whole),
    }).where(F.col("t") > 0)
    n_before, t_before = F.col("n_end") - F.col("n"), F.col("t_end") - F.col("t")
    reach = Window.partitionBy(*groups).orderBy(F.col("level").desc()).rangeBetween(Window.unboundedPreceding, 0)
    judged = spans.withColumns({
        "level": _level(F.col("t_end") / F.col("positives"), points),
        "least": F.col("t_end") / F.col("n_end"), "most": F.col("t_end") / (n_before + F.col("t")),
    })
    open_buckets = materialize(
        judged.withColumn("sure", F.max("least").over(reach)).where(F.col("most") >= F.col("sure"))
        .select(*groups, "slot", "n", n_before.alias("n_before"), t_before.alias("t_before"), "positives"),
        "open-buckets",
    )
    code = (F.col("class_id") * SLOTS + F.col("slot")).cast("int")
    order, counts = [F.col("score").desc(), *evaluation_order()], {"_rank": F.lit(1).cast("bigint"), "_tp": F.col("hit")}

    def inside(part: DataFrame, codes: dict[tuple, np.ndarray]) -> DataFrame:
        return points_in(tagged, num_classes, tie, low, high, codes, by).unionByName(missed_in(tagged, tie, part, by))

    small, large = open_buckets.where(F.col("n") <= bucket), open_buckets.where(F.col("n") > bucket)
    upto = Window.partitionBy(*groups, "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = inside(small, _codes(small, code, by)).withColumns({name: F.sum(value).over(upto) for name, value in counts.items()})
    codes = _codes(large, code, by)
    if codes:
        running = running.unionByName(running_totals(inside(large, codes), [*groups, "slot"], order, counts, "deciding"))
    placed = running.where(F.col("hit") == 1).join(open_buckets, [*groups, "slot"])
    tp, rank = F.col("t_before") + F.col("_tp"), F.col("n_before") + F.col("_rank")
    return placed.select(*groups, (tp / rank).alias("precision"), (tp / F.col("positives")).alias("recall"))


def average_precision_of(rows: DataFrame, classes: DataFrame, num_classes: int, points: int = 11, by=()) -> DataFrame:
    """Interpolated AP per class straight from evaluation rows (``rows`` is read three times: store it first)."""
    return average_precision(deciding_points(rows, num_classes, points, by), classes, points, by)


def mean_average_precision(ap: DataFrame, by=()) -> DataFrame:
    """Mean AP over all classes, those without ground truth included; 0 for no classes."""
    return ap.groupBy(*by).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))

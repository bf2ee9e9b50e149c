"""Class-score vectors: padding, evaluation modes, combined confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVAL_TYPES = ("class_scores", "combined", "objectness")


def conform(scores: Column, num_classes: int) -> Column:
    """Pad with 0 or cut to ``num_classes`` entries."""
    padded = F.concat(F.coalesce(scores, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), num_classes))
    return F.when(F.size(scores) == num_classes, scores).otherwise(F.slice(padded, 1, num_classes))


def one_hot(class_id: Column, value: Column, num_classes: int) -> Column:
    """``value`` at ``class_id``, 0 elsewhere (all 0 when the id is out of range)."""
    ids = F.sequence(F.lit(0), F.lit(num_classes - 1))
    return F.transform(ids, lambda i: F.when(i == class_id, value).otherwise(0.0))


def class_score(scores: Column, class_id: Column) -> Column:
    """Score of one class, 0 when the id lies outside the vector."""
    inside = F.when(class_id >= 0, class_id)
    return F.coalesce(F.get(scores, inside), F.lit(0.0))


def combined_confidence(score: Column, scores: Column, class_id: Column) -> Column:
    return class_score(scores, class_id) * score


def evaluation_vector(score: Column, scores: Column, class_id: Column, num_classes: int, eval_type: str) -> Column:
    if eval_type == "class_scores":
        return conform(scores, num_classes)
    if eval_type == "combined":
        return F.transform(conform(scores, num_classes), lambda s: s * score)
    if eval_type == "objectness":
        return one_hot(class_id, score, num_classes)
    raise ValueError(f"unknown eval_type: {eval_type}")


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def above(score: Column, threshold: float) -> Column:
    """Strictly above; Spark orders NaN above every number, so NaN is excluded by name."""
    return (score > F.lit(float(threshold))) & ~F.isnan(score)


def add_class_name(df: DataFrame, classes: DataFrame, unknown: str | None = "unknown") -> DataFrame:
    """Attach ``class_name``; ids outside the class table read ``unknown``, or ``Class <id>`` when it is None."""
    other = F.lit(unknown) if unknown is not None else F.concat(F.lit("Class "), F.col("class_id").cast("string"))
    named = df.join(classes.select("class_id", "class_name"), "class_id", "left")
    return named.withColumn("class_name", F.coalesce("class_name", other))


def two_decimals(value: Column) -> Column:
    """Non-negative ``value`` as text with two decimals, rounded on its exact binary value, halves to even.

    ``format_string`` rounds the shortest decimal form instead, which turns
    0.835 (stored slightly below) into 0.84. The product with 100 is therefore
    taken together with its rounding error.
    """
    product = value * 100
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    error = (high * 100 - product) + (value - high) * 100
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    cents = whole + up.cast("int")
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)

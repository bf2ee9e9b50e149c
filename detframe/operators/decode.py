"""Raw model output to detections, and back to one row per layer entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions.scores import add_class_name, argmax, conform, two_decimals


def _scaled(value: Column, extent: Column) -> Column:
    """Pixel value truncated toward zero; the product is taken in single precision, as the model emits it."""
    return (value.cast("float") * extent.cast("float")).cast("float").cast("int")


def decode_predictions(raw: DataFrame, score_threshold: float = 0.5) -> DataFrame:
    """``v`` = ``[cx, cy, w, h, objectness, class scores...]`` (normalised) to pixel boxes.

    Rows without class scores, or with objectness at or below the threshold,
    are dropped. ``raw`` carries ``width`` and ``height`` of its image.
    """
    v = F.col("v")
    kept = raw.where(F.size(v) > 5).where((F.get(v, F.lit(4)) > F.lit(float(score_threshold))) & ~F.isnan(F.get(v, F.lit(4))))
    size = {
        "cx": _scaled(F.get(v, F.lit(0)), F.col("width")), "cy": _scaled(F.get(v, F.lit(1)), F.col("height")),
        "w": _scaled(F.get(v, F.lit(2)), F.col("width")), "h": _scaled(F.get(v, F.lit(3)), F.col("height")),
        "score": F.get(v, F.lit(4)).cast("double"), "cs": F.slice(v, 6, F.size(v) - 5).cast("array<double>"),
    }
    boxed = kept.withColumns(size)
    return boxed.withColumns(
        {
            "class_id": argmax(F.col("cs")),
            "x": (F.col("cx") - F.col("w") / 2).cast("int").cast("double"),
            "y": (F.col("cy") - F.col("h") / 2).cast("int").cast("double"),
            "w": F.col("w").cast("double"), "h": F.col("h").cast("double"),
        }
    ).drop("v", "cx", "cy", "width", "height")


def flatten_predictions(layered: DataFrame, num_classes: int) -> DataFrame:
    """``layers`` (array of arrays of rows) to one row per prediction with conformed class scores."""
    by_layer = layered.select("image_id", F.posexplode("layers").alias("layer", "entries"))
    rows = by_layer.select("image_id", "layer", F.posexplode("entries").alias("entry", "v"))
    v = F.col("v")
    box = [F.get(v, F.lit(i)).cast("double").alias(name) for i, name in enumerate(("b0", "b1", "b2", "b3"))]
    scores = F.slice(v, 6, F.greatest(F.size(v) - 5, F.lit(0))).cast("array<double>")
    return rows.select(
        "image_id", "layer", "entry", *box, F.get(v, F.lit(4)).cast("double").alias("objectness"),
        conform(scores, num_classes).alias("cs"),
    )


def overlay_rows(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """What a renderer needs per box: label text, integer corners and the label's baseline."""
    named = add_class_name(detections, classes, unknown=None)
    corner = {
        "left": F.col("x").cast("int"), "top": F.col("y").cast("int"),
        "right": F.col("x").cast("int") + F.col("w").cast("int"), "bottom": F.col("y").cast("int") + F.col("h").cast("int"),
    }
    return named.select(
        "image_id", "pos", F.concat("class_name", F.lit(": "), two_decimals(F.col("score"))).alias("label"),
        *[c.alias(n) for n, c in corner.items()], F.greatest(F.col("y").cast("int") - 10, F.lit(20)).alias("label_y"),
    )

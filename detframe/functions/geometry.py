"""Box geometry as column expressions.

Boxes are either ``x, y, w, h`` (top-left corner and size) or corners
``x1, y1, x2, y2``. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

BOX = ("x", "y", "w", "h")


def _zero() -> Column:
    return F.lit(0.0)


def _side(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(_zero(), F.least(high_a, high_b) - F.greatest(low_a, low_b))


def _ratio(inter: Column, area_a: Column, area_b: Column, missing: Column) -> Column:
    # greatest/least skip NULLs, so a box missing after an outer join needs its own branch.
    union = area_a + area_b - inter
    return F.when(missing, F.lit(None).cast("double")).when(union > 0, inter / union).otherwise(_zero())


def iou_xywh(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two top-left boxes; 0 where the union is empty."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    inter = _side(ax, ax + aw, bx, bx + bw) * _side(ay, ay + ah, by, by + bh)
    area_a = F.greatest(_zero(), aw) * F.greatest(_zero(), ah)
    area_b = F.greatest(_zero(), bw) * F.greatest(_zero(), bh)
    return _ratio(inter, area_a, area_b, ax.isNull() | bx.isNull())


def iou_xyxy(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two corner boxes; 0 where the union is empty."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    inter = _side(ax1, ax2, bx1, bx2) * _side(ay1, ay2, by1, by2)
    area_a = F.greatest(_zero(), ax2 - ax1) * F.greatest(_zero(), ay2 - ay1)
    area_b = F.greatest(_zero(), bx2 - bx1) * F.greatest(_zero(), by2 - by1)
    return _ratio(inter, area_a, area_b, ax1.isNull() | bx1.isNull())


def clamp_unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(_zero(), value))


def box_cols(prefix: str = "") -> list[Column]:
    return [F.col(prefix + name) for name in BOX]


def center_to_xywh(df: DataFrame, width: Column | float = 1.0, height: Column | float = 1.0) -> DataFrame:
    """``cx, cy, w, h`` (normalised) to ``x, y, w, h`` scaled by the image size."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    height = height if isinstance(height, Column) else F.lit(float(height))
    w, h = F.col("w") * width, F.col("h") * height
    return df.withColumns(
        {"x": F.col("cx") * width - w / 2, "y": F.col("cy") * height - h / 2, "w": w, "h": h}
    ).drop("cx", "cy")


def xywh_to_xyxy(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")}
    ).drop(*BOX)


def _known_format(box_format: str) -> None:
    if box_format not in ("yolo", "xyxy"):
        raise ValueError("box_format must be 'yolo' or 'xyxy'")


def flip_boxes(df: DataFrame, axis: str, box_format: str = "yolo") -> DataFrame:
    """Mirror boxes left-right (``horizontal``) or top-bottom (``vertical``).

    ``yolo`` boxes are normalised ``cx, cy, w, h``; ``xyxy`` boxes are pixel
    corners and need the ``width`` and ``height`` columns of the image.
    """
    _known_format(box_format)
    if axis not in ("horizontal", "vertical"):
        raise ValueError("axis must be 'horizontal' or 'vertical'")
    if box_format == "yolo":
        center = "cx" if axis == "horizontal" else "cy"
        return df.withColumn(center, 1.0 - F.col(center))
    low, high, extent = ("x1", "x2", "width") if axis == "horizontal" else ("y1", "y2", "height")
    return df.withColumns({low: F.col(extent) - F.col(high), high: F.col(extent) - F.col(low)})


def boxes_of_arrays(images: DataFrame, column: str = "boxes", box_format: str = "yolo") -> DataFrame:
    """One row per box from an array of boxes per image, each ``class_id`` and four coordinates, perhaps more values.

    Coordinates are single precision, as in the label files' arrays. The column must be two-dimensional; a box of fewer than five
    values, a null box or a null among its first five values raises when the box is read. Further values are kept in ``extra``;
    an image without boxes gives no row.
    """
    _known_format(box_format)
    kind = images.schema[column].dataType
    flat = not isinstance(kind, ArrayType) or not isinstance(kind.elementType, ArrayType)
    if flat or not isinstance(kind.elementType.elementType, NumericType):
        raise ValueError("boxes must be an array of arrays of numbers")
    names = ("cx", "cy", "w", "h") if box_format == "yolo" else ("x1", "y1", "x2", "y2")
    each = images.select(*[c for c in images.columns if c != column], F.posexplode(column).alias("pos", "_box"))
    sound = (F.size("_box") >= 5) & F.forall(F.slice("_box", 1, 5), lambda v: v.isNotNull())
    short = F.raise_error(F.lit("boxes must have shape N x 5 or more")).cast(kind.elementType)
    box = each.withColumn("_box", F.when(F.coalesce(sound, F.lit(False)), F.col("_box")).otherwise(short))
    values = [F.col("_box")[i + 1].cast("float").cast("double").alias(n) for i, n in enumerate(names)]
    rest = F.slice("_box", F.lit(6), F.greatest(F.size("_box") - 5, F.lit(0))).alias("extra")
    return box.select(*[c for c in each.columns if c != "_box"], F.col("_box")[0].cast("int").alias("class_id"), *values, rest)


def target_size(width: Column, height: Column, target=None, scale: float | None = None) -> tuple[Column, Column]:
    """Size after a resize: given outright, or the old size times ``scale`` rounded half to even."""
    if target is not None:
        if min(target) <= 0:
            raise ValueError("target width and height must be positive")
        return F.lit(int(target[0])), F.lit(int(target[1]))
    if scale is None:
        raise ValueError("resizing needs a target size or a scale")
    if scale <= 0:
        raise ValueError("scale must be positive")
    return tuple(F.bround(side * F.lit(float(scale)), 0).cast("int") for side in (width, height))


def resize_boxes(df: DataFrame, target=None, scale: float | None = None, box_format: str = "yolo") -> DataFrame:
    """Boxes after an image resize; normalised boxes do not move."""
    _known_format(box_format)
    new_w, new_h = target_size(F.col("width"), F.col("height"), target, scale)
    if box_format == "yolo":
        return df
    fx, fy = new_w / F.col("width"), new_h / F.col("height")
    return df.withColumns(
        {"x1": F.col("x1") * fx, "x2": F.col("x2") * fx, "y1": F.col("y1") * fy, "y2": F.col("y2") * fy}
    )

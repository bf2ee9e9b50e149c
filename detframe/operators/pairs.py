"""Overlapping box pairs within an image.

Ordinary images are joined on ``image_id``. Images with more boxes than
``limit`` are joined on (image, grid cell, salt) instead: a pair is reported
only by the cell that holds the top-left corner of its intersection, so every
overlapping pair appears exactly once and no task sees a whole hot image.
Levels and salts follow the boxes of an image: up to ``LIMIT`` of them need one
grid and no salt, so that few copies of a box are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions.geometry import BOX
from detframe.session import materialize

# Boxes per image up to which a task may hold an image's boxes.
LIMIT = 1024
# Most parts the boxes of a cell are dealt into.
SALTS = 16

On = Callable[[], Column]


def hot_images(*sides: DataFrame, limit: int = LIMIT, by=(), room: int = LIMIT) -> DataFrame | None:
    """Images with more than ``limit`` rows on any side, with the grid levels their boxes need and their salts; None when there are none.

    ``by`` names columns that pairs must share (a run): the rows of an image are counted for each value by itself. An image of up
    to ``room`` boxes uses its coarsest grid alone; one with more has a salt for every ``room`` boxes, ``SALTS`` at most.
    """
    solid = (F.col("w") > 0) & (F.col("h") > 0)
    found = None
    for side in sides:
        part = side.groupBy("image_id", *by).agg(F.count("*").alias("n"), F.collect_set(F.when(solid, _level())).alias("levels"))
        part = part.select("image_id", "n", "levels")
        found = part if found is None else found.unionAll(part)
    merged = found.groupBy("image_id").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("levels"))).alias("levels"))
    coarse_first = F.sort_array("levels", asc=False)
    levels = F.when(F.col("n") <= room, F.slice(coarse_first, 1, 1)).otherwise(coarse_first)
    salts = F.least(F.lit(SALTS), F.ceil(F.col("n") / F.lit(room))).cast("int")
    hot = materialize(merged.where(F.col("n") > limit).select("image_id", "n", levels.alias("levels"), salts.alias("salts")), "hot-images")
    return None if hot.isEmpty() else hot


def _level() -> Column:
    """The smallest power of two that holds a box's longer side: one of some two thousand at most, in practice a dozen."""
    return F.ceil(F.log2(F.greatest("w", "h"))).cast("int")


def split_hot(df: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary images, rows of hot images)."""
    if hot is None:
        return df, None
    ids = hot.select("image_id")
    return df.join(ids, "image_id", "left_anti"), df.join(ids, "image_id", "left_semi")


def same(name: str) -> Column:
    """Both sides of a pair agree in ``name``, said so that it is no join key: rows partitioned by image are not shuffled by it."""
    left, right = F.col(f"l_{name}"), F.col(f"r_{name}")
    return (left <= right) & (left >= right)


def _side(df: DataFrame, prefix: str) -> DataFrame:
    """One side of a pair join: the boxes with an area."""
    solid = df.where((F.col("w") > 0) & (F.col("h") > 0))
    return solid.select([F.col(c).alias(prefix + c) for c in solid.columns])


def _far(side: str, axis: str, size: str) -> Column:
    return F.col(f"{side}_{axis}") + F.col(f"{side}_{size}")


def _touch() -> Column:
    """The boxes share area: a cheap test that most pairs of an image fail."""
    across = (F.col("l_x") < _far("r", "x", "w")) & (F.col("r_x") < _far("l", "x", "w"))
    return across & (F.col("l_y") < _far("r", "y", "h")) & (F.col("r_y") < _far("l", "y", "h"))


def _with_iou(joined: DataFrame, min_iou: float, strict: bool) -> DataFrame:
    col = F.col
    wide = F.least(_far("l", "x", "w"), _far("r", "x", "w")) - F.greatest("l_x", "r_x")
    high = F.least(_far("l", "y", "h"), _far("r", "y", "h")) - F.greatest("l_y", "r_y")
    inter = wide * high
    iou, bound = col("iou"), F.lit(float(min_iou))
    positive = min_iou <= 0
    keep = (iou > 0) if positive else (iou > bound) if strict else (iou >= bound)
    areas = col("l_w") * col("l_h") + col("r_w") * col("r_h")
    scored = joined.withColumn("iou", F.try_divide(inter, areas - inter)).where(keep)
    return scored.withColumnRenamed("l_image_id", "image_id").drop("r_image_id")


def _cells(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Each box in the cells it touches, at most four a level, on the grid of its own level and of the coarser ones of its image.

    Two boxes meet on the coarser of their two levels, where both touch few cells, however much their sizes differ. A box finer
    than all grids of its image belongs to the finest of them.
    """
    sized = df.where((F.col("w") > 0) & (F.col("h") > 0)).join(hot.select("image_id", "levels", "salts"), "image_id")
    sized = sized.withColumn("own", F.greatest(_level(), F.array_min("levels")))
    sized = sized.withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("own")))).drop("levels")
    for axis, size in (("x", "w"), ("y", "h")):
        first, last = F.floor(F.col(axis) / _cell("level")), F.floor((F.col(axis) + F.col(size)) / _cell("level"))
        sized = sized.withColumn(f"c{axis}", F.explode(F.sequence(first, last)))
    return sized


def _cell(level: str) -> Column:
    return F.pow(F.lit(2.0), F.col(level))


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    on: On | None = None,
    min_iou: float = 0.0,
    strict: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Pairs (``l_*``, ``r_*``, ``iou``) of one image with positive IoU above ``min_iou``.

    ``on`` is a further condition over the prefixed columns. ``hot`` is the
    result of :func:`hot_images`.
    """
    extra = on() if on is not None else F.lit(True)
    cool_l, cool_r = (left, right) if hot is None else [side.join(hot.select("image_id"), "image_id", "left_anti") for side in (left, right)]
    cool = _side(cool_l, "l_").join(_side(cool_r, "r_"), (F.col("l_image_id") == F.col("r_image_id")) & extra & _touch())
    pairs = _with_iou(cool, min_iou, strict)
    return pairs if hot is None else pairs.unionAll(hot_pairs(left, right, hot, on, min_iou, strict).select(pairs.columns))


def hot_pairs(
    left: DataFrame, right: DataFrame, hot: DataFrame | None, on: On | None = None, min_iou: float = 0.0, strict: bool = True
) -> DataFrame:
    """The pairs of :func:`overlapping_pairs` for rows of hot images alone; without any, all images are ordinary."""
    if hot is None:
        return overlapping_pairs(left, right, on, min_iou, strict)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in ("pos", *BOX)]), F.col("salts"))
    every_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1).cast("array<bigint>"))
    l_cells = _side(_cells(left, hot).withColumn("salt", spread).drop("salts"), "l_")
    r_cells = _side(_cells(right, hot).withColumn("salt", every_salt).drop("salts"), "r_")
    condition = (on() if on is not None else F.lit(True)) & _touch()
    for c in ("image_id", "level", "cx", "cy", "salt"):
        condition = condition & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    for a in ("x", "y"):  # the cell that owns the pair
        condition = condition & (F.floor(F.greatest(F.col(f"l_{a}"), F.col(f"r_{a}")) / _cell("l_level")) == F.col(f"l_c{a}"))
    condition = condition & (F.greatest("l_own", "r_own") == F.col("l_level"))
    places = [side + c for side in ("l_", "r_") for c in ("own", "level", "cx", "cy", "salt")]
    return _with_iou(l_cells.join(r_cells, condition), min_iou, strict).drop(*places)


def box_pairs(boxes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Unordered pairs of overlapping boxes in an image, the lower ``pos`` on the left.

    Pairs that do not touch have IoU 0 and are implied by the box counts.
    """
    narrow = boxes.select("image_id", "pos", *BOX)
    return overlapping_pairs(
        narrow, narrow, lambda: F.col("l_pos") < F.col("r_pos"), hot=hot_images(narrow, limit=limit)
    )


def duplicate_pairs(detections: DataFrame, iou_threshold: float = 0.5, by=(), limit: int = LIMIT, mask: str | None = None) -> DataFrame:
    """Same-class pairs of detections with IoU strictly above the threshold.

    ``by`` names further columns (a run, a threshold) that must be equal too; ``mask`` a bit set (of runs) that both must share
    bits of, and pairs have what they share.
    """
    bits = [mask] if mask else []
    narrow = detections.select("image_id", "pos", "class_id", *by, *bits, *BOX)

    def same_class() -> Column:
        condition = same("class_id") & (F.col("l_pos") < F.col("r_pos"))
        for name in by:
            condition = condition & same(name)
        for name in bits:
            condition = condition & (F.col(f"l_{name}").bitwiseAND(F.col(f"r_{name}")) != 0)
        return condition

    pairs = overlapping_pairs(narrow, narrow, same_class, iou_threshold, hot=hot_images(narrow, limit=limit, by=by))
    renamed = {f"l_{name}": name for name in ("class_id", *by)}
    for name in bits:
        pairs = pairs.withColumn(name, F.col(f"l_{name}").bitwiseAND(F.col(f"r_{name}"))).drop(f"l_{name}", f"r_{name}")
    return pairs.withColumnsRenamed(renamed).drop(*[f"r_{n}" for n in ("class_id", *by)])


def weighted_pairs(boxes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``image_id, iou, pairs``: touching pairs of an image, where exact copies in hot images count together.

    n copies of one box form n(n-1)/2 pairs of IoU 1 among themselves, and n*m
    pairs with the m copies of another box; none of these are spelled out.
    """
    narrow = boxes.select("image_id", "pos", *BOX)
    hot = hot_images(narrow, limit=limit)
    cool, dense = split_hot(narrow, hot)
    rows = cool.withColumn("n", F.lit(1).cast("bigint"))
    own = None
    if hot is not None:
        counted = materialize(dense.groupBy("image_id", *BOX).agg(F.min("pos").alias("pos"), F.count("*").alias("n")), "copies")
        rows = rows.unionByName(counted)
        own = counted.where((F.col("n") > 1) & (F.col("w") > 0) & (F.col("h") > 0)).select(
            "image_id", F.lit(1.0).alias("iou"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs")
        )
    pairs = overlapping_pairs(rows, rows, lambda: F.col("l_pos") < F.col("r_pos"), hot=hot).select(
        "image_id", "iou", (F.col("l_n") * F.col("r_n")).alias("pairs")
    )
    return pairs if own is None else pairs.unionAll(own)


def best_ground_truth(
    detections: DataFrame, ground_truth: DataFrame, iou_threshold: float = 0.5, limit: int = LIMIT
) -> DataFrame:
    """Best ground-truth box of each detection, not exclusive: two detections may share one box.

    Ties in IoU go to the first box. Detections whose best IoU is below the
    threshold have no row. In hot images exact copies are joined once, on both
    sides: copies of a detection have the same best box, and of copies of a
    ground-truth box the first wins.
    """
    dets = detections.select("image_id", "pos", *BOX)
    truth = ground_truth.select("image_id", "pos", "class_id", *BOX)
    hot = hot_images(dets, truth, limit=limit)
    cool_d, hot_d = split_hot(dets, hot)
    cool_t, hot_t = split_hot(truth, hot)
    found = _best(overlapping_pairs(cool_d, cool_t, min_iou=iou_threshold, strict=False))
    if hot is None:
        return found
    copies = ["image_id", *BOX]
    lead = hot_d.groupBy(*copies).agg(F.min("pos").alias("lead"))
    first = hot_t.groupBy(*copies).agg(F.min(F.struct("pos", "class_id")).alias("f")).select(*copies, "f.*")
    pairs = hot_pairs(lead.withColumnRenamed("lead", "pos"), first, hot, min_iou=iou_threshold, strict=False)
    members = hot_d.join(lead, copies).select("image_id", "pos", "lead")
    dense = _best(pairs).withColumnRenamed("pos", "lead").join(members, ["image_id", "lead"]).select(found.columns)
    return found.unionAll(dense)


def _best(pairs: DataFrame) -> DataFrame:
    """Highest IoU per left box, the first right box on ties."""
    best = F.max(
        F.struct("iou", (-F.col("r_pos")).alias("order"), "r_pos", "r_class_id", *[f"r_{c}" for c in BOX])
    ).alias("best")
    return (
        pairs.groupBy("image_id", F.col("l_pos").alias("pos"))
        .agg(best)
        .select(
            "image_id", "pos", F.col("best.iou").alias("iou"), F.col("best.r_pos").alias("gt_pos"),
            F.col("best.r_class_id").alias("gt_class_id"), *[F.col(f"best.r_{c}").alias(f"gt_{c}") for c in BOX],
        )
    )

"""Greedy non-maximum suppression, class-agnostic, per image.

A detection survives when no surviving detection with a higher
``(score, pos)`` overlaps it by more than the threshold. Detections of an
image that overlap nothing are kept by the join alone; only the overlap edges
of an image are folded in priority order, which settles every threshold of a
sweep from one join. Images above ``limit`` boxes are settled slice by slice,
see :func:`_suppress_hot`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions.geometry import BOX, iou_xywh
from detframe.functions.scores import above
from detframe.operators.islands import FOLD, fold_islands, lost_boxes, split_islands
from detframe.operators.pairs import LIMIT, hot_images, hot_pairs, overlapping_pairs, same, split_hot
from detframe.session import materialize

KEY = ("image_id", "pos")
# Suppression thresholds of the standard sweep.
SWEEP_THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.7)


def _left_wins() -> Column:
    higher = F.col("l_score") > F.col("r_score")
    return higher | ((F.col("l_score") == F.col("r_score")) & (F.col("l_pos") > F.col("r_pos")))


def _lost(edges: Column, threshold: float) -> Column:
    """Positions suppressed at ``threshold``; ``edges`` are sorted by the winner's priority.

    When an edge is read, everything that could remove its winner has been read.
    """
    relevant = F.filter(edges, lambda e: e["iou"] > F.lit(float(threshold)))

    def step(lost: Column, e: Column) -> Column:
        idle = F.array_contains(lost, e["winner"]) | F.array_contains(lost, e["loser"])
        return F.when(idle, lost).otherwise(F.array_append(lost, e["loser"]))

    return F.aggregate(relevant, F.array().cast("array<int>"), step)


def _lost_by_image(dets: DataFrame, thresholds: Sequence[float], by: str | None = None) -> DataFrame:
    """Per ordinary image with overlaps: one array of suppressed positions per threshold; with ``by`` one entry of ``runs`` for each of its values."""

    def beaten() -> Column:
        return _left_wins() if by is None else _left_wins() & same(by)

    edges = overlapping_pairs(dets, dets, beaten, min_iou=min(thresholds))
    edge = F.struct(
        (-F.col("l_score")).alias("order"), (-F.col("l_pos")).alias("tie"),
        F.col("l_pos").cast("int").alias("winner"), F.col("r_pos").cast("int").alias("loser"), "iou",
    )
    keys = ["image_id"] if by is None else ["image_id", F.col(f"l_{by}").alias(by)]
    grouped = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    lost = [_lost(F.col("edges"), t).alias(f"lost_{i}") for i, t in enumerate(thresholds)]
    if by is None:
        return grouped.select("image_id", *lost)
    return grouped.select("image_id", F.struct(by, *lost).alias("run")).groupBy("image_id").agg(F.collect_list("run").alias("runs"))


def _settle(dets: DataFrame, threshold: float, hot: DataFrame, fold: int = FOLD) -> DataFrame:
    """Exact survivors of ``dets``: islands of the overlap graph are folded in order, only giant ones go to rounds."""
    edges = materialize(
        hot_pairs(dets, dets, hot, _left_wins, threshold).select(
            "image_id", F.col("l_pos").alias("winner"), F.col("r_pos").alias("loser"), F.col("l_score").alias("score")
        ),
        "edges",
    )
    small, giant = split_islands(edges, "winner", "loser", fold=fold)
    order = [(-F.col("score")).asc_nulls_last(), F.col("winner").desc()]
    lost = fold_islands(small, order, "winner", "loser", lost_boxes).select("image_id", F.col("loser").cast("int").alias("pos"))
    if giant is None:
        return dets.select(*KEY).join(lost, [*KEY], "left_anti")
    giant = materialize(giant.drop("score"), "giant-edges")
    ends = giant.select("image_id", F.explode(F.array("winner", "loser")).alias("pos")).distinct()
    boxes = materialize(ends, "giant-boxes")
    rest = dets.select(*KEY).join(lost, [*KEY], "left_anti").join(boxes, [*KEY], "left_anti")
    return rest.unionByName(_settle_rounds(boxes, giant))


def _settle_rounds(dets: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by rounds of joins over stored edges, for islands too large for one task.

    Each round keeps every open box without an open better neighbour and drops
    what those boxes suppress; this is the greedy result, reached in parallel.
    """
    loser = edges.select("image_id", F.col("loser").alias("pos"))
    open_ = materialize(dets.select(*KEY).join(loser, [*KEY], "left_semi"), "open")
    fresh = materialize(dets.select(*KEY).join(loser, [*KEY], "left_anti"), "kept")
    kept = [fresh]
    while not open_.isEmpty():
        winners = fresh.withColumnRenamed("pos", "winner")
        gone = edges.join(winners, ["image_id", "winner"], "left_semi").select("image_id", F.col("loser").alias("pos"))
        open_ = materialize(open_.join(gone, [*KEY], "left_anti"), "open")
        still = open_.withColumnRenamed("pos", "winner")
        edges = materialize(edges.join(still, ["image_id", "winner"], "left_semi"), "edges")
        blocked = edges.select("image_id", F.col("loser").alias("pos"))
        fresh = materialize(open_.join(blocked, [*KEY], "left_anti"), "kept")
        open_ = materialize(open_.join(fresh, [*KEY], "left_anti"), "open")
        kept.append(fresh)
    out = kept[0]
    for part in kept[1:]:
        out = out.unionAll(part)
    return out


# Score quantiles from which the next slice of a hot image is cut.
_CUTS = (0.0, 0.5, 0.75, 0.9, 0.97, 0.99, 0.997, 0.999, 0.9997, 0.9999, 0.99999)


def _suppress_hot(dets: DataFrame, threshold: float, hot: DataFrame, first: int = 4096, fold: int = FOLD) -> DataFrame:
    """Survivors in hot images, from the best-scored slice downwards.

    The top slice is settled, everything it suppresses is dropped, and the next
    slice may be eight times larger. Exact copies of a box are reduced to the
    best one first. Any cut gives the same result; the quantile only sets the
    slice size, so an approximate one is enough.
    """
    if threshold < 1:
        best = F.max(F.struct("score", "pos")).alias("best")
        solid = dets.where((F.col("w") > 0) & (F.col("h") > 0)).groupBy("image_id", *BOX).agg(best)
        flat = dets.where(~((F.col("w") > 0) & (F.col("h") > 0)))
        dets = solid.select("image_id", F.col("best.pos").alias("pos"), F.col("best.score").alias("score"), *BOX)
        dets = dets.unionAll(flat.select(dets.columns))
    rest, take, kept = materialize(dets, "rest"), first, None
    while not rest.isEmpty():
        stats = rest.groupBy("image_id").agg(
            F.count("*").alias("n"), F.percentile_approx("score", [float(c) for c in _CUTS], 100000).alias("cuts")
        )
        wanted = 1 - F.lit(float(take)) / F.col("n")
        place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in _CUTS]), lambda c: c <= wanted))
        cut = F.when(place > 0, F.get("cuts", place - 1)).otherwise(F.get("cuts", F.lit(0)))
        lowest = F.when(F.col("n") <= take, F.lit(float("-inf"))).otherwise(cut)
        marked = materialize(rest.join(stats.select("image_id", lowest.alias("cut")), "image_id"), "marked")
        head = marked.where(F.col("score") >= F.col("cut")).drop("cut")
        tail = marked.where(F.col("score") < F.col("cut")).drop("cut")
        fresh = materialize(head.join(_settle(head, threshold, hot, fold), [*KEY], "left_semi"), "survivors")
        hit = hot_pairs(fresh, tail, hot, min_iou=threshold)
        rest = materialize(
            tail.join(hit.select("image_id", F.col("r_pos").alias("pos")), [*KEY], "left_anti"), "rest"
        )
        kept = fresh if kept is None else kept.unionAll(fresh)
        take *= 8
    return kept.select(*KEY) if kept is not None else dets.select(*KEY).limit(0)


def suppress_sweep(
    detections: DataFrame,
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
    score_threshold: float = 0.5,
    limit: int = LIMIT,
    fold: int = FOLD,
    by: str | None = None,
) -> DataFrame:
    """Survivors at every threshold, with a column ``nms_threshold``; one overlap join for all of them.

    Images above ``limit`` boxes are settled by islands of up to ``fold`` overlaps, see :func:`_settle`. ``by`` names a column (a
    condition) whose values are suppressed apart; rows stay partitioned by image alone.
    """
    passed = detections.where(above(F.col("score"), score_threshold))
    extra = [] if by is None else [by]
    narrow = passed.select("image_id", F.col("pos").cast("int").alias("pos"), "score", *BOX, *extra)
    thresholds = [float(t) for t in thresholds]
    if min(thresholds) < 0:
        raise ValueError("suppression thresholds must not be negative")
    hot = hot_images(narrow, limit=limit, by=extra)
    cool, hot_dets = split_hot(narrow, hot)
    cool_rows, hot_rows = split_hot(passed, hot)
    lost = _lost_by_image(cool, thresholds, by)
    joined = cool_rows.join(lost, "image_id", "left")
    if by is not None:
        joined = joined.withColumn("own", F.get(F.filter("runs", lambda r: r[by] == F.col(by)), F.lit(0)))
    places = [F.col(f"lost_{i}" if by is None else f"own.lost_{i}") for i in range(len(thresholds))]
    options = F.array(*[F.struct(F.lit(t).alias("t"), place.alias("lost")) for t, place in zip(thresholds, places)])
    survives = F.coalesce(~F.array_contains(F.col("option.lost"), F.col("pos").cast("int")), F.lit(True))
    out = (
        joined
        .withColumn("option", F.explode(options))
        .where(survives)
        .select(*detections.columns, F.col("option.t").alias("nms_threshold"))
    )
    if hot is None:
        return out
    if by is not None:  # in images too big for one task, image and value together are one image
        both = F.struct("image_id", by)
        apart = suppress_sweep(hot_rows.withColumn("image_id", both), thresholds, score_threshold, limit, fold)
        return out.unionByName(apart.withColumn("image_id", F.col("image_id.image_id")))
    for t in thresholds:
        keys = _suppress_hot(hot_dets, t, hot, fold=fold)
        out = out.unionAll(
            hot_rows.join(keys, [*KEY], "left_semi").select(*detections.columns, F.lit(t).alias("nms_threshold"))
        )
    return out


def suppress(
    detections: DataFrame, iou_threshold: float = 0.4, score_threshold: float = 0.5, limit: int = LIMIT, fold: int = FOLD
) -> DataFrame:
    """Survivors at one threshold, all columns kept."""
    return suppress_sweep(detections, [iou_threshold], score_threshold, limit, fold).drop("nms_threshold")


def suppress_array(dets: Column, iou: float = 0.4, score: float = 0.5) -> Column:
    """The same result on one row's array of ``struct<pos,x,y,w,h,score,...>``; for frame streams.

    One frame is one row here, as the source delivers it, so no shuffle is needed.
    """
    passed = F.filter(dets, lambda d: above(d["score"], score))
    ordered = F.array_sort(
        passed,
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .otherwise(F.sign(b["pos"] - a["pos"]).cast("int")),
    )

    def step(kept: Column, d: Column) -> Column:
        clash = F.exists(kept, lambda k: iou_xywh([k[c] for c in BOX], [d[c] for c in BOX]) > F.lit(float(iou)))
        return F.when(clash, kept).otherwise(F.array_append(kept, d))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)

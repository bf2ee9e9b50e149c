"""Exclusive greedy matching of detections to ground truth, per image.

Detections go in ``(score desc, pos asc)`` order; each takes the free box with
the highest IoU (first box on ties) if that IoU reaches the threshold. The
class plays no part in the match; a matched row carries the box's class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions.geometry import BOX
from detframe.functions.scores import evaluation_vector
from detframe.operators.islands import FOLD, fold_islands, split_islands, taken_boxes
from detframe.operators.pairs import LIMIT, hot_images, hot_pairs, overlapping_pairs, split_hot
from detframe.operators.ranking import ranked
from detframe.session import materialize

MATCH = "array<struct<pos:int,gt_pos:int,gt_class:int,iou:double>>"


def _fold(candidates: Column) -> Column:
    """Accept a candidate pair when both its sides are free; pairs come in greedy order."""

    def step(taken: Column, c: Column) -> Column:
        used = F.exists(taken, lambda m: (m["pos"] == c["pos"]) | (m["gt_pos"] == c["gt_pos"]))
        pick = F.struct(c["pos"].alias("pos"), c["gt_pos"].alias("gt_pos"), c["gt_class"].alias("gt_class"), c["iou"].alias("iou"))
        return F.when(used, taken).otherwise(F.array_append(taken, pick))

    return F.aggregate(candidates, F.array().cast(MATCH), step)


def _match_cool(dets: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    pairs = overlapping_pairs(dets, truth, min_iou=threshold, strict=False)
    candidate = F.struct(
        (-F.col("l_score")).alias("by_score"), F.col("l_pos").cast("int").alias("pos"), (-F.col("iou")).alias("by_iou"),
        F.col("r_pos").cast("int").alias("gt_pos"), F.col("r_class_id").cast("int").alias("gt_class"), "iou",
    )
    grouped = pairs.groupBy("image_id").agg(F.array_sort(F.collect_list(candidate)).alias("c"))
    return grouped.select("image_id", F.explode(_fold(F.col("c"))).alias("m")).select("image_id", "m.*")


def _wins(score: str, pos: str) -> Column:
    """The detection in ``score, pos`` may take the box: it is free or held by a lower detection."""
    better = F.col(score) > F.col("r_h_score")
    tie = (F.col(score) == F.col("r_h_score")) & (F.col(pos) < F.col("r_h_pos"))
    return F.col("r_h_pos").isNull() | better | tie


def _proposals(asking: DataFrame, boxes: DataFrame, threshold: float, hot: DataFrame) -> DataFrame:
    """One round of proposals of the open detections.

    Exact copies of a box share one preference list, so copies are joined once,
    as their best detection. A lone detection proposes to its first available
    box. Among copies the i-th detection proposes to the i-th box of the list:
    the boxes before it go to better copies or are held by better detections,
    so they would turn it down anyway. A pile of copies thus settles at once.
    """
    top = F.max(F.struct("score", (-F.col("pos")).alias("order"))).alias("top")
    groups = asking.groupBy("image_id", *BOX).agg(F.count("*").alias("copies"), top)
    lead = groups.select(
        "image_id", *BOX, "copies", F.col("top.score").alias("score"), (-F.col("top.order")).cast("int").alias("pos")
    )
    pairs = hot_pairs(lead, boxes, hot, lambda: _wins("l_score", "l_pos"), threshold, strict=False)
    best = F.max(F.struct("iou", (-F.col("r_pos")).alias("order"), "r_pos", "r_class_id")).alias("b")
    lone = (
        pairs.where(F.col("l_copies") == 1)
        .groupBy("image_id", F.col("l_pos").alias("pos"), F.col("l_score").alias("score")).agg(best)
        .select("image_id", "pos", "score", F.col("b.r_pos").alias("gt_pos"),
                F.col("b.r_class_id").cast("int").alias("gt_class"), F.col("b.iou").alias("iou"))
    )
    crowded = lead.where(F.col("copies") > 1).select("image_id", *BOX, F.col("pos").alias("lead"))
    if crowded.isEmpty():
        return lone
    listed = pairs.where(F.col("l_copies") > 1).select(
        "image_id", F.col("l_pos").alias("lead"), "iou", "r_pos", "r_class_id", "r_h_score", "r_h_pos"
    )
    listed = ranked(listed, ["image_id", "lead"], [F.col("iou").desc(), F.col("r_pos")], "place")
    members = asking.join(crowded, ["image_id", *BOX]).select("image_id", "lead", "pos", "score")
    members = ranked(members, ["image_id", "lead"], [F.col("score").desc(), F.col("pos")], "place")
    many = members.join(listed, ["image_id", "lead", "place"]).where(_wins("score", "pos"))
    return lone.unionAll(
        many.select("image_id", "pos", "score", F.col("r_pos").alias("gt_pos"), F.col("r_class_id").cast("int").alias("gt_class"), "iou")
    )


def _match_hot(dets: DataFrame, truth: DataFrame, threshold: float, hot: DataFrame, fold: int = FOLD) -> DataFrame:
    """The same matching in images too big for one task: islands of candidates are folded in order, only giant ones go to rounds.

    Exact copies of a detection are paired once, as their first, and count as many candidates; so a pile of them is never spread
    over its boxes unless that fits a task.
    """
    lead = dets.groupBy("image_id", *BOX).agg(F.count("*").alias("copies"), F.min("pos").alias("pos"))
    pairs = materialize(
        hot_pairs(lead, truth, hot, min_iou=threshold, strict=False).select(
            "image_id", F.col("l_pos").alias("lead"), F.col("l_copies").alias("copies"), F.col("r_pos").alias("gt_pos"),
            F.col("r_class_id").cast("int").alias("gt_class"), "iou",
            (F.col("l_pos").cast("bigint") * 2).alias("a"), (F.col("r_pos").cast("bigint") * 2 + 1).alias("b"),
        ),
        "candidates",
    )
    small, giant = split_islands(pairs, "a", "b", F.col("copies"), fold)
    leads = lead.select("image_id", *BOX, F.col("pos").alias("lead"))
    members = materialize(dets.join(leads, ["image_id", *BOX]).select("image_id", "lead", "pos", "score"), "members")
    asked = small.join(members, ["image_id", "lead"]).select("image_id", "island", "pos", "score", "gt_pos", "gt_class", "iou")
    order = [(-F.col("score")).asc_nulls_last(), F.col("pos"), F.col("iou").desc(), F.col("gt_pos")]
    done = fold_islands(asked, order, "pos", "gt_pos", taken_boxes).select("image_id", "pos", "gt_pos", "gt_class", "iou")
    if giant is None:
        return done
    pile = members.join(giant.select("image_id", "lead"), ["image_id", "lead"], "left_semi").select("image_id", "pos")
    boxes = giant.select("image_id", F.col("gt_pos").alias("pos"))
    left = materialize(dets.join(pile, ["image_id", "pos"], "left_semi"), "dets")
    right = materialize(truth.join(boxes, ["image_id", "pos"], "left_semi"), "truth")
    return done.unionByName(_match_rounds(left, right, threshold, hot))


def _match_rounds(dets: DataFrame, truth: DataFrame, threshold: float, hot: DataFrame) -> DataFrame:
    """The same matching by rounds of proposals, for islands too big for one task.

    Each box holds its best proposer so far and releases the former holder,
    which asks again. Boxes rank detections by one common order, so the stable
    outcome is unique and equals the greedy one.
    """
    held = None
    while True:
        if held is None:
            asking = dets
            boxes = truth.withColumns({"h_score": F.lit(None).cast("double"), "h_pos": F.lit(None).cast("int")})
        else:
            asking = dets.join(held.select("image_id", "pos"), ["image_id", "pos"], "left_anti")
            holder = held.select(
                "image_id", F.col("gt_pos").alias("pos"), F.col("score").alias("h_score"), F.col("pos").alias("h_pos")
            )
            boxes = truth.join(holder, ["image_id", "pos"], "left")
        proposals = materialize(_proposals(asking, boxes, threshold, hot), "proposals")
        if proposals.isEmpty():
            break
        pool = proposals if held is None else held.unionByName(proposals)
        winner = F.max(F.struct("score", (-F.col("pos")).alias("order"), "pos", "gt_class", "iou")).alias("w")
        held = materialize(
            pool.groupBy("image_id", "gt_pos").agg(winner).select(
                "image_id", F.col("w.pos").alias("pos"), F.col("w.score").alias("score"), "gt_pos",
                F.col("w.gt_class").alias("gt_class"), F.col("w.iou").alias("iou"),
            ),
            "held",
        )
    result = proposals if held is None else held
    return result.select("image_id", "pos", "gt_pos", "gt_class", "iou")


def match_detections(
    detections: DataFrame, ground_truth: DataFrame, iou_threshold: float = 0.5, limit: int = LIMIT, fold: int = FOLD
) -> DataFrame:
    """Matched pairs ``(image_id, pos, gt_pos, gt_class, iou)``; a detection or box appears at most once."""
    dets = detections.select("image_id", F.col("pos").cast("int").alias("pos"), "score", *BOX)
    truth = ground_truth.select("image_id", F.col("pos").cast("int").alias("pos"), "class_id", *BOX)
    hot = hot_images(dets, truth, limit=limit)
    cool_d, hot_d = split_hot(dets, hot)
    cool_t, hot_t = split_hot(truth, hot)
    matched = _match_cool(cool_d, cool_t, iou_threshold)
    if hot is None:
        return matched
    return matched.unionAll(_match_hot(materialize(hot_d, "dets"), materialize(hot_t, "truth"), iou_threshold, hot, fold))


# Runs that fit a bit set of one long.
MOST_RUNS = 63


def run_mask(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Different rows of ``keys`` with ``mask``, the bits of the ``run`` numbers they occur in."""
    return rows.groupBy(*keys).agg(F.expr("bit_or(shiftleft(1L, run))").alias("mask"))


def _of_run(candidates: Column, run: int) -> Column:
    bit = F.lit(1 << run).cast("bigint")
    return F.filter(candidates, lambda c: c["mask"].bitwiseAND(bit) != 0)


def _fold_runs(
    dets: DataFrame, truth: DataFrame, runs: int, iou_threshold: float, limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """(for each ordinary image with candidates ``folded``: its matches of each run; the hot images).

    A box that several runs hold is one row with a bit set of runs and is paired once; each run folds the candidates whose both
    sides it holds. Rows are grouped and joined by image alone.
    """
    if runs > MOST_RUNS:
        raise ValueError(f"at most {MOST_RUNS} runs share one pairing")
    own = "run" in truth.columns
    every = F.lit((1 << runs) - 1).cast("bigint")
    keys = ["image_id", "pos", "score", *BOX]
    left = dets.select(*keys, every.alias("mask")) if runs == 1 else run_mask(dets, keys)
    right = run_mask(truth, ["image_id", "pos", "class_id", *BOX]) if own else truth.select("image_id", "pos", "class_id", *BOX, every.alias("mask"))
    hot = hot_images(left, right, limit=limit)
    cool_l, _ = split_hot(left, hot)
    cool_r, _ = split_hot(right, hot)
    shared = F.col("l_mask").bitwiseAND(F.col("r_mask"))
    pairs = overlapping_pairs(cool_l, cool_r, lambda: F.col("l_mask").bitwiseAND(F.col("r_mask")) != 0, iou_threshold, strict=False)
    candidate = F.struct(
        (-F.col("l_score")).alias("by_score"), F.col("l_pos").alias("pos"), (-F.col("iou")).alias("by_iou"), F.col("r_pos").alias("gt_pos"),
        F.col("r_class_id").cast("int").alias("gt_class"), "iou", shared.alias("mask"),
    )
    grouped = pairs.groupBy("image_id").agg(F.array_sort(F.collect_list(candidate)).alias("c"))
    folded = F.array(*[F.struct(F.lit(r).alias("run"), _fold(_of_run(F.col("c"), r)).alias("found")) for r in range(runs)])
    return grouped.select("image_id", folded.alias("folded")), hot


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("pos").cast("int"))


def _match_runs_hot(dets: DataFrame, truth: DataFrame, runs: int, iou_threshold: float, limit: int, hot: DataFrame) -> DataFrame:
    """Images too big for one task: run and image together are one image there."""
    spread = truth if "run" in truth.columns else truth.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    key = F.struct("image_id", "run")
    big = match_detections(
        dets.join(hot.select("image_id"), "image_id", "left_semi").withColumn("image_id", key),
        spread.join(hot.select("image_id"), "image_id", "left_semi").withColumn("image_id", key), iou_threshold, limit,
    )
    return big.select("image_id.image_id", "image_id.run", "pos", "gt_pos", "gt_class", "iou")


def match_runs(
    detections: DataFrame, ground_truth: DataFrame, runs: int, iou_threshold: float = 0.5, limit: int = LIMIT
) -> DataFrame:
    """Matches of many runs from one pairing: ``(image_id, run, pos, gt_pos, gt_class, iou)``.

    ``detections`` carry ``run``, a number from 0; so may ``ground_truth``, else all runs share it. See :func:`_fold_runs`.
    """
    dets, truth = _whole(detections), _whole(ground_truth)
    folded, hot = _fold_runs(dets, truth, runs, iou_threshold, limit)
    found = folded.select("image_id", F.explode("folded").alias("r")).select("image_id", "r.run", F.explode("r.found").alias("m")).select("image_id", "run", "m.*")
    return found if hot is None else found.unionByName(_match_runs_hot(dets, truth, runs, iou_threshold, limit, hot))


def label_runs(
    detections: DataFrame, ground_truth: DataFrame, runs: int, num_classes: int, iou_threshold: float = 0.5, eval_type: str = "combined",
    limit: int = LIMIT,
) -> DataFrame:
    """Evaluation rows of many runs with ``run``; the vectors of missed boxes stay NULL.

    The matches of an ordinary image are one row, looked up where its boxes lie, so neither vectors nor boxes are shuffled by
    position; those of hot images are joined, see :func:`label_rows`.
    """
    dets, truth = _whole(detections), _whole(ground_truth)
    folded, hot = _fold_runs(dets, truth, runs, iou_threshold, limit)
    short = F.transform("folded", lambda r: F.transform(r["found"], lambda m: F.struct(m["pos"].alias("pos"), m["gt_pos"].alias("gt_pos"), m["gt_class"].alias("gt_class"))))
    matched = materialize(folded.select("image_id", short.alias("runs")), "run-matches", "image_id")
    spread = truth if "run" in truth.columns else truth.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    cool_d, hot_d = split_hot(dets, hot)
    cool_t, hot_t = split_hot(spread, hot)
    vector = evaluation_vector(F.col("score"), F.col("cs"), F.col("class_id"), num_classes, eval_type)
    of_run = F.get("runs", F.col("run"))
    taken = F.get(F.filter(of_run, lambda m: m["pos"] == F.col("pos")), F.lit(0))["gt_class"]
    found = cool_d.join(matched, "image_id", "left").select(
        "run", "image_id", F.lit(0).alias("kind"), F.col("score").alias("det_score"), "pos", F.coalesce(taken, F.lit(-1)).alias("y_true"), vector.alias("scores")
    )
    free = ~F.coalesce(F.exists(of_run, lambda m: m["gt_pos"] == F.col("pos")), F.lit(False))
    missed = cool_t.join(matched, "image_id", "left").where(free).select(
        "run", "image_id", F.lit(1).alias("kind"), F.lit(0.0).alias("det_score"), "pos", F.col("class_id").cast("int").alias("y_true"),
        F.lit(None).cast("array<double>").alias("scores"),
    )
    rows = found.unionAll(missed)
    if hot is None:
        return rows
    matches = _match_runs_hot(dets, truth, runs, iou_threshold, limit, hot)
    return rows.unionByName(label_rows(hot_d, hot_t, matches, num_classes, eval_type, ["run"], zeros=False))


def missed_ground_truth(ground_truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Ground-truth rows no detection took."""
    taken = matches.select("image_id", F.col("gt_pos").alias("pos"))
    return ground_truth.join(taken, ["image_id", "pos"], "left_anti")


def infer_num_classes(detections: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """One row: the largest of all score-vector lengths and class ids + 1."""
    widths = detections.select(F.greatest(F.size("cs"), F.col("class_id") + 1).alias("n")).unionAll(
        ground_truth.select((F.col("class_id") + 1).alias("n"))
    )
    return widths.agg(F.coalesce(F.max("n"), F.lit(0)).cast("int").alias("num_classes"))


def evaluation_rows(
    detections: DataFrame,
    ground_truth: DataFrame,
    num_classes: int,
    iou_threshold: float = 0.5,
    eval_type: str = "combined",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per detection and per missed box: ``image_id, kind, det_score, pos, y_true, scores``.

    ``kind`` 0 is a detection (``y_true`` -1 when unmatched), 1 a missed box
    with a zero vector. ``(image_id, kind, det_score desc, pos)`` is the order
    of the rows.
    """
    rows = label_runs(detections.withColumn("run", F.lit(0)), ground_truth.drop("run"), 1, num_classes, iou_threshold, eval_type, limit)
    vector = F.when(F.col("kind") == 0, F.col("scores")).otherwise(F.array_repeat(F.lit(0.0), num_classes))
    return rows.drop("run").withColumn("scores", vector)


def label_rows(
    detections: DataFrame, ground_truth: DataFrame, matches: DataFrame, num_classes: int, eval_type: str = "combined", by=(),
    zeros: bool = True,
) -> DataFrame:
    """Evaluation rows from given matches; ``by`` names run columns carried by all three inputs.

    Without ``zeros`` the vectors of missed boxes stay NULL, which every reader takes as all zero; this keeps
    stored rows small.

    Detections and boxes are one relation keyed by (image, kind, pos), so the
    matches are joined once.
    """
    vector = evaluation_vector(F.col("score"), F.col("cs"), F.col("class_id"), num_classes, eval_type)
    nothing = F.array_repeat(F.lit(0.0), num_classes) if zeros else F.lit(None).cast("array<double>")
    head = [*by, "image_id"]
    found = detections.select(
        *head, F.lit(0).alias("kind"), F.col("score").alias("det_score"), F.col("pos").cast("int").alias("pos"),
        F.lit(-1).alias("own_class"), vector.alias("scores"),
    )
    boxes = ground_truth.select(
        *head, F.lit(1).alias("kind"), F.lit(0.0).alias("det_score"), F.col("pos").cast("int").alias("pos"),
        F.col("class_id").cast("int").alias("own_class"), nothing.alias("scores"),
    )
    sides = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("pos").alias("pos")),
        F.struct(F.lit(1).alias("kind"), F.col("gt_pos").alias("pos")),
    )
    taken = matches.select(*head, "gt_class", F.explode(sides).alias("s")).select(*head, "s.kind", "s.pos", "gt_class")
    rows = found.unionAll(boxes).join(taken, [*head, "kind", "pos"], "left")
    return rows.where((F.col("kind") == 0) | F.col("gt_class").isNull()).select(
        *head, "kind", "det_score", "pos", F.coalesce("gt_class", "own_class").alias("y_true"), "scores"
    )

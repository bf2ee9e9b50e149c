"""The path for images too large for one task, held against the ordinary oracles: nearly every image is above a limit of three."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import NUM_CLASSES
from checks.queries_boxes import as_big
from checks.queries_eval import KEPT04
from checks.queries_frames import draw, sizes
from checks.queries_profile import overlap
from checks.registry import ORACLES, duck, query
from detframe.operators import augment, match, pairs, suppress
from detframe.plans import evaluation

TINY = 3


@query("nms_hot", ORACLES["nms_0_4"])
def _(f):
    return as_big(suppress.suppress(f("fx_raw"), 0.4, limit=TINY).drop("cs"), "pos", "class_id")


@query("match_hot", ORACLES["match_detections"])
def _(f):
    return as_big(match.match_detections(f("fx_det"), f("fx_gt"), limit=TINY), "pos", "gt_pos", "gt_class")


@query("best_gt_hot", ORACLES["best_gt_per_prediction"])
def _(f):
    found = pairs.best_ground_truth(f("fx_det"), f("fx_gt"), limit=TINY)
    return as_big(found.select("image_id", "pos", "gt_pos", "iou"), "pos", "gt_pos")


@query("gt_box_pairs_hot", ORACLES["gt_box_pairs"])
def _(f):
    return as_big(pairs.box_pairs(f("fx_gt"), limit=TINY).select("image_id", "l_pos", "r_pos", "iou"), "l_pos", "r_pos")


@query("duplicate_hot", ORACLES["duplicate_pairs"])
def _(f):
    out = pairs.duplicate_pairs(f("fx_raw"), limit=TINY).select("image_id", "class_id", "l_pos", "r_pos", "iou")
    return as_big(out, "class_id", "l_pos", "r_pos")


@query("overlap_hot", ORACLES["overlap_profile"])
def _(f):
    return overlap(f, TINY)


@query("map_with_unlisted_run", duck("select 'model' model, (select avg(ap) from ap) map", ["fx_raw", "fx_det", "fx_gt", "fx_classes"], KEPT04, "map"))
def _(f):
    # detections of a run that is not asked for must not move the one that is
    kept = suppress.suppress(f("fx_raw"), 0.4).withColumn("model", F.lit("model"))
    stray = f("fx_raw2").withColumn("model", F.lit("other"))
    both = kept.unionByName(stray).withColumn("image_id", F.col("image_id") + F.lit(2**61))
    truth = f("fx_gt").withColumn("image_id", F.col("image_id") + F.lit(2**61))
    return evaluation.evaluate_runs(both, truth, f("fx_classes"), NUM_CLASSES, "model", ["model"])[0].select("model", "map")


NAMES = ("vertical_flip", "gaussian_blur", "change_brightness", "resize")
RESIZED = (
    "plan as materialized (select image_id, list_transform(list_sort(["
    + ", ".join(f"struct_pack(k := {draw(i)}, i := {i}, n := '{n}')" for i, n in enumerate(NAMES))
    + f"])[1:1 + {draw(4)} % 3], lambda e: e.n) chain from fx_images)"
)


@query("pixels_augmented_resize", duck(
    "select image_id, count(*) * case when list_contains(any_value(chain), 'resize') then 4 else 1 end pixels from fx_pixels join plan using (image_id) group by image_id",
    ["fx_pixels", "fx_images"], [RESIZED]))
def _(f):
    plan = augment.augment_plan(f("fx_images"), 7, include_resize=True)
    out = augment.apply_plan(f("fx_pixels"), sizes(f), plan, scale=2.0, as_lines=True)
    return out.groupBy("image_id").agg(F.sum(F.size("vals")).alias("pixels"))

"""Matching, curves, AP, model / threshold / condition comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import NUM_CLASSES
from checks.queries_boxes import NORM, as_big, norm_boxes
from checks.registry import ORACLES, cte_ap, cte_curve, cte_match, cte_nms, cte_rows, duck, iou, query
from detframe.functions.conditions import CONDITIONS
from detframe.operators import compare, curves, match, profile, suppress
from detframe.plans import evaluation, reports, robustness, sweep
from detframe.session import materialize

DET = "det as (select 0 g, * from fx_det)"
GT = "gt as (select 0 g, * from fx_gt)"
BASE = [DET, GT]
PLAIN = [*BASE, *cte_match("det", "gt"), *cte_rows("det", "gt")]
FX = ["fx_det", "fx_gt", "fx_images", "fx_classes"]


def stored_rows(f):
    return materialize(match.evaluation_rows(f("fx_det"), f("fx_gt"), NUM_CLASSES), "eval-rows")


@query("match_detections", duck(
    "select image_id, cast(pos as bigint) pos, cast(gt_pos as bigint) gt_pos, cast(gt_class as bigint) gt_class, iou from m",
    FX, [*BASE, *cte_match("det", "gt")], "iou"))
def _(f):
    return as_big(match.match_detections(f("fx_det"), f("fx_gt")), "pos", "gt_pos", "gt_class")


@query("missed_ground_truth", duck(
    "select b.image_id, cast(b.pos as bigint) pos from fx_gt b where not exists (select 1 from m where m.image_id = b.image_id and m.gt_pos = b.pos)",
    FX, [*BASE, *cte_match("det", "gt")]))
def _(f):
    found = match.match_detections(f("fx_det"), f("fx_gt"))
    return as_big(match.missed_ground_truth(f("fx_gt"), found).select("image_id", "pos"), "pos")


@query("eval_rows", duck(
    "select image_id, cast(kind as bigint) kind, cast(pos as bigint) pos, cast(y_true as bigint) y_true, list_sum(scores) total, list_max(scores) best from er",
    FX, PLAIN, "total best"))
def _(f):
    rows = match.evaluation_rows(f("fx_det"), f("fx_gt"), NUM_CLASSES)
    total = F.aggregate("scores", F.lit(0.0), lambda s, v: s + v)
    return as_big(rows.select("image_id", "kind", "pos", "y_true", total.alias("total"), F.array_max("scores").alias("best")),
                  "kind", "pos", "y_true")


@query("infer_num_classes", duck(
    "select cast(greatest((select max(greatest(len(cs), class_id + 1)) from fx_det), (select max(class_id + 1) from fx_gt)) as bigint) num_classes", FX))
def _(f):
    return as_big(match.infer_num_classes(f("fx_det"), f("fx_gt")), "num_classes")


@query("eval_inputs", duck(
    "select i.image_id, coalesce(d.n, 0) detections, coalesce(b.n, 0) boxes, coalesce(d.s, 0) score_sum from fx_images i "
    "left join (select image_id, count(*) n, sum(score) s from fx_det group by 1) d using (image_id) "
    "left join (select image_id, count(*) n from fx_gt group by 1) b using (image_id)", FX, (), "score_sum"))
def _(f):
    # What the nested lists of an image hold, as counts; images without rows keep an empty entry.
    zero = F.lit(0).cast("bigint")
    det = f("fx_det").groupBy("image_id").agg(F.count("*").alias("detections"), F.sum("score").alias("score_sum"))
    box = f("fx_gt").groupBy("image_id").agg(F.count("*").alias("boxes"))
    out = f("fx_images").select("image_id").join(det, "image_id", "left").join(box, "image_id", "left")
    return out.withColumns({"detections": F.coalesce("detections", zero), "boxes": F.coalesce("boxes", zero),
                            "score_sum": F.coalesce("score_sum", F.lit(0.0))})


@query("eval_lists", duck(
    "select k.image_id, cast(k.chunk as bigint) chunk, coalesce(dets, '') dets, coalesce(boxes, '') boxes from k left join d using (image_id, chunk) left join b using (image_id, chunk)", FX, [
        "d as (select image_id, pos // 4 chunk, string_agg(pos || ':' || class_id, ',' order by pos) dets from fx_det group by all)",
        "b as (select image_id, pos // 4 chunk, string_agg(pos || ':' || class_id, ',' order by pos) boxes from fx_gt group by all)",
        "k as (select image_id, 0 chunk from fx_images union select image_id, chunk from d union select image_id, chunk from b)",
    ]))
def _(f):
    text = lambda n: F.array_join(F.transform(n, lambda e: F.concat_ws(":", e["pos"], e["class_id"])), ",")
    rows = reports.image_lists(f("fx_images"), f("fx_det"), f("fx_gt"), chunk=4)
    return rows.select("image_id", "chunk", text("detections").alias("dets"), text("boxes").alias("boxes"))


@query("pr_curve", duck(
    "select cast(class_id as bigint) class_id, rnk \"rank\", prec \"precision\", recall, threshold from pr",
    FX, [*PLAIN, *cte_curve()], "\"precision\" recall threshold"))
def _(f):
    rows = match.evaluation_rows(f("fx_det"), f("fx_gt"), NUM_CLASSES)
    points = curves.pr_curve(rows, NUM_CLASSES)
    return as_big(points.select("class_id", "rank", "precision", "recall", "threshold"), "class_id", "rank")


@query("ap_per_class", duck("select cast(class_id as bigint) class_id, class_name, ap from ap", FX, [*PLAIN, *cte_curve(), *cte_ap()], "ap"))
def _(f):
    return as_big(curves.average_precision_of(stored_rows(f), f("fx_classes"), NUM_CLASSES), "class_id")


@query("map_score", duck("select avg(ap) map from ap", FX, [*PLAIN, *cte_curve(), *cte_ap()], "map"))
def _(f):
    return curves.mean_average_precision(curves.average_precision_of(stored_rows(f), f("fx_classes"), NUM_CLASSES))


EMB = (
    "er as materialized (select 0 g, cast(vec_id as bigint) image_id, 0 kind, cast(0 as double) det_score, 0 pos, cast(label as int) y_true, "
    "list_transform(embedding, lambda v: cast(v as double)) || list_transform(range(20), lambda i: cast(0 as double)) scores from embeddings)"
)


@query("ap_embeddings", duck(
    "select cast(class_id as bigint) class_id, class_name, ap from ap", ["fx_classes"], [EMB, *cte_curve(), *cte_ap()], "ap"))
def _(f):
    # A wide score table with negative scores, cut to the number of classes.
    emb = f.table("embeddings")
    rows = emb.select(
        F.col("vec_id").cast("bigint").alias("image_id"), F.lit(0).alias("kind"), F.lit(0.0).alias("det_score"), F.lit(0).alias("pos"),
        F.col("label").cast("int").alias("y_true"), F.col("embedding").cast("array<double>").alias("scores"))
    return as_big(curves.average_precision_of(materialize(rows, "eval-rows"), f("fx_classes"), NUM_CLASSES), "class_id")


@query("per_class_counts", duck(
    "select cast(k.class_id as bigint) class_id, k.class_name, coalesce(b.n, 0) ground_truth_count, coalesce(d.n, 0) prediction_count from fx_classes k "
    "left join (select class_id, count(*) n from fx_gt group by 1) b using (class_id) left join (select class_id, count(*) n from fx_det group by 1) d using (class_id)", FX))
def _(f):
    return as_big(compare.per_class_counts(f("fx_classes"), f("fx_det"), f("fx_gt")), "class_id")


# ---- one model, two models ---------------------------------------------------

KEPT04 = [*cte_nms([0.4]), "det as (select 0 g, k.* exclude (t) from kept k)", GT, *cte_match("det", "gt"), *cte_rows("det", "gt"), *cte_curve(), *cte_ap()]


@query("evaluation_summary", duck(
    "select (select avg(ap) from ap) map, (select count(*) from fx_gt) ground_truth, (select count(*) from det) predictions, "
    "(select count(*) from er) evaluation_rows, cast(0.5 as double) score_threshold, cast(0.4 as double) nms_threshold, cast(0.5 as double) map_iou_threshold, 'combined' eval_type",
    FX, KEPT04, "map"))
def _(f):
    return evaluation.evaluate_model(f("fx_raw"), f("fx_gt"), f("fx_classes"), NUM_CLASSES)[0]


@query("evaluate_model", duck(
    "select cast(a.class_id as bigint) class_id, a.class_name, a.ap, coalesce(b.n, 0) ground_truth_count, coalesce(d.n, 0) prediction_count from ap a "
    "left join (select class_id, count(*) n from fx_gt group by 1) b using (class_id) left join (select class_id, count(*) n from det group by 1) d using (class_id)",
    FX, KEPT04, "ap"))
def _(f):
    return as_big(evaluation.evaluate_model(f("fx_raw"), f("fx_gt"), f("fx_classes"), NUM_CLASSES)[1], "class_id")


def by_file(f, name: str):
    """A relation with the image file's name as its image key."""
    named = f("fx_images").select("image_id", "image_file")
    return f(name).join(named, "image_id").drop("image_id").withColumnRenamed("image_file", "image_id")


@query("evaluate_model_by_file", ORACLES["evaluate_model"])
def _(f):
    return as_big(evaluation.evaluate_model(by_file(f, "fx_raw"), by_file(f, "fx_gt"), f("fx_classes"), NUM_CLASSES)[1], "class_id")


MODELS = [
    "det1 as (select * from fx_raw where score > 0.5)", "det2 as (select * from fx_raw2 where score > 0.5)",
    *cte_nms([0.4], "det1", "ka"), *cte_nms([0.4], "det2", "kb"),
    "det as (select 'model1' g, k.* exclude (t) from ka k union all select 'model2', k.* exclude (t) from kb k)",
    "gt as (select m.g, b.* from fx_gt b, (values ('model1'), ('model2')) m(g))",
    *cte_match("det", "gt"), *cte_rows("det", "gt"), *cte_curve(), *cte_ap(),
]


@query("model_comparison", duck(
    "select cast(a.class_id as bigint) class_id, a.class_name, coalesce(n.n, 0) ground_truth_count, a.ap model1_ap, b.ap model2_ap, b.ap - a.ap ap_difference, "
    "case when b.ap - a.ap > 0 then 'model2' when b.ap - a.ap < 0 then 'model1' else 'tie' end better_model from ap a join ap b on a.class_id = b.class_id and a.g = 'model1' and b.g = 'model2' "
    "left join (select class_id, count(*) n from fx_gt group by 1) n on n.class_id = a.class_id",
    ["fx_raw", "fx_raw2", "fx_gt", "fx_classes"], MODELS, "model1_ap model2_ap ap_difference"))
def _(f):
    report = reports.compare_models({"model1": f("fx_raw"), "model2": f("fx_raw2")}, f("fx_gt"), f("fx_classes"), NUM_CLASSES)
    return as_big(report.comparison, "class_id")


# ---- threshold sweep ---------------------------------------------------------

TS = suppress.SWEEP_THRESHOLDS
SWEPT = [
    *cte_nms(TS), "det as (select t g, k.* exclude (t) from kept k)", "gt as (select t g, b.* from fx_gt b, kept_thr)",
    *cte_match("det", "gt"), *cte_rows("det", "gt"), *cte_curve(), *cte_ap(groups="select t g from kept_thr"),
]


def swept(f):
    return sweep.threshold_sweep(f("fx_raw"), f("fx_gt"), f("fx_classes"), NUM_CLASSES)


DUP = [
    f"dup as (select g, image_id, count(*) n from (select a.g, a.image_id, {iou('a.', 'b.')} iou from det a join det b on a.g = b.g and a.image_id = b.image_id "
    "and a.class_id = b.class_id and a.pos < b.pos) where iou > 0.5 group by all)",
    "seen as (select g, count(distinct image_id) images from det group by g)",
    "dups as (select s.g, coalesce(cast(sum(d.n) as bigint), 0) duplicate_pairs, count(d.image_id) images_with_pairs, "
    "coalesce(sum(d.n), 0) / cast(any_value(s.images) as double) mean_pairs_per_image from seen s left join dup d on d.g = s.g group by s.g)",
]


@query("duplicate_summary", duck(
    "select g nms_threshold, duplicate_pairs, images_with_pairs, mean_pairs_per_image from dups",
    FX, [*cte_nms(TS), "det as (select t g, k.* exclude (t) from kept k)", *DUP], "nms_threshold mean_pairs_per_image"))
def _(f):
    return sweep.duplicate_summary(materialize(suppress.suppress_sweep(f("fx_raw")), "swept", "image_id"))


SUMMARY = [
    "summary as (select t g, (select avg(ap) from ap where ap.g = t) map, (select count(*) from gt where gt.g = t) ground_truth, "
    "(select count(*) from det where det.g = t) predictions, (select count(*) from er where er.g = t) evaluation_rows from kept_thr)"
]


@query("nms_sweep_summary", duck(
    "select s.g nms_threshold, s.map, s.ground_truth, s.predictions, s.evaluation_rows, d.duplicate_pairs, d.images_with_pairs, d.mean_pairs_per_image from summary s join dups d on d.g = s.g",
    FX, [*SWEPT, *DUP, *SUMMARY], "nms_threshold map mean_pairs_per_image"))
def _(f):
    return swept(f)[1]


@query("threshold_sensitivity", duck(
    "select a.g nms_threshold, count(*) filter (a.ap - b.ap > 0) improved, count(*) filter (a.ap - b.ap = 0) unchanged, count(*) filter (a.ap - b.ap < 0) worsened "
    "from (select g, class_id, round(ap, 12) ap from ap) a join (select g, class_id, round(ap, 12) ap from ap) b on a.class_id = b.class_id and b.g = 0.5 where a.g in (0.55, 0.6) group by a.g",
    FX, SWEPT, "nms_threshold"))
def _(f):
    per_class = swept(f)[2].withColumn("ap", F.round("ap", 12))
    return compare.threshold_sensitivity(per_class, 0.5, [0.55, 0.6])


@query("threshold_decision", duck(
    "select s.g nms_threshold, s.map, s.map - r.map map_change, s.predictions, s.predictions - r.predictions prediction_change, d.duplicate_pairs, d.images_with_pairs "
    "from summary s join dups d on d.g = s.g join summary r on r.g = 0.5 where s.g >= 0.5",
    FX, [*SWEPT, *DUP, *SUMMARY], "nms_threshold map map_change"))
def _(f):
    return sweep.threshold_decision(swept(f)[1], 0.5)


CROWDED = (
    f"crowded as (select distinct image_id from (select a.image_id, {iou('a.', 'b.')} iou from fx_gt a join fx_gt b on a.image_id = b.image_id and a.pos < b.pos) where iou > 0.1)"
)


@query("crowded_subset", duck("select image_id from crowded", ["fx_gt"], [CROWDED]))
def _(f):
    return profile.crowded_images(profile.overlap_profile(f("fx_images").select("image_id"), f("fx_gt")))


SUBSETS = ("all_selected", "crowded_any_overlap")


def subset_text() -> tuple[list[str], str]:
    """Both subsets as runs of one evaluation: the key is (subset, threshold)."""
    chosen = "chosen as materialized (select 'all_selected' s, image_id from fx_images union all select 'crowded_any_overlap', image_id from crowded)"
    det = "det as (select c.s || ' ' || t g, k.* exclude (t) from kept k join chosen c using (image_id))"
    gt = "gt as (select c.s || ' ' || t g, b.* from fx_gt b join chosen c using (image_id), kept_thr)"
    runs = "runs as (select s || ' ' || t g, s, t from kept_thr, (select distinct s from chosen))"
    summary = (
        "summary as (select g, s, t, (select avg(ap) from ap where ap.g = runs.g) map, (select count(*) from gt where gt.g = runs.g) ground_truth, "
        "(select count(*) from det where det.g = runs.g) predictions, (select count(*) from er where er.g = runs.g) evaluation_rows from runs)"
    )
    ctes = [CROWDED, *cte_nms(TS), chosen, runs, det, gt, *cte_match("det", "gt"), *cte_rows("det", "gt"), *cte_curve(), *cte_ap(groups="select g from runs"), *DUP, summary]
    return ctes, (
        "select s subset_name, (select count(*) from chosen c where c.s = summary.s) images, t nms_threshold, map, ground_truth, predictions, evaluation_rows, "
        "duplicate_pairs, images_with_pairs, mean_pairs_per_image from summary join dups d using (g)"
    )


@query("subset_summary", duck(subset_text()[1], [*FX, "fx_images"], subset_text()[0], "nms_threshold map mean_pairs_per_image"))
def _(f):
    crowded = profile.crowded_images(profile.overlap_profile(f("fx_images").select("image_id"), f("fx_gt")))
    kept = materialize(suppress.suppress_sweep(f("fx_raw")), "swept", "image_id")
    return sweep.subset_summary(kept, f("fx_gt"), f("fx_classes"), NUM_CLASSES, f("fx_images"), {"crowded_any_overlap": crowded})


# ---- conditions --------------------------------------------------------------

TAGS = [c[0] for c in CONDITIONS]
# No model runs here, so the conditions shift the scores by a fixed amount per condition.
SHIFT = "case c.ord when 0 then score when 1 then score - 0.15 when 2 then score - 0.25 when 3 then score - 0.02 else score - 0.05 end"
CONDS = "conds(condition, ord) as (values ('original', 0), ('gaussian_blur_k9', 1), ('vertical_flip', 2), ('brightness_increase', 3), ('brightness_decrease', 4))"
COND_KEPT = [
    CONDS,
    f"cdet as materialized (select * from (select image_id * 5 + c.ord image_id, c.condition, r.pos, r.class_id, r.x, r.y, r.w, r.h, {SHIFT} score, r.cs from fx_raw r, conds c) where score > 0.5)",
    *cte_nms([0.5], "cdet"),
]
COND = [
    *COND_KEPT, "det as (select condition g, k.* exclude (t, condition) from kept k)",
    "gt as (select c.condition g, b.image_id * 5 + c.ord image_id, b.pos, b.class_id, b.x, case when c.ord = 2 then 480 - b.y - b.h else b.y end y, b.w, b.h from fx_gt b, conds c)",
    *cte_match("det", "gt"), *cte_rows("det", "gt"), *cte_curve(), *cte_ap(groups="select condition g from conds"),
    "summary as (select condition g, ord, (select avg(ap) from ap where ap.g = condition) map, (select count(*) from gt where gt.g = condition) ground_truth, "
    "(select count(*) from det where det.g = condition) predictions, (select count(*) from er where er.g = condition) evaluation_rows from conds)",
]


def condition_raw(f):
    from detframe.functions.conditions import condition_array

    by = F.col("_k.condition_order")
    s = F.col("score")
    shifted = (
        F.when(by == 0, s).when(by == 1, s - 0.15).when(by == 2, s - 0.25).when(by == 3, s - 0.02).otherwise(s - 0.05)
    )
    raw = f("fx_raw").withColumn("_k", F.explode(condition_array())).withColumns({"score": shifted, "condition": F.col("_k.condition")})
    return raw.drop("_k")


def conditions(f):
    return robustness.condition_robustness(condition_raw(f), norm_boxes(f), f("fx_images"), f("fx_classes"), NUM_CLASSES, clip=False)


COND_EXACT = [c.replace(
    "b.x, case when c.ord = 2 then 480 - b.y - b.h else b.y end y, b.w, b.h from fx_gt b, conds c",
    f"b.cx*640 - b.w*640/2 x, case when c.ord = 2 then 480 - (b.cy*480 - b.h*480/2) - b.h*480 else b.cy*480 - b.h*480/2 end y, b.w*640 w, b.h*480 h from ({NORM}) b, conds c")
    for c in COND]


@query("nms_by_condition", duck(
    "select condition, image_id // 5 image_id, cast(pos as bigint) pos, score from kept", FX, COND_KEPT, "score"))
def _(f):
    kept = robustness.suppress_by(condition_raw(f), "condition", 0.5)
    return as_big(kept.select("condition", "image_id", "pos", "score"), "pos")


@query("condition_change", duck(
    "select s.g condition, s.map, s.ground_truth, s.predictions, s.evaluation_rows, s.map - r.map map_change, case when r.map <> 0 then (s.map - r.map) / r.map * 100 else 0 end map_percent_change, "
    "s.predictions - r.predictions prediction_change from summary s join summary r on r.g = 'original'", FX, COND_EXACT, "map map_change map_percent_change"))
def _(f):
    return conditions(f)[1]


AP_CHANGE = "select a.g condition, a.class_id, a.class_name, a.ap, r.ap reference_ap, a.ap - r.ap ap_change from ap a left join ap r on r.class_id = a.class_id and r.g = 'original'"


@query("ap_change_vs_baseline", duck(
    f"select condition, cast(class_id as bigint) class_id, class_name, ap, reference_ap, ap_change from ({AP_CHANGE})", FX, COND_EXACT, "ap reference_ap ap_change"))
def _(f):
    return as_big(conditions(f)[2].drop("ground_truth_count", "prediction_count"), "class_id")


@query("largest_ap_drops", duck(
    f"select condition, cast(class_id as bigint) class_id, round(ap_change, 9) ap_change from ({AP_CHANGE}) where condition <> 'original' order by round(ap_change, 9), condition, class_id limit 15",
    FX, COND_EXACT, "ap_change"))
def _(f):
    changes = conditions(f)[2].withColumn("ap_change", F.round("ap_change", 9))
    return as_big(compare.largest_drops(changes, "condition", "original").select("condition", "class_id", "ap_change"), "class_id")


@query("condition_ordered", duck(
    "select cast(ord as bigint) condition_order, condition, count(*) predictions from cdet join conds using (condition) group by all", FX, COND_KEPT))
def _(f):
    from detframe.functions.conditions import condition_array

    by, s = F.col("_k.condition_order"), F.col("score")
    shifted = F.when(by == 0, s).when(by == 1, s - 0.15).when(by == 2, s - 0.25).when(by == 3, s - 0.02).otherwise(s - 0.05)
    rows = f("fx_raw").select("score", F.explode(condition_array()).alias("_k")).where(shifted > 0.5)
    out = rows.groupBy(F.col("_k.condition_order").cast("bigint").alias("condition_order"), F.col("_k.condition").alias("condition")).agg(
        F.count("*").alias("predictions"))
    return out.orderBy("condition_order")

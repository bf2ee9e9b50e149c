"""Loss components and hard-example ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_boxes import as_big
from checks.queries_profile import INDEX, index
from checks.registry import duck, iou, query
from detframe.operators import loss, mining
from detframe.plans import reports
from detframe.plans.miner import HardNegativeMiner
from detframe.session import materialize

FX = ["fx_det", "fx_gt", "fx_images", "fx_classes"]
COMPONENTS = "loc_loss conf_loss_obj conf_loss_noobj class_loss"
COMP = [
    *INDEX,
    f"pairs as (select d.image_id, d.pos, g.pos gt_pos, {iou('d.', 'g.')} iou from fx_det d join fx_gt g on d.image_id = g.image_id)",
    "best as materialized (select image_id, pos, arg_max(gt_pos, (iou, -gt_pos)) gt_pos from pairs where iou >= 0.5 group by all)",
    "box as materialized (select d.image_id, g.pos gt_pos, case when g.pos is null then 0 else 1 end hit, "
    "case when g.pos is null then 0 else (d.x-g.x)*(d.x-g.x) + (d.y-g.y)*(d.y-g.y) + (d.x+d.w-g.x-g.w)*(d.x+d.w-g.x-g.w) + (d.y+d.h-g.y-g.h)*(d.y+d.h-g.y-g.h) end loc, "
    "case when g.pos is null then 0 else (1-d.score)*(1-d.score) end obj, case when g.pos is null then d.score*d.score else 0 end noobj, "
    "case when g.pos is null then 0 else (1-coalesce(d.cs[g.class_id+1], 0))*(1-coalesce(d.cs[g.class_id+1], 0)) end cls "
    "from fx_det d left join best b on b.image_id = d.image_id and b.pos = d.pos left join fx_gt g on g.image_id = b.image_id and g.pos = b.gt_pos)",
    "agg as (select image_id, sum(loc) loc, sum(obj) obj, sum(noobj) noobj, sum(cls) cls, count(*) n, cast(sum(hit) as bigint) m, count(distinct gt_pos) gm from box group by 1)",
    "comp as materialized (select i.image_id, i.image_file, i.num_objects, i.density_bucket, round(coalesce(loc, 0), 6) loc_loss, round(coalesce(obj, 0), 6) conf_loss_obj, "
    "round(coalesce(noobj, 0), 6) conf_loss_noobj, round(coalesce(cls, 0), 6) class_loss, coalesce(n, 0) raw_prediction_count, i.num_objects ground_truth_count, coalesce(m, 0) matched_prediction_count, "
    "coalesce(n, 0) - coalesce(m, 0) false_positive_prediction_count, coalesce(gm, 0) matched_gt_count, i.num_objects - coalesce(gm, 0) missed_gt_count from idx i left join agg a using (image_id))",
]


def components(f, stored: bool = True):
    """The component table, rounded to six digits as it is stored."""
    images = index(f).drop("class_ids_present")
    table = loss.loss_components(images, f("fx_det"), f("fx_gt"))
    table = table.withColumns({c: F.round(c, 6) for c in loss.COMPONENTS})
    return materialize(table, "components") if stored else table


@query("image_loss_components", duck("select * from comp", FX, COMP, COMPONENTS))
def _(f):
    return components(f, stored=False).drop("class_names_present")


@query("total_loss", duck(
    f"select image_id, 0.5*loc_loss + 0.5*conf_loss_obj + 0.5*conf_loss_noobj + 0.5*class_loss total_loss from comp", FX, COMP, "total_loss"))
def _(f):
    return loss.total_loss(components(f, stored=False)).select("image_id", "total_loss")


LONG = (
    "long as (select image_id, unnest(['loc_loss', 'conf_loss_obj', 'conf_loss_noobj', 'class_loss', 'raw_prediction_count', 'ground_truth_count', 'matched_prediction_count', "
    "'false_positive_prediction_count', 'matched_gt_count', 'missed_gt_count']) component, unnest([loc_loss, conf_loss_obj, conf_loss_noobj, class_loss, cast(raw_prediction_count as double), "
    "cast(ground_truth_count as double), cast(matched_prediction_count as double), cast(false_positive_prediction_count as double), cast(matched_gt_count as double), cast(missed_gt_count as double)]) \"value\" from comp)"
)


@query("component_describe", duck(
    "select component, count(*) n, avg(\"value\") mean, stddev_samp(\"value\") std, min(\"value\") min, max(\"value\") max, quantile_cont(\"value\", 0.25) q25, quantile_cont(\"value\", 0.5) q50, "
    "quantile_cont(\"value\", 0.75) q75 from long group by 1", FX, [*COMP, LONG], "mean std min max q25 q50 q75"))
def _(f):
    return loss.describe_components(components(f))


@query("component_nonzero", duck(
    "select component, count(*) filter (\"value\" > 0) nonzero from long where component like '%loss%' group by 1", FX, [*COMP, LONG]))
def _(f):
    return loss.nonzero_components(components(f, stored=False))


SCALES = (
    "scales as materialized (select component, case when quantile_cont(\"value\", 0.95) > 0 then quantile_cont(\"value\", 0.95) else 1 end \"scale\", avg(\"value\") mean "
    "from long where component like '%loss%' group by 1)"
)


@query("component_scales", duck("select * from scales", FX, [*COMP, LONG, SCALES], "\"scale\" mean"))
def _(f):
    return loss.component_scales(components(f))


@query("zero_prediction_profile", duck(
    "select count(*) images, avg(ground_truth_count) mean_gt, max(ground_truth_count) max_gt, median(ground_truth_count) median_gt from comp where raw_prediction_count = 0",
    FX, COMP, "mean_gt median_gt"))
def _(f):
    return loss.zero_prediction_profile(components(f))


@query("false_negative_images", duck(
    "select image_id, ground_truth_count from comp where raw_prediction_count = 0 and ground_truth_count > 0 order by ground_truth_count desc, image_id limit 50", FX, COMP))
def _(f):
    return loss.false_negative_images(components(f, stored=False), 50)


@query("hard_negatives", duck(
    "select image_id, total_loss from (select image_id, 0.5*loc_loss + 0.5*conf_loss_obj + 0.5*conf_loss_noobj + 0.5*class_loss total_loss from comp) order by total_loss desc, image_id limit 50",
    FX, COMP, "total_loss"))
def _(f):
    return HardNegativeMiner(components(f, stored=False)).hardest(50, "total_loss").select("image_id", "total_loss")


@query("top10_by_component", duck(
    "select component, \"rank\", image_id, \"value\" from (select component, image_id, \"value\", row_number() over (partition by component order by \"value\" desc, image_id) \"rank\" "
    "from long where component like '%loss%' or component = 'missed_gt_count') where \"rank\" <= 10", FX, [*COMP, LONG], "\"value\""))
def _(f):
    return as_big(mining.top_by_component(components(f, stored=False)), "rank")


# ---- weighted runs ------------------------------------------------------------

VALUES = ", ".join(f"('{n}', '{d}', {a}, {b}, {c}, {e}, '{fam}')" for n, d, a, b, c, e, fam in mining.CONFIGS)
RUNS = (
    f"cfg as (select config_name, display_name, cast(lc as double) lambda_coord, cast(lo as double) lambda_obj, cast(ln as double) lambda_noobj, cast(lk as double) lambda_cls, family "
    f"from (values {VALUES}) v(config_name, display_name, lc, lo, ln, lk, family))"
)


def scale(name: str) -> str:
    return f"case when mode = 'raw' then {name} else {name} / (select \"scale\" from scales where component = '{name}') end"


SCORED = [
    *COMP, LONG, SCALES, RUNS,
    f"contrib as materialized (select c.*, g.*, mode score_mode, lambda_coord * {scale('loc_loss')} contrib_loc, lambda_obj * {scale('conf_loss_obj')} contrib_obj, "
    f"lambda_noobj * {scale('conf_loss_noobj')} contrib_noobj, lambda_cls * {scale('class_loss')} contrib_cls from comp c, cfg g, (values ('raw'), ('normalized')) m(mode))",
    "scored as materialized (select *, contrib_loc + contrib_obj + contrib_noobj + contrib_cls hnm_score, case when contrib_loc >= contrib_obj and contrib_loc >= contrib_noobj and contrib_loc >= contrib_cls then 'Localization' "
    "when contrib_obj >= contrib_noobj and contrib_obj >= contrib_cls then 'Objectness' when contrib_noobj >= contrib_cls then 'No-object' else 'Classification' end dominant_contribution from contrib)",
]
TOP = [
    *SCORED,
    "top as materialized (select * from (select *, row_number() over (partition by score_mode, config_name order by hnm_score desc, image_file) rnk from scored) where rnk <= 250)",
]


def scored(f):
    table = components(f)
    return mining.scored_runs(table, materialize(loss.component_scales(table), "scales"))


def top(f):
    return materialize(mining.top_images(scored(f)), "top")


def sweep(f):
    return reports.sweep_weightings(f("fx_images").select("image_id", "image_file"), f("fx_det"), f("fx_gt"), f("fx_classes"))


@query("hnm_scores", duck("select score_mode, config_name, image_id, hnm_score from scored", FX, SCORED, "hnm_score"))
def _(f):
    return scored(f).select("score_mode", "config_name", "image_id", "hnm_score")


@query("hnm_contributions", duck(
    "select score_mode, config_name, image_id, contrib_loc, contrib_obj, contrib_noobj, contrib_cls, dominant_contribution from scored", FX, SCORED, "contrib_loc contrib_obj contrib_noobj contrib_cls"))
def _(f):
    return scored(f).select("score_mode", "config_name", "image_id", *mining.CONTRIBUTIONS, "dominant_contribution")


@query("hnm_top_n", duck("select score_mode, config_name, rnk \"rank\", image_id, hnm_score from top", FX, TOP, "hnm_score"))
def _(f):
    return as_big(mining.top_images(scored(f)).select("score_mode", "config_name", "rank", "image_id", "hnm_score"), "rank")


MEANS = ("num_objects", "raw_prediction_count", "matched_prediction_count", "false_positive_prediction_count", "missed_gt_count", *COMPONENTS.split())
SUMMARY = (
    "select score_mode, config_name, display_name, family, lambda_coord, lambda_obj, lambda_noobj, lambda_cls, count(*) top_n, avg(hnm_score) mean_hnm_score, median(hnm_score) median_hnm_score, "
    "cast(median(num_objects) as double) median_num_objects, " + ", ".join(f"avg({m}) mean_{m}" for m in MEANS)
    + ", count(*) filter (raw_prediction_count = 0) zero_prediction_images, avg(case when raw_prediction_count = 0 then 1 else 0 end) share_zero_prediction_images, "
    + ", ".join(f"avg(case when dominant_contribution = '{d}' then 1 else 0 end) \"dominant_{d}_share\"" for d in mining.DOMINANT)
    + " from top group by all"
)
SUMMARY_REALS = " ".join(
    ["mean_hnm_score", "median_hnm_score", *[f"mean_{m}" for m in MEANS], "share_zero_prediction_images", *[f'"dominant_{d}_share"' for d in mining.DOMINANT]])


@query("lambda_summary", duck(SUMMARY, FX, TOP, SUMMARY_REALS))
def _(f):
    return sweep(f).summary


OVERLAP = (
    "ovl as materialized (select a.score_mode, a.config_name config_a, b.config_name config_b, count(x.image_id) intersection_count, count(x.image_id) / cast(any_value(a.n) + any_value(b.n) - count(x.image_id) as double) jaccard_overlap "
    "from (select score_mode, config_name, count(*) n from top group by all) a join (select score_mode, config_name, count(*) n from top group by all) b on a.score_mode = b.score_mode "
    "left join (select p.score_mode, p.config_name ca, q.config_name cb, p.image_id from top p join top q on p.image_id = q.image_id and p.score_mode = q.score_mode) x "
    "on x.score_mode = a.score_mode and x.ca = a.config_name and x.cb = b.config_name group by a.score_mode, a.config_name, b.config_name)"
)


@query("lambda_overlap", duck("select * from ovl", FX, [*TOP, OVERLAP], "jaccard_overlap"))
def _(f):
    return sweep(f).overlap


DENSE = (
    "dens as materialized (select r.score_mode, r.config_name, r.display_name, b.density_bucket, cast(b.o as bigint) bucket_order, count(t.image_id) image_count, count(t.image_id) / cast(any_value(r.n) as double) image_share "
    "from (select score_mode, config_name, display_name, count(*) n from top group by all) r cross join (values ('1', 0), ('2-4', 1), ('5-9', 2), ('10-14', 3), ('15-19', 4), ('20+', 5)) b(density_bucket, o) "
    "left join top t on t.score_mode = r.score_mode and t.config_name = r.config_name and t.density_bucket = b.density_bucket group by all)"
)


@query("density_by_lambda", duck("select * from dens", FX, [*TOP, DENSE], "image_share"))
def _(f):
    return as_big(mining.run_density(top(f)), "bucket_order")


PRESENCE = (
    "pres as materialized (select t.score_mode, t.config_name, t.display_name, k.class_name, count(*) image_count, count(*) / cast(any_value(r.n) as double) image_share "
    "from top t join cc c on c.image_id = t.image_id join fx_classes k on k.class_id = c.class_id join (select score_mode, config_name, count(*) n from top group by all) r "
    "on r.score_mode = t.score_mode and r.config_name = t.config_name group by t.score_mode, t.config_name, t.display_name, k.class_name)"
)


@query("class_presence_by_lambda", duck("select * from pres", FX, [*TOP, PRESENCE], "image_share"))
def _(f):
    return mining.run_class_presence(top(f))


MAIN = ", ".join(f"'{m}'" for m in mining.MAIN)


def pivoted(source: str, row: str, key: str, value: str, names, extra: str = "", empty: str = "") -> str:
    cols = ", ".join(f"{empty}(max({value}) filter ({key} = '{n}'){', cast(0 as double))' if empty else ')'} \"{n}\"" for n in names)
    return f"select {row}, {cols} from {source} where score_mode = 'normalized' {extra} group by {row}"


@query("class_presence_matrix", duck(
    pivoted("pres", "class_name", "config_name", "image_share", mining.MAIN,
            f"and config_name in ({MAIN}) and class_name in (select class_name from pres where score_mode = 'normalized' and config_name in ({MAIN}) group by 1 order by sum(image_count) desc, class_name limit 10)", "coalesce"),
    FX, [*TOP, PRESENCE], MAIN.replace("'", "").replace(",", "")))
def _(f):
    return mining.class_presence_matrix(mining.run_class_presence(top(f)))


@query("overlap_matrix", duck(pivoted("ovl", "config_a", "config_b", "jaccard_overlap", mining.MAIN, f"and config_a in ({MAIN})"),
       FX, [*TOP, OVERLAP], MAIN.replace("'", "").replace(",", "")))
def _(f):
    return mining.overlap_matrix(mining.run_overlap(top(f)))


LABELS = ("1", "2-4", "5-9", "10-14", "15-19", "20+")


@query("density_matrix", duck(pivoted("dens", "config_name", "density_bucket", "image_share", LABELS, f"and config_name in ({MAIN})"),
       FX, [*TOP, DENSE], " ".join(f'"{b}"' for b in LABELS)))
def _(f):
    return mining.density_matrix(mining.run_density(top(f)))

"""Dataset index, distributions, overlap profile and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_boxes import as_big
from checks.registry import duck, iou, query
from detframe.functions import buckets
from detframe.operators import profile, sampling
from detframe.operators.pairs import LIMIT
from detframe.plans import reports, selection
from detframe.session import materialize

FX = ["fx_images", "fx_gt", "fx_classes"]
DENSITY = "case when n <= 1 then '1' when n <= 4 then '2-4' when n <= 9 then '5-9' when n <= 14 then '10-14' when n <= 19 then '15-19' else '20+' end"
CROWDING = "case when coalesce(p1, 0) = 0 then '0' when p1 <= 4 then '1-4' when p1 <= 19 then '5-19' else '20+' end"
INDEX = [
    "cc as materialized (select image_id, class_id, count(*) n from fx_gt group by all)",
    f"idx as materialized (select image_id, image_file, n num_objects, {DENSITY} density_bucket from (select i.image_id, i.image_file, "
    "coalesce(cast(g.n as bigint), 0) n from fx_images i left join (select image_id, sum(n) n from cc group by 1) g using (image_id)))",
]
DIST = (
    "select k.class_id, k.class_name, coalesce(cast(sum(c.n) as bigint), 0) object_count, count(c.image_id) image_count from fx_classes k "
    "left join {cc} c on c.class_id = k.class_id group by k.class_id, k.class_name"
)
BUCKETS = "(values ('1', 0), ('2-4', 1), ('5-9', 2), ('10-14', 3), ('15-19', 4), ('20+', 5)) b(density_bucket, bucket_order)"
CROWDS = "(values ('0', 0), ('1-4', 1), ('5-19', 2), ('20+', 3)) b(crowding_bucket, bucket_order)"


def index(f):
    return profile.dataset_index(f("fx_images").select("image_id", "image_file"), f("fx_gt"), f("fx_classes"))


def slim(f):
    """The index without list columns, written once for the jobs that read it several times."""
    return materialize(index(f).select("image_id", "image_file", "num_objects", "density_bucket"), "index")


@query("dataset_index", duck(
    "select i.image_id, i.image_file, i.num_objects, i.density_bucket, coalesce(p.ids, '') ids, coalesce(p.names, '') names from idx i left join "
    "(select image_id, string_agg(cast(class_id as string), ',' order by class_id) ids, string_agg(class_name, ',' order by class_id) names "
    "from cc join fx_classes using (class_id) group by 1) p using (image_id)", FX, INDEX))
def _(f):
    out = index(f).withColumns({"ids": F.array_join(F.col("class_ids_present").cast("array<string>"), ","),
                                "names": F.array_join("class_names_present", ",")})
    return out.drop("class_ids_present", "class_names_present")


WIDE = ", ".join(f"count(g.pos) filter (g.class_id = {i}) count_class_{i:02d}" for i in range(20))


@query("dataset_index_wide", duck(f"select i.image_id, {WIDE} from fx_images i left join fx_gt g using (image_id) group by i.image_id", FX))
def _(f):
    return profile.dataset_index_wide(f("fx_images").select("image_id"), f("fx_gt"), {i: f"count_class_{i:02d}" for i in range(20)})


@query("class_distribution", duck(f"select cast(class_id as bigint) class_id, class_name, object_count, image_count from ({DIST.format(cc='cc')})", FX, INDEX))
def _(f):
    return as_big(profile.class_distribution(f("fx_gt"), f("fx_classes")), "class_id")


@query("object_count_distribution", duck("select num_objects, count(*) image_count from idx group by 1", FX, INDEX))
def _(f):
    return profile.object_count_distribution(index(f))


@query("dataset_summary", duck(
    "select count(*) images, cast(sum(num_objects) as bigint) total_objects, count(*) filter (num_objects = 0) images_with_zero_objects, avg(num_objects) mean_objects_per_image, "
    "max(num_objects) max_objects_per_image, median(num_objects) median_objects_per_image, count(*) filter (num_objects >= 5) images_ge_5_objects, count(*) filter (num_objects >= 10) images_ge_10_objects, "
    "count(*) filter (num_objects >= 15) images_ge_15_objects, count(*) filter (num_objects >= 20) images_ge_20_objects from idx",
    FX, INDEX, "mean_objects_per_image median_objects_per_image"))
def _(f):
    return reports.profile_dataset(f("fx_images").select("image_id", "image_file"), f("fx_gt"), f("fx_classes")).summary


def shares(dist: str, images: str) -> str:
    return (
        f"select cast(class_id as bigint) class_id, class_name, object_count, image_count, 100.0 * object_count / cast((select sum(object_count) from ({dist})) as double) object_share_pct, "
        f"100.0 * image_count / cast((select count(*) from {images}) as double) image_share_pct from ({dist})"
    )


FULL = f"full_dist as materialized ({shares(DIST.format(cc='cc'), 'idx')})"


@query("class_shares", duck("select * from full_dist", FX, [*INDEX, FULL], "object_share_pct image_share_pct"))
def _(f):
    return as_big(profile.class_distribution(f("fx_gt"), f("fx_classes"), f("fx_images")), "class_id")


def bucket_text(source: str, bucket: str, dim: str) -> str:
    return (
        f"select b.{bucket}, cast(b.bucket_order as bigint) bucket_order, count(s.image_id) image_count, 100.0 * count(s.image_id) / cast((select count(*) from {source}) as double) image_share_pct "
        f"from {dim} left join {source} s on s.{bucket} = b.{bucket} group by all"
    )


@query("density_distribution", duck(bucket_text("idx", "density_bucket", BUCKETS), FX, INDEX, "image_share_pct"))
def _(f):
    return as_big(profile.density_distribution(slim(f)), "bucket_order")


@query("density_bucket", duck("select image_id, density_bucket from idx", FX, INDEX))
def _(f):
    counts = f("fx_images").select("image_id").join(f("fx_gt").groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left")
    return counts.select("image_id", buckets.density_bucket(F.coalesce("n", F.lit(0))).alias("density_bucket"))


@query("dense_image_counts", duck(
    "select cast(t as bigint) threshold, count(*) filter (num_objects >= t) image_count, 100.0 * count(*) filter (num_objects >= t) / cast(count(*) as double) image_share_pct "
    "from idx, (values (5), (10), (15), (20)) k(t) group by t", FX, INDEX, "image_share_pct"))
def _(f):
    return as_big(profile.dense_image_counts(index(f)), "threshold")


for label, way, largest in (("top10_classes", "desc", True), ("bottom10_classes", "asc", False)):

    @query(label, duck(
        f"select cast(class_id as bigint) class_id, class_name, object_count, image_count from ({DIST.format(cc='cc')}) order by object_count {way}, class_id limit 10", FX, INDEX))
    def _(f, largest=largest):
        return as_big(profile.extreme_classes(profile.class_distribution(f("fx_gt"), f("fx_classes")), 10, largest), "class_id")


@query("densest_image", duck("select image_id, num_objects from idx order by num_objects desc, image_id limit 1", FX, INDEX))
def _(f):
    return index(f).select("image_id", "num_objects").orderBy(F.desc("num_objects"), "image_id").limit(1)


# ---- overlap ----------------------------------------------------------------

PROFILE = [
    f"pr as (select a.image_id, least(1, greatest(0, {iou('a.', 'b.')})) iou from fx_gt a join fx_gt b on a.image_id = b.image_id and a.pos < b.pos)",
    "prof_raw as (select image_id, count(*) pair_count, max(iou) mx, avg(iou) mn, count(*) filter (iou > 0.1) p1, count(*) filter (iou > 0.3) p3, count(*) filter (iou > 0.5) p5 from pr group by 1)",
    "prof as materialized (select i.image_id, i.num_objects, coalesce(pair_count, 0) pair_count, coalesce(mx, cast(0 as double)) max_pairwise_iou, coalesce(mn, cast(0 as double)) mean_pairwise_iou, "
    f"coalesce(p1, 0) pairs_iou_gt_0_1, coalesce(p3, 0) pairs_iou_gt_0_3, coalesce(p5, 0) pairs_iou_gt_0_5, {CROWDING} crowding_bucket from idx i left join prof_raw using (image_id))",
]


def overlap(f, limit: int = LIMIT):
    return profile.overlap_profile(f("fx_images").select("image_id"), f("fx_gt"), limit=limit)


@query("overlap_profile", duck("select * from prof", FX, [*INDEX, *PROFILE], "max_pairwise_iou mean_pairwise_iou"))
def _(f):
    return overlap(f)


@query("crowding_bucket", duck("select image_id, pairs_iou_gt_0_1, crowding_bucket from prof", FX, [*INDEX, *PROFILE]))
def _(f):
    return overlap(f).select("image_id", "pairs_iou_gt_0_1", "crowding_bucket")


@query("overlap_summary", duck(
    "select count(*) images, avg(pair_count) mean_pair_count, avg(max_pairwise_iou) mean_max_pairwise_iou, avg(pairs_iou_gt_0_1) mean_pairs_iou_gt_0_1, count(*) filter (pairs_iou_gt_0_1 > 0) images_with_any_iou_gt_0_1, "
    "count(*) filter (pairs_iou_gt_0_3 > 0) images_with_any_iou_gt_0_3, count(*) filter (pairs_iou_gt_0_5 > 0) images_with_any_iou_gt_0_5, count(*) filter (pairs_iou_gt_0_1 >= 20) images_with_20plus_iou_gt_0_1_pairs from prof",
    FX, [*INDEX, *PROFILE], "mean_pair_count mean_max_pairwise_iou mean_pairs_iou_gt_0_1"))
def _(f):
    return reports.profile_overlap(f("fx_images"), f("fx_gt")).summary


@query("crowding_distribution", duck(bucket_text("prof", "crowding_bucket", CROWDS), FX, [*INDEX, *PROFILE], "image_share_pct"))
def _(f):
    return as_big(reports.profile_overlap(f("fx_images"), f("fx_gt")).crowding, "bucket_order")


# ---- samples ----------------------------------------------------------------

SEED = 42


def hashed(seed: int, column: str = "image_id") -> str:
    return f"cast('0x' || substr(md5('{seed}:' || cast({column} as varchar)), 1, 14) as bigint)"


HALF = "(select count(*) // 2 from idx)"
TARGETS = (
    f"targets as materialized (select density_bucket, available, least(available, base + case when row_number() over (order by raw - base desc, density_bucket) <= {HALF} - sum(base) over () then 1 else 0 end) target "
    f"from (select *, cast(floor(raw) as bigint) base from (select density_bucket, count(*) available, count(*) / cast((select count(*) from idx) as double) * {HALF} raw from idx group by 1)))"
)
STRAT = [
    *INDEX, TARGETS,
    f"drawn as materialized (select image_id from (select i.*, t.target, row_number() over (partition by i.density_bucket order by {hashed(SEED)}, image_id) rn from idx i join targets t using (density_bucket)) where rn <= target)",
    f"strat as materialized (select image_id from drawn union all (select image_id from idx where image_id not in (select image_id from drawn) order by {hashed(SEED + 1)}, image_id "
    f"limit greatest(0, {HALF} - (select count(*) from drawn))))",
]


def half(f, idx):
    return idx.count() // 2


def stratified(f, idx):
    return materialize(sampling.stratified_sample(idx, "density_bucket", half(f, idx), SEED), "sample")


@query("sample_random", duck(f"select image_id from idx order by {hashed(SEED)}, image_id limit {HALF}", FX, INDEX))
def _(f):
    idx = slim(f)
    return sampling.random_sample(idx, half(f, idx), SEED).select("image_id")


@query("stratified_targets", duck("select density_bucket, available, cast(target as bigint) target from targets", FX, [*INDEX, TARGETS]))
def _(f):
    idx = slim(f)
    return sampling.stratified_targets(idx, "density_bucket", half(f, idx))


@query("sample_stratified", duck("select image_id from strat", FX, STRAT))
def _(f):
    return stratified(f, slim(f)).select("image_id")


@query("unselected_images", duck("select image_id from idx where image_id not in (select image_id from strat)", FX, STRAT))
def _(f):
    idx = slim(f)
    return sampling.unselected(idx, stratified(f, idx)).select("image_id")


SAMPLED = [
    *STRAT, "sidx as materialized (select * from idx where image_id in (select image_id from strat))",
    "scc as materialized (select * from cc where image_id in (select image_id from strat))",
    f"s_dist as materialized ({shares(DIST.format(cc='scc'), 'sidx')})",
]


@query("class_distribution_sample", duck("select * from s_dist", FX, SAMPLED, "object_share_pct image_share_pct"))
def _(f):
    return as_big(profile.class_distribution(f("fx_gt"), f("fx_classes"), stratified(f, slim(f))), "class_id")


@query("density_distribution_sample", duck(bucket_text("sidx", "density_bucket", BUCKETS), FX, SAMPLED, "image_share_pct"))
def _(f):
    return as_big(profile.density_distribution(stratified(f, slim(f))), "bucket_order")


MEASURES = ("object_count", "image_count", "object_share_pct", "image_share_pct")
CLASS_CMP = (
    "class_cmp as materialized (select a.class_id, a.class_name, a.object_count object_count_full, b.object_count object_count_sample, a.image_count image_count_full, b.image_count image_count_sample, "
    "a.object_share_pct object_share_pct_full, b.object_share_pct object_share_pct_sample, a.image_share_pct image_share_pct_full, b.image_share_pct image_share_pct_sample, "
    "b.object_share_pct - a.object_share_pct object_share_diff_pp, b.image_share_pct - a.image_share_pct image_share_diff_pp from full_dist a join s_dist b using (class_id))"
)


def class_cmp(f, sample):
    full = profile.class_distribution(f("fx_gt"), f("fx_classes"), f("fx_images"))
    part = profile.class_distribution(f("fx_gt"), f("fx_classes"), sample)
    return materialize(profile.compare_shares(full, part, ["class_id", "class_name"], MEASURES), "class-cmp")


@query("class_compare", duck("select * from class_cmp", FX, [*SAMPLED, FULL, CLASS_CMP],
       "object_share_pct_full object_share_pct_sample image_share_pct_full image_share_pct_sample object_share_diff_pp image_share_diff_pp"))
def _(f):
    return as_big(class_cmp(f, stratified(f, slim(f))), "class_id")


def bucket_cmp(bucket: str, full: str, part: str, dim: str) -> str:
    return (
        f"select a.{bucket}, a.image_count image_count_full, b.image_count image_count_sample, a.image_share_pct image_share_pct_full, b.image_share_pct image_share_pct_sample, "
        f"b.image_share_pct - a.image_share_pct image_share_diff_pp from ({bucket_text(full, bucket, dim)}) a join ({bucket_text(part, bucket, dim)}) b using ({bucket})"
    )


def density_cmp(idx, sample):
    return profile.compare_shares(
        profile.density_distribution(idx), profile.density_distribution(sample), ["density_bucket"], ("image_count", "image_share_pct"))


BUCKET_REALS = "image_share_pct_full image_share_pct_sample image_share_diff_pp"


@query("density_compare", duck(bucket_cmp("density_bucket", "idx", "sidx", BUCKETS), FX, SAMPLED, BUCKET_REALS))
def _(f):
    idx = slim(f)
    return density_cmp(idx, stratified(f, idx))


@query("crowding_compare", duck(bucket_cmp("crowding_bucket", "prof", "sprof", CROWDS),
       FX, [*SAMPLED, *PROFILE, "sprof as (select * from prof where image_id in (select image_id from strat))"], BUCKET_REALS))
def _(f):
    full = materialize(overlap(f), "profile")
    part = full.join(stratified(f, slim(f)).select("image_id"), "image_id", "left_semi")
    return profile.compare_shares(profile.crowding_distribution(full), profile.crowding_distribution(part),
                                  ["crowding_bucket"], ("image_count", "image_share_pct"))


RARE = (
    "rare as materialized (select class_id, class_name, object_count, image_count, cast(least(image_count, greatest(ceil(image_count * cast(0.5 as double)), least(100, image_count))) as bigint) target_image_count, "
    f"row_number() over (order by object_count, class_id) k from ({DIST.format(cc='cc')}) order by object_count, class_id limit 8)"
)


def rare_targets(f):
    return materialize(sampling.rare_class_targets(profile.class_distribution(f("fx_gt"), f("fx_classes")), 0.5), "rare-targets")


@query("rare_class_targets", duck(
    "select cast(class_id as bigint) class_id, class_name, object_count, image_count, target_image_count from rare", FX, [*INDEX, RARE]))
def _(f):
    return as_big(rare_targets(f), "class_id")


COVER = (
    "cover as (select c.*, r.target_image_count, case when c.image_count_full > 0 then 100.0 * c.image_count_sample / cast(c.image_count_full as double) end sample_image_retention_pct from class_cmp c join rare r on r.class_id = c.class_id)"
)


@query("rare_class_coverage", duck(
    "select cast(class_id as bigint) class_id, class_name, image_count_full, image_count_sample, target_image_count, sample_image_retention_pct from cover",
    FX, [*SAMPLED, FULL, CLASS_CMP, RARE, COVER], "sample_image_retention_pct"))
def _(f):
    out = sampling.rare_class_coverage(class_cmp(f, stratified(f, slim(f))), rare_targets(f))
    return as_big(out.select("class_id", "class_name", "image_count_full", "image_count_sample", "target_image_count", "sample_image_retention_pct"), "class_id")


def quality_text(sample: str) -> str:
    """The quality row of a sample, whose own relations carry its name."""
    return (
        f"select '{sample}' candidate, (select count(*) from {sample}_idx) images, (select cast(sum(num_objects) as bigint) from {sample}_idx) total_objects, (select avg(num_objects) from {sample}_idx) mean_objects_per_image, "
        f"(select count(*) from {sample}_idx where num_objects >= 10) images_ge_10_objects, (select count(*) from {sample}_idx where num_objects >= 20) images_ge_20_objects, "
        f"(select avg(abs(object_share_diff_pp)) from {sample}_cmp) class_object_share_mae_pp, (select max(abs(object_share_diff_pp)) from {sample}_cmp) class_object_share_max_error_pp, "
        f"(select avg(abs(image_share_diff_pp)) from {sample}_dcmp) density_share_mae_pp, (select max(abs(image_share_diff_pp)) from {sample}_dcmp) density_share_max_error_pp, "
        f"(select min(case when c.image_count_full > 0 then 100.0 * c.image_count_sample / cast(c.image_count_full as double) end) from {sample}_cmp c join rare r on r.class_id = c.class_id) min_rare_class_image_retention_pct"
    )


def quality_ctes(sample: str, ids: str) -> list[str]:
    return [
        f"{sample}_idx as materialized (select * from idx where image_id in ({ids}))",
        f"{sample}_cc as materialized (select * from cc where image_id in ({ids}))",
        f"{sample}_dist as materialized ({shares(DIST.format(cc=sample + '_cc'), sample + '_idx')})",
        CLASS_CMP.replace("class_cmp as", f"{sample}_cmp as").replace("s_dist", f"{sample}_dist"),
        f"{sample}_dcmp as ({bucket_cmp('density_bucket', 'idx', sample + '_idx', BUCKETS)})",
    ]


@query("sample_quality", duck(
    "select (select count(*) from sidx) images, (select cast(sum(num_objects) as bigint) from sidx) total_objects, (select avg(num_objects) from sidx) mean_objects_per_image, "
    "(select count(*) from sidx where num_objects >= 10) images_ge_10_objects, (select count(*) from sidx where num_objects >= 20) images_ge_20_objects, "
    "(select avg(abs(object_share_diff_pp)) from class_cmp) class_object_share_mae_pp, (select max(abs(object_share_diff_pp)) from class_cmp) class_object_share_max_error_pp, "
    "(select avg(abs(image_share_diff_pp)) from dcmp) density_share_mae_pp, (select max(abs(image_share_diff_pp)) from dcmp) density_share_max_error_pp, "
    "(select min(sample_image_retention_pct) from cover) min_rare_class_image_retention_pct",
    FX, [*SAMPLED, FULL, CLASS_CMP, RARE, COVER, f"dcmp as ({bucket_cmp('density_bucket', 'idx', 'sidx', BUCKETS)})"],
    "mean_objects_per_image class_object_share_mae_pp class_object_share_max_error_pp density_share_mae_pp density_share_max_error_pp min_rare_class_image_retention_pct"))
def _(f):
    idx = slim(f)
    sample = stratified(f, idx)
    cmp = class_cmp(f, sample)
    return sampling.sample_quality(cmp, density_cmp(idx, sample), sampling.rare_class_coverage(cmp, rare_targets(f)), sample)


def rare_steps() -> list[str]:
    """Eight unrolled steps, then the trim and the fill."""
    steps, last = [], "strat"
    for k in range(1, 9):
        having = f"(select image_id from cc where class_id = (select class_id from rare where k = {k}))"
        need = f"greatest(0, (select target_image_count from rare where k = {k}) - (select count(*) from {last} where image_id in {having}))"
        steps.append(
            f"ra{k} as materialized (select image_id from {last} union all (select image_id from {having} where image_id not in (select image_id from {last}) "
            f"order by {hashed(SEED + k - 1)}, image_id limit {need}))"
        )
        last = f"ra{k}"
    return [
        *steps,
        "has_rare as materialized (select distinct image_id from cc where class_id in (select class_id from rare))",
        f"flagged as materialized (select image_id, image_id in (select image_id from has_rare) r from {last})",
        f"ranked as (select image_id, r, row_number() over (partition by r order by {hashed(SEED)}, image_id) rn from flagged)",
        f"room as (select least({HALF}, (select count(*) from flagged where r)) keep)",
        f"trimmed as materialized (select image_id from ranked where case when r then rn <= (select keep from room) else rn <= {HALF} - (select keep from room) end)",
        f"chosen as (select image_id from trimmed union all (select image_id from idx where image_id not in (select image_id from trimmed) order by {hashed(SEED)}, image_id "
        f"limit greatest(0, {HALF} - (select count(*) from trimmed))))",
    ]


@query("sample_rare_aware", duck("select image_id from chosen", FX, [*STRAT, RARE, *rare_steps()]))
def _(f):
    idx = slim(f)
    presence = profile.class_counts(f("fx_gt")).select("image_id", "class_id")
    out = sampling.enforce_rare_targets(stratified(f, idx), idx, presence, rare_targets(f), half(f, idx), SEED)
    return out.select("image_id")


CANDIDATES = {"random": f"select image_id from (select image_id from idx order by {hashed(SEED)}, image_id limit {HALF})", "stratified": "select image_id from strat", "rare_aware": "select image_id from chosen"}


@query("candidate_sample_quality", duck(
    " union all ".join(quality_text(n) for n in CANDIDATES), FX, [*STRAT, FULL, RARE, *rare_steps(), *(c for n, ids in CANDIDATES.items() for c in quality_ctes(n, ids))],
    "mean_objects_per_image class_object_share_mae_pp class_object_share_max_error_pp density_share_mae_pp density_share_max_error_pp min_rare_class_image_retention_pct"))
def _(f):
    idx = slim(f)
    return selection.candidate_quality(idx, f("fx_gt"), f("fx_classes"), half(f, idx), SEED)[1]

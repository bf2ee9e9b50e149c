import math

import pytest
from pyspark.sql import functions as F

from detframe.functions.conditions import CONDITIONS, condition_array
from detframe.operators import augment, mining

COMPONENTS = (
    "image_id bigint, image_file string, num_objects bigint, density_bucket string, class_names_present array<string>, loc_loss double, "
    "conf_loss_obj double, conf_loss_noobj double, class_loss double, raw_prediction_count bigint, ground_truth_count bigint, "
    "matched_prediction_count bigint, false_positive_prediction_count bigint, matched_gt_count bigint, missed_gt_count bigint"
)


def components(spark):
    rows = [(i, f"f{i}", 1, "1", ["a"], float(i * 7 % 5), float(i % 3), 0.5, float(i % 2), i % 2, 1, 0, i % 2, 0, 1) for i in range(12)]
    rows.append((99, "f99", 0, "1", [], 0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0))
    return spark.createDataFrame(rows, COMPONENTS)


def test_scores_and_dominant_component(spark):
    scales = spark.createDataFrame([("loc_loss", 4.0), ("conf_loss_obj", 2.0), ("conf_loss_noobj", 1.0), ("class_loss", 1.0)], "component string, scale double")
    rows = mining.scored_runs(components(spark), scales).collect()
    assert len(rows) == 13 * 18
    by = {c[0]: c for c in mining.CONFIGS}
    for r in rows:
        parts = [r.loc_loss, r.conf_loss_obj, r.conf_loss_noobj, r.class_loss]
        if r.score_mode == "normalized":
            parts = [p / s for p, s in zip(parts, (4.0, 2.0, 1.0, 1.0))]
        parts = [w * p for w, p in zip(by[r.config_name][2:6], parts)]
        assert r.hnm_score == pytest.approx(sum(parts))
        assert r.dominant_contribution == mining.DOMINANT[parts.index(max(parts))]


def test_top_lists_and_overlap(spark):
    top = mining.top_images(mining.scored_runs(components(spark)), 5).cache()
    for r in top.groupBy("score_mode", "config_name").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect():
        assert (r.n, r.m) == (5, 5)
    pairs = mining.run_overlap(top).collect()
    assert len(pairs) == 2 * 81 and all(r.jaccard_overlap == 1.0 for r in pairs if r.config_a == r.config_b)
    density = mining.run_density(top)
    assert density.count() == 18 * 6 and density.agg(F.sum("image_count")).first()[0] == 90
    with pytest.raises(ValueError):
        mining.config_array(["other"])


def test_few_images_are_ranked_for_a_top_list(spark):
    images = spark.range(6000).select(
        (F.col("id") % 2).cast("string").alias("score_mode"), F.lit("c").alias("config_name"), F.format_string("%05d", "id").alias("image_file"),
        F.when(F.col("id") % 10 > 1, F.floor(F.pmod(F.xxhash64("id"), F.lit(5000)) / 2) / 8).alias("hnm_score"),
    )
    odd = images.where("score_mode = '0' or image_file < '00011'").withColumn("hnm_score", F.expr("if(image_file = '00004', double('nan'), hnm_score)"))
    for scored, n in ((images, 20), (odd, 20), (images.withColumn("hnm_score", F.lit(0.0)), 7)):
        rows = [(r.score_mode, r.hnm_score, r.image_file) for r in scored.collect()]
        key = lambda r: (r[1] is None, r[1] is not None and r[1] == r[1], -r[1] if r[1] is not None and r[1] == r[1] else 0.0, r[2])
        want = {(m, f, k + 1) for m in "01" for k, (_, _, f) in enumerate(sorted((r for r in rows if r[0] == m), key=key)[:n])}
        assert {(r.score_mode, r.image_file, r["rank"]) for r in mining.top_images(scored, n).collect()} == want
    # 2,400 images of each run have a score
    assert 40 <= mining.contenders(images, 20).count() < 150


def test_hard_negative_arguments(spark):
    table = components(spark)
    assert mining.hard_negatives(table, 0, "loc_loss").columns == table.columns
    assert mining.hard_negatives(table, -3, "loc_loss").count() == 0
    assert mining.hard_negatives(table, 2, "loc_loss").select("image_id").collect()[0].image_id == 2
    with pytest.raises(KeyError):
        mining.hard_negatives(table, 2, "nope")


# ---- pixels -------------------------------------------------------------------

def picture(spark, w=7, h=5):
    rows = [(1, y, x, c, (y * 31 + x * 17 + c * 5) % 256) for y in range(h) for x in range(w) for c in range(3)]
    images = spark.createDataFrame([(1, w, h)], "image_id bigint, width int, height int")
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, c int, v int"), images, {r[1:4]: r[4] for r in rows}


def values(df):
    return {(r.y, r.x, r.c): r.v for r in df.collect()}


def test_flips_twice_is_identity(spark):
    px, images, want = picture(spark)
    assert values(augment.hflip(augment.hflip(px, images), images)) == want
    assert values(augment.vflip(augment.vflip(px, images), images)) == want
    assert values(augment.hflip(px, images))[(0, 0, 0)] == want[(0, 6, 0)]


def test_brightness_clips_and_truncates(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 250), (1, 0, 1, 0, 11), (1, 0, 2, 0, 3)], "image_id bigint, y int, x int, c int, v int")
    assert sorted(values(augment.brightness(df, 1.15, 35)).values()) == [38, 47, 255]
    assert sorted(values(augment.brightness(df, 0.85, -35)).values()) == [0, 0, 177]


@pytest.mark.parametrize("size", [3, 4, 5, 9])
def test_blur_against_loop(spark, size):
    px, _, src = picture(spark)
    k = augment.gaussian_kernel(size)
    assert sum(k) == pytest.approx(1) and len(k) % 2 == 1
    half = len(k) // 2

    def mirror(i, n):
        i %= 2 * (n - 1)
        return min(i, 2 * (n - 1) - i)

    for (y, x, c), got in values(augment.blur(px, size)).items():
        exact = sum(a * b * src[(mirror(y + i - half, 5), mirror(x + j - half, 7), c)] for i, a in enumerate(k) for j, b in enumerate(k))
        assert abs(got - exact) <= 0.5 + 1e-6
    with pytest.raises(ValueError):
        augment.gaussian_kernel(0)


def test_resize(spark):
    px, images, src = picture(spark)
    assert values(augment.resize(px, images, scale=1.0)) == src
    out = values(augment.resize(px, images, target=(14, 10)))
    assert len(out) == 14 * 10 * 3 and out[(0, 0, 0)] == src[(0, 0, 0)]

    def at(i, n, m):
        place = min(max((i + 0.5) * n / m - 0.5, 0), n - 1)
        low = math.floor(place)
        return low, min(low + 1, n - 1), place - low

    for (y, x, c), got in out.items():
        y0, y1, fy = at(y, 5, 10)
        x0, x1, fx = at(x, 7, 14)
        rows = [src[(r, x0, c)] * (1 - fx) + src[(r, x1, c)] * fx for r in (y0, y1)]
        assert abs(got - (rows[0] * (1 - fy) + rows[1] * fy)) <= 0.5 + 1e-6


def test_random_chain(spark):
    images = spark.range(200).select(F.col("id").alias("image_id"))
    chains = [r.chain for r in augment.augment_plan(images, 3).collect()]
    assert {len(c) for c in chains} == {1, 2, 3} and all(len(set(c)) == len(c) for c in chains)
    assert len({tuple(c) for c in chains}) > 8 and "resize" not in {n for c in chains for n in c}
    assert chains == [r.chain for r in augment.augment_plan(images, 3).collect()]
    assert all(len(r.chain) == 1 for r in augment.augment_plan(images, 3, max_transforms=0).collect())


def test_chain_with_resize_runs(spark):
    px, images, src = picture(spark)
    plan = spark.createDataFrame([(1, ["resize", "vertical_flip"])], "image_id bigint, chain array<string>")
    out = values(augment.apply_plan(px, images, plan, scale=2.0))
    grown = values(augment.resize(px, images, scale=2.0))
    assert out == {(9 - y, x, c): v for (y, x, c), v in grown.items()}


def test_conditions(spark):
    px, images, src = picture(spark)
    got = augment.by_condition(px, images)
    assert got.count() == len(src) * 5
    assert values(got.where("condition = 'vertical_flip'")) == values(augment.vflip(px, images))
    assert values(got.where("condition = 'gaussian_blur_k9'")) == values(augment.blur(px, 9))
    with pytest.raises(ValueError):
        condition_array([("odd", "Odd", "sepia", None, None, None, None)])
    box = spark.createDataFrame([(1, 0, 2, 0.1, 0.9, 0.4, 0.4)], "image_id bigint, pos int, class_id int, cx double, cy double, w double, h double")
    rows = {r.condition: r for r in augment.ground_truth_by_condition(box, images).collect()}
    assert [c[0] for c in CONDITIONS] == [r.condition for r in sorted(rows.values(), key=lambda r: r.condition_order)]
    # Clipped on the left; flipped top to bottom in the one condition only.
    assert rows["original"].x == 0.0 and rows["original"].y == pytest.approx(3.5)
    assert rows["vertical_flip"].y == 0.0

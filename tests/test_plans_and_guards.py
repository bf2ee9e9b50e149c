"""Guards against lost rows, keys of any kind, resumable streams, label text as written."""

import random

import pytest
from pyspark.sql import functions as F

from detframe.functions.buckets import parse_list
from detframe.operators import augment, match, pairs
from detframe.plans.evaluation import evaluate_model, evaluate_runs
from detframe.plans.miner import HardNegativeMiner
from detframe.sources import labels
from detframe.streaming import frames


def images(spark, n=20, first=10**9):
    return spark.range(n).select((F.col("id") + first).alias("image_id"), F.lit(4).alias("width"), F.lit(3).alias("height"))


def pixels(spark, pictures):
    rows = pictures.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("y"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x")).select("*", F.lit(0).alias("c"), F.lit(9).alias("v"))


def test_a_plan_that_resizes_needs_a_size_and_keeps_all_images(spark):
    own = images(spark)
    plan = augment.augment_plan(own, 7, 4, include_resize=True)
    with pytest.raises(ValueError, match="resize"):
        augment.apply_plan(pixels(spark, own), own, plan)
    assert augment.apply_plan(pixels(spark, own), own, plan, scale=2.0).select("image_id").distinct().count() == 20
    with pytest.raises(ValueError, match="unknown"):
        augment.apply_plan(pixels(spark, own), own, own.select("image_id", F.array(F.lit("rotate")).alias("chain")))


def test_chains_run_to_their_end(spark):
    own = images(spark, 2)
    plan = own.select("image_id", F.array_repeat(F.lit("change_brightness"), 4).alias("chain"))
    assert {r.v for r in augment.apply_plan(pixels(spark, own), own, plan).select("v").collect()} == {129}


def test_boxes_follow_the_chain(spark):
    own = images(spark, 1, 5)
    boxes = own.select("image_id", *[F.lit(v).alias(n) for n, v in (("x", 1.0), ("y", 0.5), ("w", 1.0), ("h", 1.0))])
    plan = own.select("image_id", F.array(*map(F.lit, ("vertical_flip", "gaussian_blur", "resize", "vertical_flip"))).alias("chain"))
    r = augment.boxes_after_plan(boxes, own, plan, scale=2.0).first()
    assert (r.x, r.y, r.w, r.h) == (2.0, 1.0, 2.0, 2.0)


def test_runs_with_text_image_ids_and_a_stray_run(spark):
    box = "image_id string, pos int, class_id int, x double, y double, w double, h double, score double, cs array<double>, model string"
    hit = [(f"img{k}", 0, 0, 0.0, 0.0, 5.0, 5.0, 0.9, [0.9, 0.1], "a") for k in range(3)]
    stray = [(f"img{k}", p, 1, 50.0 * p, 0.0, 5.0, 5.0, 0.99, [0.1, 0.9], "zz") for k in range(3) for p in range(4)]
    truth = spark.createDataFrame([(f"img{k}", 0, 0, 0.0, 0.0, 5.0, 5.0) for k in range(3)], "image_id string, pos int, class_id int, x double, y double, w double, h double")
    classes = spark.createDataFrame([(0, "c0")], "class_id int, class_name string")
    from detframe.operators.match import match_detections

    assert match_detections(spark.createDataFrame(hit, box), truth).count() == 3
    numbered = lambda d: d.withColumn("image_id", F.substring("image_id", 4, 9).cast("long") + F.lit(2**62))
    both = numbered(spark.createDataFrame(hit + stray, box))
    summary, _ = evaluate_runs(both, numbered(truth), classes, 2, "model", ["a"])
    row = summary.first()
    assert row.map == pytest.approx(1.0) and row.predictions == 3


def test_flat_and_huge_boxes_beside_tiny_ones(spark):
    rows = [(1, k, float(3 * k), 0.0, 2.0, 2.0) for k in range(30)] + [(1, 30, 0.0, 0.0, 90.0, 1e6), (1, 31, 5.0, 5.0, -5.0, 5.0), (1, 32, 5.0, 5.0, 0.0, 0.0)]
    boxes = spark.createDataFrame(rows, "image_id long, pos int, x double, y double, w double, h double")
    key = lambda d: sorted((r.l_pos, r.r_pos, round(r.iou, 12)) for r in d.collect())
    assert key(pairs.box_pairs(boxes, limit=3)) == key(pairs.box_pairs(boxes)) and len(key(pairs.box_pairs(boxes))) == 30


def test_label_lines_with_any_white_space(spark):
    text = "\t1 0.5 0.5 0.1 0.1\t\n2 0.5 0.5 0.1\t\n99999999999 0.5 0.5 0.1 0.1\n-1 0 0 0 0\n  3\t0.1 0.2 0.3 0.4 extra\n\n"
    files = spark.createDataFrame([("a", text)], "stem string, label_text string")
    assert [(r.pos, r.class_id) for r in labels.parse_labels(files, 20).orderBy("pos").collect()] == [(0, 1), (4, 3)]
    with pytest.raises(Exception, match="five or more numbers"):
        labels.parse_labels_strict(spark.createDataFrame([("a", "1 0.5 0.5 0.1 0.1 x")], files.schema)).collect()


def test_list_text(spark):
    texts = ['["a"]', "['a', 'b']", '["O\'Hare", \'x\']', "['it\\'s']", "O'Hare", ""]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", parse_list(F.col("t")).alias("p"))
    assert [r.p for r in made.orderBy("k").collect()] == [["a"], ["a", "b"], ["O'Hare", "x"], ["it's"], ["O'Hare"], []]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "frame_number long"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        rows = frames.run_to_table(stream, "t", out, state).count()
        return rows, frames.run_total(stream, path=f"{out}-n", checkpoint=f"{state}-n").first().frames

    spark.range(5).withColumnRenamed("id", "frame_number").write.parquet(source)
    assert run() == (5, 5)
    spark.range(5, 8).withColumnRenamed("id", "frame_number").write.mode("append").parquet(source)
    assert run() == (8, 8)


def test_miner_builds_its_table_once(spark):
    table = spark.createDataFrame([(k, float(k), 1.0, 2.0, 0.5) for k in range(6)], "image_id long, loc_loss double, conf_loss_obj double, conf_loss_noobj double, class_loss double")
    miner = HardNegativeMiner(table)
    assert [r.image_id for r in miner.hardest(2, "loc_loss").collect()] == [5, 4] and miner.hardest(3).count() == 3
    with pytest.raises(KeyError):
        miner.hardest(1, "nothing")


@pytest.mark.parametrize("limit", [1024, 3])
def test_many_runs_from_one_pairing(spark, limit):
    """Runs with shared and with own boxes and truths, ordinary and large images: each as if it were matched alone."""
    rng = random.Random(limit)
    box = lambda: [float(rng.randrange(0, 40)), float(rng.randrange(0, 40)), float(rng.randrange(5, 30)), float(rng.randrange(5, 30))]
    shared = {(i, p): box() for i in ("a.jpg", "b.jpg", "c.jpg") for p in range(7)}
    dets = [(run, i, p, rng.choice([0.6, 0.7, 0.9]), *(b if rng.random() < 0.7 else box())) for run in range(3) for (i, p), b in shared.items() if rng.random() < 0.8]
    truth = [(run, i, p, p % 2, *(b if p % 3 else box())) for run in range(3) for (i, p), b in shared.items()]
    d = spark.createDataFrame(dets, "run int, image_id string, pos int, score double, x double, y double, w double, h double")
    t = spark.createDataFrame(truth, "run int, image_id string, pos int, class_id int, x double, y double, w double, h double")
    for own in (t, t.where("run = 1").drop("run")):
        got = sorted(tuple(r) for r in match.match_runs(d, own, 3, 0.3, limit).select("run", "image_id", "pos", "gt_pos", "gt_class", "iou").collect())
        want = []
        for run in range(3):
            alone = own.where(F.col("run") == run) if "run" in own.columns else own
            want += [(run, *r) for r in match.match_detections(d.where(F.col("run") == run), alone, 0.3).select("image_id", "pos", "gt_pos", "gt_class", "iou").collect()]
        assert got == sorted(want) and len(got) > 10
    with pytest.raises(ValueError):
        match.match_runs(d, t, 64)


def test_value_is_the_same_for_any_image_key(spark):
    rng = random.Random(11)
    rows = [(i, p, p % 3, float(rng.randrange(60)), float(rng.randrange(60)), 20.0, 20.0, rng.choice([0.0, 0.55, 0.6, 0.9]), [rng.choice([0.0, 0.5, 0.9]) for _ in range(3)]) for i in range(80) for p in range(4)]
    raw = spark.createDataFrame(rows, "image_id long, pos int, class_id int, x double, y double, w double, h double, score double, cs array<double>")
    truth = raw.where("pos < 3").select("image_id", "pos", "class_id", (F.col("x") + 2).alias("x"), "y", "w", "h")
    classes = spark.createDataFrame([(k, f"c{k}") for k in range(3)], "class_id int, class_name string")
    text = lambda df: df.withColumn("image_id", F.format_string("img_%04d.jpg", "image_id"))
    pair = lambda df: df.withColumn("image_id", F.struct((F.col("image_id") % 7).alias("folder"), "image_id"))
    found = [sorted(tuple(r) for r in evaluate_model(f(raw), f(truth), classes, 3)[1].select("class_id", "ap", "prediction_count").collect()) for f in (lambda df: df, text)]
    assert found[0] == found[1] and any(0 < ap < 1 for _, ap, _ in found[0])
    assert len(evaluate_model(pair(raw), pair(truth), classes, 3)[1].collect()) == 3

"""Whole analyses as one call, on images that have nothing, tiny chunks and keys that are text."""

import pytest

from detframe.plans import reports

BOX = "image_id string, pos int, class_id int, x double, y double, w double, h double"
BOXES = [("a", 0, 0, 0.0, 0.0, 9.0, 9.0), ("a", 1, 1, 1.0, 0.0, 9.0, 9.0), ("a", 5, 0, 50.0, 0.0, 9.0, 9.0), ("b", 0, 1, 0.0, 0.0, 9.0, 9.0), ("x", 0, 1, 0.0, 0.0, 9.0, 9.0)]


@pytest.fixture(scope="module")
def tables(spark):
    images = spark.createDataFrame([("a", "a.jpg"), ("b", "b.jpg"), ("c", "c.jpg")], "image_id string, image_file string")
    truth = spark.createDataFrame([b for b in BOXES if b[0] != "x"], BOX)
    scored = [(*b, 0.9 - b[1] / 10, [0.9, 0.1] if b[2] == 0 else [0.1, 0.9]) for b in BOXES if b[0] != "x"]
    dets = spark.createDataFrame(scored, BOX + ", score double, cs array<double>")
    classes = spark.createDataFrame([(0, "cat"), (1, "dog")], "class_id int, class_name string")
    return images, truth, dets, classes


def test_lists_of_images_in_chunks(spark, tables):
    images, _, dets, _ = tables
    rows = reports.image_lists(images, dets, spark.createDataFrame(BOXES, BOX), chunk=2).collect()
    got = {(r.image_id, r.chunk): ([d.pos for d in r.detections], [b.pos for b in r.boxes]) for r in rows}
    assert got == {("a", 0): ([0, 1], [0, 1]), ("a", 2): ([5], [5]), ("b", 0): ([0], [0]), ("c", 0): ([], [])} and len(rows) == 4
    empty = reports.image_lists(images.limit(0), dets, dets.drop("score", "cs"))
    assert empty.count() == 0


def test_two_models_in_one_call(tables):
    images, truth, dets, classes = tables
    report = reports.compare_models({"all": dets, "few": dets.where("class_id = 0")}, truth, classes, 2, limit=3)
    summary = {r.model: r.predictions for r in report.summary.collect()}
    assert summary["all"] > summary["few"] > 0
    better = {r.class_name: (r.better_model, r.all_ap > r.few_ap) for r in report.comparison.collect()}
    assert better["dog"] == ("all", True) and better["cat"][0] != "few"
    with pytest.raises(ValueError, match="two models"):
        reports.compare_models({"all": dets}, truth, classes, 2)


def test_dataset_and_overlap_in_one_call(spark, tables):
    images, truth, _, classes = tables
    data = reports.profile_dataset(images, truth, classes)
    row = data.summary.first()
    assert (row.images, row.total_objects, row.images_with_zero_objects, row.median_objects_per_image) == (3, 4, 1, 1.0)
    assert {r.class_name: r.object_count for r in data.classes.collect()} == {"cat": 2, "dog": 2}
    # an image without objects counts in the lowest bucket
    assert {r.density_bucket: r.image_count for r in data.density.collect() if r.image_count} == {"1": 2, "2-4": 1}
    assert {r.num_objects: r.image_count for r in data.object_counts.collect()} == {0: 1, 1: 1, 3: 1}
    over = reports.profile_overlap(images, truth)
    assert over.summary.first().images_with_any_iou_gt_0_5 == 1 and sum(r.image_count for r in over.crowding.collect()) == 3


def test_weightings_in_one_call(tables):
    images, truth, dets, classes = tables
    report = reports.sweep_weightings(images, dets, truth, classes, n=2)
    assert report.components.count() == 3 and report.scales.count() == 4
    assert {r.top_n for r in report.summary.collect()} == {2}
    assert all(r.jaccard_overlap == 1.0 for r in report.overlap.where("config_a = config_b").collect())

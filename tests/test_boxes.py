import math

import brute
import pytest
from pyspark.sql import functions as F

from detframe.functions import geometry, scores
from detframe.operators import pairs, suppress

SCHEMA = "image_id bigint, pos int, class_id int, x double, y double, w double, h double, score double, cs array<double>"
TRUTH = "image_id bigint, pos int, class_id int, x double, y double, w double, h double"


def frame(spark, rows, schema=SCHEMA):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_iou_cases(spark):
    rows = [
        (0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0, 1.0),
        (0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 10.0, 10.0, 0.0),
        (0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 10.0, 10.0, 1 / 3),
        (0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0),
        (0.0, 0.0, -5.0, 10.0, 0.0, 0.0, 10.0, 10.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double, want double")
    a, b = [F.col(f"a{c}") for c in "xywh"], [F.col(f"b{c}") for c in "xywh"]
    for row in df.select("want", geometry.iou_xywh(a, b).alias("i"), geometry.iou_xywh(b, a).alias("j")).collect():
        assert row.i == pytest.approx(row.want) and row.i == row.j


def test_missing_box_has_no_iou(spark):
    df = spark.sql("select cast(null as double) n, 1D one")
    value = geometry.iou_xywh([F.col("one")] * 4, [F.col("n")] * 4)
    assert df.select(value.alias("i")).first().i is None


def test_flips_and_resize(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0, 20, 10)], "x1 double, y1 double, x2 double, y2 double, width int, height int")
    once = geometry.flip_boxes(df, "horizontal", "xyxy")
    assert once.first()[:4] == (15.0, 2.0, 19.0, 9.0)
    assert geometry.flip_boxes(once, "horizontal", "xyxy").collect() == df.collect()
    assert geometry.resize_boxes(df, target=(40, 10), box_format="xyxy").first()[:4] == (2.0, 2.0, 10.0, 9.0)
    # 20 * 0.125 = 2.5 goes to the even 2, 10 * 0.125 = 1.25 to 1.
    small = geometry.target_size(F.col("width"), F.col("height"), scale=0.125)
    assert df.select(*[s.alias(n) for s, n in zip(small, "wh")]).first() == (2, 1)
    for bad in (lambda: geometry.resize_boxes(df), lambda: geometry.resize_boxes(df, scale=0), lambda: geometry.flip_boxes(df, "horizontal", "other")):
        with pytest.raises(ValueError):
            bad()


def test_score_vectors(spark):
    df = spark.createDataFrame([([0.2, 0.9, 0.9], 1, 0.5)], "cs array<double>, class_id int, score double")
    s, c, k = F.col("score"), F.col("cs"), F.col("class_id")
    pick = lambda e: df.select(e.alias("v")).first().v
    assert pick(scores.conform(c, 2)) == [0.2, 0.9] and pick(scores.conform(c, 4)) == [0.2, 0.9, 0.9, 0.0]
    assert pick(scores.argmax(c)) == 1
    assert pick(scores.evaluation_vector(s, c, k, 3, "combined")) == [0.1, 0.45, 0.45]
    assert pick(scores.evaluation_vector(s, c, k, 3, "objectness")) == [0.0, 0.5, 0.0]
    assert pick(scores.class_score(c, F.lit(7))) == 0.0 and pick(scores.class_score(c, F.lit(-1))) == 0.0
    with pytest.raises(ValueError):
        scores.evaluation_vector(s, c, k, 3, "other")


@pytest.mark.parametrize("value", [0.835, 0.125, 0.375, 0.005, 0.995, 1.0, 0.0, 0.8350000000000001])
def test_two_decimals(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(scores.two_decimals(F.col("v")).alias("t")).first().t
    assert got == f"{value:.2f}"


def test_suppression_hand_cases(spark):
    def kept(rows, t=0.5):
        data = [dict(zip(("image_id", "pos", "x", "y", "w", "h", "score"), r), class_id=0, cs=[0.0]) for r in rows]
        return {r.pos for r in suppress.suppress(frame(spark, data), t).collect()}

    # IoU exactly at the threshold survives; a score at the threshold and NaN do not; ties go to the later box.
    half = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 5.0, 0.8)]
    assert kept(half, 0.5) == {0, 1} and kept(half, 0.49) == {0}
    assert kept([(1, 0, 0.0, 0.0, 9.0, 9.0, 0.5), (1, 1, 50.0, 0.0, 9.0, 9.0, math.nan), (1, 2, 90.0, 0.0, 9.0, 9.0, 0.6)]) == {2}
    assert kept([(1, 0, 0.0, 0.0, 9.0, 9.0, 0.7), (1, 1, 0.0, 0.0, 9.0, 9.0, 0.7)]) == {1}
    assert kept([]) == set()
    with pytest.raises(ValueError):
        suppress.suppress(frame(spark, []), -0.1)


@pytest.mark.parametrize("limit", [1024, 3])
def test_suppression_against_loop(spark, limit):
    rows = brute.boxes(5)
    found = suppress.suppress_sweep(frame(spark, rows), [0.3, 0.6], limit=limit).collect()
    for t in (0.3, 0.6):
        assert {(r.image_id, r.pos) for r in found if r.nms_threshold == t} == brute.suppressed(rows, t)
        assert sum(r.nms_threshold == t for r in found) == len(brute.suppressed(rows, t))


def test_hot_image_in_slices(spark):
    """One image holds almost all boxes and is settled in several slices."""
    rows = brute.boxes(8, images=1, per_image=120, spread=200) or brute.boxes(9, images=1, per_image=120, spread=200)
    rows = [dict(r, score=0.5 + (r["pos"] * 37 % 100 + 1) / 250) for r in rows]
    dets = frame(spark, rows).select("image_id", "pos", "score", "x", "y", "w", "h")
    hot = pairs.hot_images(dets, limit=10)
    got = suppress._suppress_hot(dets, 0.4, hot, first=10).collect()
    assert {tuple(r) for r in got} == brute.suppressed(rows, 0.4) and len(got) == len(set(got))


@pytest.mark.parametrize("limit", [1024, 3])
def test_pairs_against_loop(spark, limit):
    rows = brute.boxes(11)
    got = {(r.image_id, r.l_pos, r.r_pos): r.iou for r in pairs.box_pairs(frame(spark, rows), limit).collect()}
    want = {}
    for image, group in brute.by_image(rows).items():
        for a in group:
            for b in group:
                if a["pos"] < b["pos"] and brute.iou(a, b) > 0:
                    want[(image, a["pos"], b["pos"])] = brute.iou(a, b)
    assert got == want
    same = {(r.image_id, r.l_pos, r.r_pos) for r in pairs.duplicate_pairs(frame(spark, rows), limit=limit).collect()}
    cls = {(r["image_id"], r["pos"]): r["class_id"] for r in rows}
    assert same == {k for k, v in want.items() if v > 0.5 and cls[k[0], k[1]] == cls[k[0], k[2]]}


def test_array_form_equals_table_form(spark):
    rows = brute.boxes(13)
    df = frame(spark, rows)
    nested = df.groupBy("image_id").agg(F.collect_list(F.struct("pos", "x", "y", "w", "h", "score")).alias("d"))
    out = nested.select("image_id", F.explode(suppress.suppress_array(F.col("d"), 0.3)).alias("k")).select("image_id", "k.pos").collect()
    assert {tuple(r) for r in out} == brute.suppressed(rows, 0.3)


def test_hot_images_copy_boxes_by_their_number(spark):
    """An image of few boxes has one grid and no salts, however low the limit; one of many has all, with the same pairs."""
    df = frame(spark, brute.boxes(17)).select("image_id", "pos", "x", "y", "w", "h")
    few, many = pairs.hot_images(df, limit=3), pairs.hot_images(df, limit=3, room=3)
    assert few.where("salts <> 1 or size(levels) <> 1").count() == 0
    assert many.where("salts > 1").count() > 0
    assert pairs._cells(df, few).count() <= 4 * df.count()
    found = [
        {(r.image_id, r.l_pos, r.r_pos, r.iou) for r in pairs.hot_pairs(df, df, hot, lambda: F.col("l_pos") < F.col("r_pos")).collect()}
        for hot in (few, many)
    ]
    ids = {r.image_id for r in few.collect()}
    plain = {(r.image_id, r.l_pos, r.r_pos, r.iou) for r in pairs.box_pairs(df).collect() if r.image_id in ids}
    assert found[0] == found[1] == plain and plain

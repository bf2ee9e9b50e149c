"""Scan lines against plain loops over numpy arrays; images of several bands, short lines, broken lines, box arrays, curves with ties at zero."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from checks import fixtures
from detframe.functions import geometry
from detframe.operators import augment, curves, scanlines


def table(spark, image, key=1):
    h, w = image.shape
    rows = [(key, y, x, 0, int(image[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, c int, v int"), spark.createDataFrame([(key, w, h)], "image_id bigint, width int, height int")


def array(df):
    got = df.collect()
    out = np.full((max(r.y for r in got) + 1, max(r.x for r in got) + 1), -1)
    for r in got:
        assert out[r.y, r.x] == -1
        out[r.y, r.x] = r.v
    return out


def noise(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w))


def mirror(i, n):
    if n == 1:
        return 0
    i %= 2 * (n - 1)
    return min(i, 2 * (n - 1) - i)


def blur_loop(image, k):
    half = len(k) // 2

    def one(a):
        n = a.shape[0]
        return sum(w * a[[mirror(i + j - half, n) for i in range(n)]] for j, w in enumerate(k))

    return one(one(image.T.astype(float)).T)


@pytest.mark.parametrize("h,w,size", [(1, 3, 5), (3, 1, 9), (65, 2, 5), (150, 2, 31), (130, 2, 151)])
def test_blur_over_bands(spark, h, w, size):
    image = noise(h, w)
    got = array(augment.blur(table(spark, image)[0], size))
    assert got.shape == image.shape and np.abs(got - blur_loop(image, augment.gaussian_kernel(size))).max() <= 0.5 + 1e-6


def cubic(t, a=-0.75):
    t = abs(t)
    return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


def weights(n, m, kind):
    """Target by source weights, from the definition of each kind."""
    out, r = np.zeros((m, n)), n / m
    for i in range(m):
        centre = (i + 0.5) * r - 0.5
        if kind == "nearest":
            out[i, min(math.floor(i * r), n - 1)] = 1
        elif kind == "area" and n > m:
            for s in range(n):
                out[i, s] = max(0.0, min(s + 1, (i + 1) * r) - max(s, i * r)) / r
        elif kind == "cubic":
            for s in range(math.floor(centre) - 1, math.floor(centre) + 3):
                out[i, min(max(s, 0), n - 1)] += cubic(s - centre)
        else:
            place = min(max(centre, 0), n - 1)
            low = math.floor(place)
            out[i, low] += 1 - (place - low)
            out[i, min(low + 1, n - 1)] += place - low
    return out


@pytest.mark.parametrize("kind", sorted(scanlines.INTERPOLATIONS))
@pytest.mark.parametrize("h,w,target", [(70, 3, (5, 150)), (150, 4, (3, 9))])
def test_resize_over_bands(spark, kind, h, w, target):
    image = noise(h, w, 7)
    px, images = table(spark, image)
    got = array(augment.resize(px, images, target=target, interpolation=kind))
    want = weights(h, target[1], kind) @ (image @ weights(w, target[0], kind).T)
    assert got.shape == (target[1], target[0]) and np.abs(got - np.clip(want, 0, 255)).max() <= 0.5 + 1e-6


def test_a_chain_shuffles_lines_once_for_each_stage_that_moves(spark):
    image = noise(70, 3, 3)
    px, images = table(spark, image)
    plan = spark.createDataFrame([(1, ["gaussian_blur", "vertical_flip", "resize", "change_brightness"])], "image_id bigint, chain array<string>")
    out = augment.apply_plan(px, images, plan, scale=2.0)
    sized = images.select("image_id", (F.col("width") * 2).alias("width"), (F.col("height") * 2).alias("height"))
    steps = augment.brightness(augment.resize(augment.vflip(augment.blur(px), images), images, scale=2.0))
    assert (array(out) == array(steps)).all() and sized.first()[1:] == array(out).shape[::-1]
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # pixels to lines, lines to sizes and plan, both of these, and at most one for the blur and one for the resize
    assert text.count("Exchange hashpartitioning") <= 6 and "Scan parquet" not in text


def test_broken_lines_raise(spark):
    rows = {"hole": [(0, 5), (2, 5)], "twice": [(0, 5), (0, 6), (1, 5)], "null": [(0, None)], "late": [(1, 5)]}
    for cells in rows.values():
        px = spark.createDataFrame([(1, 0, x, 0, v) for x, v in cells], "image_id bigint, y int, x int, c int, v int")
        with pytest.raises(Exception, match="broken line"):
            augment.blur(px).collect()
    none = spark.createDataFrame([], "image_id bigint, y int, x int, c int, v int")
    assert augment.blur(none).count() == 0
    with pytest.raises(ValueError, match="interpolation"):
        augment.resize(px, spark.createDataFrame([(1, 1, 1)], "image_id bigint, width int, height int"), scale=1.0, interpolation="odd")


def test_text_keys_get_a_chain(spark):
    images = spark.range(60).select(F.concat(F.lit("p"), "id").alias("image_id"))
    chains = {r.image_id: r.chain for r in augment.augment_plan(images, 3).collect()}
    assert len({tuple(c) for c in chains.values()}) > 5
    assert chains == {r.image_id: r.chain for r in augment.augment_plan(images, 3).collect()}


def test_boxes_of_arrays(spark):
    df = spark.createDataFrame(
        [("a", [[1.0, 0.1, 0.2, 0.3, 0.4], [2.0, 0.5, 0.5, 0.5, 0.5, 9.0]]), ("b", []), ("c", None)], "image_id string, boxes array<array<double>>")
    rows = geometry.boxes_of_arrays(df).orderBy("pos").collect()
    assert [(r.image_id, r.pos, r.class_id, r.extra) for r in rows] == [("a", 0, 1, []), ("a", 1, 2, [9.0])]
    assert rows[0].cx == float(np.float32(0.1)) and geometry.boxes_of_arrays(df, box_format="xyxy").columns[3:7] == ["x1", "y1", "x2", "y2"]
    for bad in ([[1.0, 2.0, 3.0, 4.0]], [None], [[1.0, None, 3.0, 4.0, 5.0]]):
        broken = spark.createDataFrame([("a", bad)], "image_id string, boxes array<array<double>>")
        with pytest.raises(Exception, match="N x 5"):
            geometry.boxes_of_arrays(broken).collect()
    with pytest.raises(ValueError, match="array of arrays"):
        geometry.boxes_of_arrays(df.select("image_id", F.array(F.lit(1.0)).alias("boxes")))


# ---- curves with ties at zero -------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_curve_with_many_zeros_and_scores_below(spark, seed):
    rng = random.Random(seed)
    made = []
    for k in range(120):
        missed = rng.random() < 0.6
        scores = [0.0] * 6 if missed else [rng.choice([0.0, 0.0, 0.25, 0.5, -0.5]) for _ in range(rng.choice([3, 6]))]
        made.append((rng.randrange(30), int(missed), rng.choice([0.1, 0.2]), k, rng.randrange(-1, 6), scores))
    rows = spark.createDataFrame(made, "image_id bigint, kind int, det_score double, pos int, y_true int, scores array<double>")
    found = curves.pr_curve(rows, 6)
    want = sorted(made, key=lambda r: (r[0], r[1], -r[2], r[3]))
    want = [(r[4], r[5] + [0.0] * (6 - len(r[5]))) for r in want]
    got = found.orderBy("class_id", "rank").collect()
    for cls in range(6):
        own = [r for r in got if r.class_id == cls]
        assert [r["rank"] for r in own] == list(range(1, len(made) + 1))
        assert [(r.precision, r.recall, r.threshold) for r in own] == brute.curve(want, cls)


def test_whole_numbers_are_gathered_packed(spark):
    """Any int value survives the packing, other types go unpacked, and a null or a hole still raises."""
    ends = [-(2**31), -1, 0, 255, 2**31 - 1]
    rows = [(1, 0, x, 0, v) for x, v in enumerate(ends)]
    pixels = spark.createDataFrame(rows[::-1], "image_id bigint, y int, x int, c int, v int")
    assert scanlines.lines_of(pixels).first().vals == [float(v) for v in ends]
    assert scanlines.lines_of(pixels.withColumn("v", F.col("v") + 0.5)).first().vals == [v + 0.5 for v in ends]
    for bad in (F.when(F.col("x") != 2, F.col("v")), F.lit(None).cast("int")):
        with pytest.raises(Exception, match="broken line"):
            scanlines.lines_of(pixels.withColumn("v", bad)).collect()
    with pytest.raises(Exception, match="broken line"):
        scanlines.lines_of(pixels.where("x <> 4 and x <> 1")).collect()


def test_pixels_of_an_image_share_a_partition(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "PIXEL_IMAGES", 50)
    f = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    pixels = f("fx_pixels")
    assert pixels.rdd.getNumPartitions() == f("fx_images").count() // 50 + 1
    spread = pixels.withColumn("p", F.spark_partition_id()).groupBy("image_id").agg(F.countDistinct("p").alias("n"), F.count("*").alias("rows"))
    assert spread.where("n <> 1 or rows <> 288").count() == 0

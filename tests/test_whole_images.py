"""Images taken whole against scan lines and plain loops; what the pixel queries move and spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import registry
from checks import queries_frames, queries_hot  # noqa: F401
from detframe.operators import augment, scanlines, wholeimages
from test_scanlines import array, blur_loop, noise, table, weights

PIXELS = "image_id bigint, y int, x int, c int, v int"
SHAPES = [(1, 1), (1, 7), (6, 1), (5, 7), (8, 12), (8, 12), (30, 4), (3, 70)]


def gallery(spark):
    """Images of several shapes, channels with odd numbers, in no order."""
    rows = [(k, y, x, c, int(v)) for k, s in enumerate(SHAPES) for c in (-1, 300) for (y, x), v in np.ndenumerate(noise(*s, seed=7 * k + c + 1))]
    order = np.random.default_rng(5).permutation(len(rows))
    sizes = [(k, w, h) for k, (h, w) in enumerate(SHAPES)]
    return spark.createDataFrame([rows[i] for i in order], PIXELS), spark.createDataFrame(sizes, "image_id bigint, width int, height int")


def same_both_ways(make, monkeypatch):
    """Rows with all images whole, with images above 60 pixels as lines and with all as lines."""
    found = []
    for limit in (1 << 16, 60, -1):
        monkeypatch.setattr(wholeimages, "WHOLE", limit)
        found.append(sorted(map(tuple, make().collect()), key=repr))
    assert found[0] == found[1] == found[2] and found[0]
    return found[0]


def query_plan(spark, name):
    return registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_conditions_whole_and_as_lines(spark, monkeypatch):
    px, images = gallery(spark)
    pixels = same_both_ways(lambda: augment.by_condition(px, images), monkeypatch)
    assert len(pixels) == 5 * px.count()
    as_lines = same_both_ways(lambda: augment.by_condition(px, images, as_lines=True), monkeypatch)
    assert sum(len(r[3]) for r in as_lines) == len(pixels)


def test_conditions_move_and_sort_no_pixels(spark):
    """only images are dealt out, nothing else is shuffled or sorted as rows."""
    text = query_plan(spark, "pixels_by_condition")
    assert text.count("Exchange hashpartitioning") <= 1 and "Union" not in text and "Generate" not in text and "SortMergeJoin" not in text


def test_broken_images_raise(spark):
    images = spark.createDataFrame([(1, 3, 1)], "image_id bigint, width int, height int")
    rows = {
        "hole": [(0, 0, 5), (0, 2, 5)], "twice": [(0, 0, 5), (0, 1, 6), (0, 1, 5)], "twice for one": [(0, 0, 5), (0, 0, 5), (0, 2, 5)], "null": [(0, 0, None)],
        "below": [(0, -1, 5), (0, 0, 5)], "far": [(0, 0, 5), (0, 65536, 5)], "place": [(0, None, 5)], "line": [(0, 0, 5), (2, 0, 5)],
    }
    for cells in rows.values():
        px = spark.createDataFrame([(1, y, x, 0, v) for y, x, v in cells], PIXELS)
        with pytest.raises(Exception, match="broken line"):
            augment.blur(px, images=images).collect()
    assert augment.by_condition(px.limit(0), images).count() == 0
    ends = [-(2**31), -1, 0, 2**31 - 1]
    px = spark.createDataFrame([(1, 0, x, 0, v) for x, v in enumerate(ends)], PIXELS)
    plain = augment.by_condition(px, images, as_lines=True).where("condition = 'original'")
    assert plain.first().vals == ends


@pytest.mark.parametrize("size", [1, 5, 9, 31])
def test_blur_whole_and_as_lines(spark, monkeypatch, size):
    px, images = gallery(spark)
    same_both_ways(lambda: augment.blur(px, size, 1.3 if size == 31 else 0.0, images=images), monkeypatch)
    # sizes read off the pixels
    assert sorted(augment.blur(px, size).collect()) == sorted(augment.blur(px, size, images=images).collect())
    image = noise(9, 12)
    got = array(augment.blur(table(spark, image)[0], size))
    assert np.abs(got - blur_loop(image, augment.gaussian_kernel(size))).max() <= 0.5 + 1e-6


def test_blurred_pixels_are_not_gathered_again(spark):
    """lines come out as they are written, they are not spread to pixels and sorted back."""
    text = query_plan(spark, "pixels_blur")
    assert "Generate" not in text and text.count("collect_list") <= 2 and "MapInArrow" in text


def test_chains_whole_and_as_lines(spark, monkeypatch):
    px, images = gallery(spark)
    plan = augment.augment_plan(images, 7)
    assert len({tuple(r.chain) for r in plan.collect()}) > 3
    same_both_ways(lambda: augment.apply_plan(px, images, plan), monkeypatch)
    odd = images.select("image_id", F.when(F.col("image_id") % 2 == 0, F.array(F.lit(None).cast("string"), F.lit("vertical_flip"))).alias("chain"))
    same_both_ways(lambda: augment.apply_plan(px, images, odd), monkeypatch)


def test_a_chain_of_small_images_is_one_pass(spark):
    """a single gathering, whatever the number of stages."""
    text = query_plan(spark, "pixels_augmented")
    assert "Generate" not in text and text.count("MapInArrow") == 1 and text.count("collect_list") <= 2


@pytest.mark.parametrize("kind", sorted(scanlines.INTERPOLATIONS))
def test_resize_whole_and_as_lines(spark, monkeypatch, kind):
    px, images = gallery(spark)
    assert sorted(wholeimages.TAPS) == sorted(scanlines.INTERPOLATIONS)
    for size in ({"target": (5, 9)}, {"scale": 2.0}):
        same_both_ways(lambda: augment.resize(px, images, interpolation=kind, **size), monkeypatch)
    plan = images.select("image_id", F.array(F.lit("gaussian_blur"), F.lit("resize"), F.lit("vertical_flip"), F.lit("resize")).alias("chain"))
    same_both_ways(lambda: augment.apply_plan(px, images, plan, scale=1.5, interpolation=kind), monkeypatch)
    image = noise(8, 12, 7)
    got = array(augment.resize(*table(spark, image), target=(5, 9), interpolation=kind))
    want = weights(8, 9, kind) @ (image @ weights(12, 5, kind).T)
    assert got.shape == (9, 5) and np.abs(got - np.clip(want, 0, 255)).max() <= 0.5 + 1e-6


def test_resized_chains_are_one_pass(spark):
    """images grow inside their task, no line is dealt to bands."""
    text = query_plan(spark, "pixels_augmented_resize")
    assert "Generate" not in text and text.count("MapInArrow") == 1 and text.count("collect_list") <= 2
    px, images = gallery(spark)
    with pytest.raises(Exception, match="no pixel left"):
        augment.resize(px, images, scale=0.1).collect()

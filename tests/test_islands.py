"""Suppression and matching of large images by islands, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from detframe.operators.islands import component_roots, fold_islands, lost_boxes
from detframe.operators.match import match_detections
from detframe.operators.suppress import suppress
from tests import brute

CHAIN = 5_000


def iou(a, b):
    return brute.iou(dict(zip("xywh", a)), dict(zip("xywh", b)))


DETS = "image_id string, pos int, class_id int, x double, y double, w double, h double, score double, cs array<double>"
TRUTH = "image_id string, pos int, class_id int, x double, y double, w double, h double"


def jobs_of(spark, name, run):
    """Result of ``run`` and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def chain(n, shift=0.0):
    return [("long.jpg", k, 0, 4.0 * k + shift, 0.0, 10.0, 10.0) for k in range(n)]


def test_a_chain_of_overlaps_takes_a_fixed_number_of_jobs(spark):
    counts = []
    for n in (2_500, CHAIN):
        rows = [(*box, 1 - k / (4 * CHAIN), [1.0]) for k, box in enumerate(chain(n))]
        dets = spark.createDataFrame(rows, DETS)
        kept, jobs = jobs_of(spark, f"nms-{n}", lambda: sorted(r.pos for r in suppress(dets, 0.4).collect()))
        assert kept == list(range(0, n, 2))
        counts.append(jobs)
    assert max(counts) < 60, counts


def test_a_chain_of_matches_takes_a_fixed_number_of_jobs(spark):
    counts = []
    for n in (2_500, CHAIN):
        # each detection prefers the box after its own, which the one before has taken by then
        truth = spark.createDataFrame(chain(n), TRUTH)
        rows = [(*box, 1 - k / (4 * CHAIN), [1.0]) for k, box in enumerate(chain(n, 2.0))]
        found, jobs = jobs_of(spark, f"match-{n}", lambda: {r.pos: r.gt_pos for r in match_detections(spark.createDataFrame(rows, DETS), truth, 0.4).collect()})
        taken, want = set(), {}
        for k in range(n):
            free = [g for g in (k, k + 1) if g < n and g not in taken]
            if free:
                want[k] = free[0]
                taken.add(free[0])
        assert found == want
        counts.append(jobs)
    assert counts[0] == counts[1] < 40, counts


@pytest.fixture(scope="module")
def crowd(spark):
    """Clusters, a pile of copies, lone boxes, equal scores; keys are file names."""
    rng = random.Random(3)
    boxes = []
    for i in ("a.jpg", "b.jpg"):
        for p in range(60):
            at = 100 * rng.randrange(6)
            boxes.append((i, p, rng.randrange(3), at + float(rng.randrange(12)), float(rng.randrange(12)), 20.0, 20.0))
        boxes += [(i, p, 1, 900.0, 900.0, 30.0, 30.0) for p in range(60, 75)]
        boxes += [(i, p, 1, 2000.0 + 50 * p, 0.0, 9.0, 9.0) for p in range(75, 80)]
    dets = [(*b, rng.choice([0.6, 0.7, 0.8, 0.9]), [1.0, 0.0, 0.0]) for b in boxes]
    truth = [(i, p, c, x + rng.choice([0.0, 1.0]), y, w, h) for i, p, c, x, y, w, h in boxes if rng.random() < 0.6]
    return dets, truth


@pytest.mark.parametrize("fold", [120, 3])
def test_suppression_of_a_large_image(spark, crowd, fold):
    dets, _ = crowd
    want = set()
    for image in {d[0] for d in dets}:
        kept = []
        for d in sorted((d for d in dets if d[0] == image), key=lambda d: (-d[7], -d[1])):
            if all(iou(k[3:7], d[3:7]) <= 0.4 for k in kept):
                kept.append(d)
        want |= {(image, d[1]) for d in kept}
    got = suppress(spark.createDataFrame(dets, DETS), 0.4, limit=3, fold=fold)
    assert {(r.image_id, r.pos) for r in got.collect()} == want


@pytest.mark.parametrize("fold", [120, 3])
def test_matching_of_a_large_image(spark, crowd, fold):
    dets, truth = crowd
    want = set()
    for image in {d[0] for d in dets}:
        free = [t for t in truth if t[0] == image]
        for d in sorted((d for d in dets if d[0] == image), key=lambda d: (-d[7], d[1])):
            best = max(free, key=lambda t: (iou(d[3:7], t[3:7]), -t[1]), default=None)
            if best is not None and iou(d[3:7], best[3:7]) >= 0.5:
                want.add((image, d[1], best[1]))
                free.remove(best)
    got = match_detections(spark.createDataFrame(dets, DETS), spark.createDataFrame(truth, TRUTH), limit=3, fold=fold)
    assert {(r.image_id, r.pos, r.gt_pos) for r in got.collect()} == want


def test_empty_inputs_of_large_images(spark):
    dets = spark.createDataFrame([("a", p, 0, 0.0, 0.0, 0.0, 5.0, 0.9, [1.0]) for p in range(8)], DETS)
    none = spark.createDataFrame([], TRUTH)
    assert suppress(dets, 0.4, limit=3).count() == 8  # flat boxes overlap nothing
    assert match_detections(dets, none, limit=3).count() == 0


def test_roots_of_components(spark):
    rng = random.Random(5)
    pairs = [("a" if rng.random() < 0.5 else "b", rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    pairs = [p for p in pairs if p[1] != p[2]] + [("c", k, k + 1) for k in range(60)]
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for i, a, b in pairs:
        low, high = sorted((find((i, a)), find((i, b))))
        root[high] = low
    got = component_roots(spark.createDataFrame(pairs, "image_id string, p int, q int"), "p", "q")
    assert {(r.image_id, r.node): r.root for r in got.collect()} == {n: find(n)[1] for n in list(root)}
    assert got.groupBy("image_id", "node").count().where(F.col("count") > 1).count() == 0


def test_islands_of_a_task_are_read_one_after_the_other(spark):
    """Islands span Arrow batches, share tasks and keep image keys of any type."""
    rows = [(str(i), 0, w, l, 1.0 - w / 10) for i in range(40) for w, l in ((0, 1), (1, 2), (2, 3), (3, 4))]
    edges = spark.createDataFrame(rows, "image string, island bigint, winner int, loser int, score double")
    edges = edges.select(F.struct("image", F.lit(1).alias("run")).alias("image_id"), "island", "winner", "loser", "score").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fold_islands(edges, [F.col("score").desc(), F.col("winner").desc()], "winner", "loser", lost_boxes)
        assert sorted((int(r.image_id.image), r.loser) for r in got.collect()) == [(i, n) for i in range(40) for n in (1, 3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)

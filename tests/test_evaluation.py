import brute
import pytest
from pyspark.sql import functions as F
from test_boxes import TRUTH, frame

from detframe.operators import curves, loss, match, pairs, profile
from detframe.plans import evaluation


def case(spark, seed):
    dets, truth = brute.boxes(seed), brute.boxes(seed + 100, scored=False)
    return dets, truth, frame(spark, dets), frame(spark, truth, TRUTH)


@pytest.mark.parametrize("seed,limit", [(1, 1024), (2, 1024), (1, 3)])
def test_match_against_loop(spark, seed, limit):
    dets, truth, d, t = case(spark, seed)
    got = [tuple(r)[:4] for r in match.match_detections(d, t, 0.4, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.matched(dets, truth, 0.4)


def test_match_boundary_and_ties(spark):
    box = {"image_id": 1, "class_id": 0, "x": 0.0, "y": 0.0, "w": 10.0, "h": 10.0, "cs": [1.0]}
    dets = [dict(box, pos=0, score=0.7), dict(box, pos=1, score=0.7)]
    truth = [dict(box, pos=0, h=5.0, class_id=3), dict(box, pos=1, h=5.0, class_id=4)]
    got = {tuple(r)[:4] for r in match.match_detections(frame(spark, dets), frame(spark, truth, TRUTH), 0.5).collect()}
    # IoU equal to the threshold matches; the earlier detection and the earlier box go first.
    assert got == {(1, 0, 0, 3), (1, 1, 1, 4)}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_curves_and_ap_against_loop(spark, seed):
    dets, truth, d, t = case(spark, seed)
    want = brute.labelled(dets, truth, 0.4)
    rows = match.evaluation_rows(d, t, 4, 0.4).cache()
    assert rows.count() == len(want)
    points = curves.pr_curve(rows, 4).orderBy("class_id", "rank").collect()
    for cls in range(4):
        got = [(r["precision"], r["recall"], r["threshold"]) for r in points if r["class_id"] == cls]
        assert got == brute.curve(want, cls)
    classes = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "class_id int, class_name string")
    full = {r.class_id: r.ap for r in curves.average_precision(curves.pr_curve(rows, 5), classes).collect()}
    fast = {r.class_id: r.ap for r in curves.average_precision_of(rows, classes, 5).collect()}
    assert fast == pytest.approx(full) and full[4] == 0.0
    for cls in range(4):
        assert full[cls] == pytest.approx(brute.ap(brute.curve(want, cls)))
    for levels in (1, 5):
        few = {r.class_id: r.ap for r in curves.average_precision_of(rows, classes, 5, levels).collect()}
        for cls in range(4):
            points_of = brute.curve(want, cls)
            expect = brute.ap(points_of, levels) if levels > 1 else max((p for p, _, _ in points_of), default=0.0)
            assert few[cls] == pytest.approx(expect)
    rows.unpersist()


def test_ap_with_negative_scores_and_ties(spark):
    rows = [(i, 0, 0.0, 0, i % 3, [[-0.5, 0.0, 0.25][i * 7 % 3], (i * 37 % 11 - 5) / 10, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id bigint, kind int, det_score double, pos int, y_true int, scores array<double>")
    classes = spark.createDataFrame([(i, "c") for i in range(3)], "class_id int, class_name string")
    fast = {r.class_id: r.ap for r in curves.average_precision_of(df, classes, 3).collect()}
    plain = [(r[4], r[5]) for r in rows]
    assert fast == pytest.approx({c: brute.ap(brute.curve(plain, c)) for c in range(3)})


def test_runs_equal_single_evaluations(spark):
    dets, truth, d, t = case(spark, 6)
    classes = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "class_id int, class_name string")
    both = d.withColumn("model", F.lit("a")).unionByName(d.where("score > 0.6").withColumn("model", F.lit("b")))
    summary, per_class = evaluation.evaluate_runs(both, t, classes, 4, "model", ["a", "b"], 0.4)
    got = {r.model: r for r in summary.collect()}
    for run, rows in (("a", dets), ("b", [x for x in dets if x["score"] > 0.6])):
        want = brute.labelled(rows, truth, 0.4)
        assert got[run].map == pytest.approx(sum(brute.ap(brute.curve(want, c)) for c in range(4)) / 4)
        assert (got[run].predictions, got[run].ground_truth, got[run].evaluation_rows) == (len(rows), len(truth), len(want))
    assert per_class.count() == 8


@pytest.mark.parametrize("limit", [1024, 3])
def test_loss_against_loop(spark, limit):
    dets, truth, d, t = case(spark, 7)
    images = spark.range(7).withColumnRenamed("id", "image_id")
    got = {r.image_id: r for r in loss.loss_components(images, d, t, 0.4, limit).collect()}
    by_d, by_t = brute.by_image(dets), brute.by_image(truth)
    for image in range(7):
        loc = obj = noobj = cls = hits = 0
        seen = set()
        for p in by_d.get(image, []):
            scored = [(brute.iou(p, g), -g["pos"], g) for g in by_t.get(image, [])]
            best = max(scored, key=lambda s: s[:2], default=(0, 0, None))
            if best[0] > 0 and best[0] >= 0.4:
                g = best[2]
                a = (p["x"], p["y"], p["x"] + p["w"], p["y"] + p["h"])
                b = (g["x"], g["y"], g["x"] + g["w"], g["y"] + g["h"])
                loc += sum((u - v) ** 2 for u, v in zip(a, b))
                obj += (1 - p["score"]) ** 2
                cls += (1 - p["cs"][g["class_id"]]) ** 2
                hits += 1
                seen.add(g["pos"])
            else:
                noobj += p["score"] ** 2
        r = got[image]
        assert (r.loc_loss, r.conf_loss_obj, r.conf_loss_noobj, r.class_loss) == pytest.approx((loc, obj, noobj, cls))
        assert (r.matched_prediction_count, r.matched_gt_count) == (hits, len(seen))
        assert r.missed_gt_count == len(by_t.get(image, [])) - len(seen)


def test_hot_best_ground_truth(spark):
    _, _, d, t = case(spark, 8)
    cool = pairs.best_ground_truth(d, t, 0.3).orderBy("image_id", "pos").collect()
    assert pairs.best_ground_truth(d, t, 0.3, limit=2).orderBy("image_id", "pos").collect() == cool


def pile(count, x, scored):
    """Many exact copies of one box, and a few other boxes around it."""
    box = {"image_id": 1, "class_id": 0, "y": 0.0, "w": 20.0, "h": 20.0}
    rows = [dict(box, pos=p, x=x if p % 4 else x + p % 3) for p in range(count)]
    return [dict(r, score=0.5 + r["pos"] * 7 % 13 / 40, cs=[0.5]) for r in rows] if scored else rows


def test_piles_of_copies(spark):
    dets, truth = pile(40, 3.0, True), pile(30, 4.0, False)
    d, t = frame(spark, dets), frame(spark, truth, TRUTH)
    got = [tuple(r)[:4] for r in match.match_detections(d, t, 0.5, limit=5).collect()]
    assert len(got) == len(set(got)) == 30 and set(got) == brute.matched(dets, truth, 0.5)
    cool = pairs.best_ground_truth(d, t, 0.3).orderBy("pos").collect()
    assert pairs.best_ground_truth(d, t, 0.3, limit=5).orderBy("pos").collect() == cool
    images = spark.createDataFrame([(1,)], "image_id bigint")
    whole, split = (profile.overlap_profile(images, t, limit).first() for limit in (1024, 5))
    assert whole.pairs_iou_gt_0_5 == split.pairs_iou_gt_0_5 and whole.pair_count == 30 * 29 // 2
    assert split.mean_pairwise_iou == pytest.approx(whole.mean_pairwise_iou)

import random

from pyspark.sql import functions as F

from detframe.operators.curves import average_precision, average_precision_of, pr_curve


def _rows(spark, n=400, classes=3):
    draw = random.Random(7)
    rows = []
    for i in range(n):
        kind = int(i % 4 == 3)
        scores = None if kind else [draw.choice([-0.5, 0.0, 0.0, draw.random()]) for _ in range(draw.choice([2, 3, 4]))]
        rows.append(("ab"[i % 2], i // 5, kind, 0.0 if kind else draw.random(), i, draw.randrange(-1 + kind, classes), scores))
    return spark.createDataFrame(rows, "run string, image_id bigint, kind int, det_score double, pos int, y_true int, scores array<double>")


def test_bucket_counts_give_the_ap_of_the_full_curve(spark):
    rows = _rows(spark)
    classes = spark.createDataFrame([(r, c) for r in "ab" for c in range(4)], "run string, class_id int")
    full = average_precision(pr_curve(rows, 4, ["run"]), classes, by=["run"])
    want = sorted(map(tuple, full.select("run", "class_id", "ap").collect()))
    found = average_precision_of(rows, classes, 4, by=["run"])
    assert sorted(map(tuple, found.select("run", "class_id", "ap").collect())) == want
    named = rows.withColumn("image_id", F.format_string("%05d", "image_id"))
    found = average_precision_of(named, classes, 4, by=["run"])
    assert sorted(map(tuple, found.select("run", "class_id", "ap").collect())) == want


def test_large_buckets_are_ordered_over_slices(spark):
    from detframe.operators.curves import deciding_points

    rows = _rows(spark)
    some = sorted(map(tuple, deciding_points(rows, 3, by=["run"]).collect()))
    assert sorted(map(tuple, deciding_points(rows, 3, by=["run"], bucket=2).collect())) == some


def test_points_of_a_row_are_counted_without_exploding(spark):
    from detframe.operators.curves import deciding_points

    plan = deciding_points(_rows(spark), 3, by=["run"])._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower() and "rangepartitioning" not in plan.lower()


def test_runs_are_labelled_without_moving_vectors(spark):
    from detframe.operators.match import label_runs
    from detframe.session import materialize

    det = [(i, p, 1, 10.0 * p, 0.0, 9.0, 9.0, 0.9 - p / 10, [0.1, 0.9], r) for i in range(6) for p in range(2) for r in range(2) if (i + p + r) % 3]
    boxes = [(i, p, 0, 10.0 * p, 0.0, 9.0, 9.0) for i in range(6) for p in range(3)]
    shape = "image_id bigint, pos int, class_id int, x double, y double, w double, h double"
    dets = materialize(spark.createDataFrame(det, f"{shape}, score double, cs array<double>, run int"), "dets", "image_id")
    truth = materialize(spark.createDataFrame(boxes, shape), "truth", "image_id")
    rows = label_runs(dets, truth, 2, 2)
    moved = [line for line in rows._jdf.queryExecution().toString().split("Physical Plan")[-1].splitlines() if "Exchange hash" in line]
    assert not moved
    found = {(r.run, r.image_id, r.kind, r.pos, r.y_true) for r in rows.collect()}
    held = {(d[9], d[0], d[1]) for d in det}
    want = {(r, i, 0, p, 0) for r, i, p in held} | {(r, i, 1, p, 0) for r in range(2) for i in range(6) for p in range(3) if (r, i, p) not in held}
    assert found == want


def test_conditions_of_a_hot_image_are_suppressed_apart(spark):
    from detframe.operators.suppress import suppress_sweep

    draw = random.Random(3)
    rows = [(i, p, c, float(draw.randrange(20)), float(draw.randrange(20)), 15.0, 15.0, draw.random()) for i in range(3) for p in range(6) for c in "ab"]
    dets = spark.createDataFrame(rows, "image_id bigint, pos int, run string, x double, y double, w double, h double, score double")
    keys = ["image_id", "run", "pos"]
    usual = sorted(map(tuple, suppress_sweep(dets, [0.3], 0.1, by="run").select(keys).collect()))
    hot = sorted(map(tuple, suppress_sweep(dets, [0.3], 0.1, limit=3, by="run").select(keys).collect()))
    apart = sorted((r.image_id, c, r.pos) for c in "ab" for r in suppress_sweep(dets.where(F.col("run") == c), [0.3], 0.1).collect())
    assert usual == apart and hot == apart


def _moved(spark, act):
    """Rows that ``act`` shuffles."""
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def rows():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    old = rows()
    act()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for stage, n in rows().items() if stage not in old)


def test_curve_moves_each_scored_point_once_and_zeros_as_rows(spark):
    made = [(i, int(i % 4 > 0), 0.0 if i % 4 else 0.5, i, i % 5, [0.0] * 5 if i % 4 else [(i * 7 + k) % 97 / 100 + 0.01 for k in range(5)]) for i in range(8000)]
    rows = spark.createDataFrame(made, "image_id bigint, kind int, det_score double, pos int, y_true int, scores array<double>")
    moved = _moved(spark, lambda: pr_curve(rows, 5).select("rank", "tp").write.format("noop").mode("overwrite").save())
    # 10,000 scored points once, 6,000 rows of zeros by range and by slice, besides the counts per bucket; all 40,000 points moved twice before
    assert 10_000 <= moved < 50_000


def test_curve_of_large_buckets_nulls_and_runs(spark):
    draw = random.Random(5)
    made = []
    for i in range(300):
        kind = int(draw.random() < 0.5)
        scores = [0.0] * 3 if kind else [draw.choice([None, -0.5, -0.25, 0.0, 0.25, 0.25, draw.random()]) for _ in range(3)]
        made.append(("ab"[i % 2], i // 7, kind, 0.0 if kind else draw.choice([0.1, 0.2]), i, draw.randrange(-1 + kind, 3), scores))
    rows = spark.createDataFrame(made, "run string, image_id bigint, kind int, det_score double, pos int, y_true int, scores array<double>")
    for bucket in (1 << 20, 2):
        got = pr_curve(rows, 3, ["run"], bucket=bucket).collect()
        for run in "ab":
            for cls in range(3):
                own = [r for r in made if r[0] == run]
                own.sort(key=lambda r: (r[6][cls] is not None, r[6][cls] or 0.0, r[1], r[2], -r[3], r[4]), reverse=True)
                hits = [int(r[5] == cls) for r in own]
                want = [(k + 1, sum(hits[: k + 1]), sum(hits), r[6][cls], r[4]) for k, r in enumerate(own)]
                assert sorted((r["rank"], r.tp, r.positives, r.threshold, r.pos) for r in got if r.run == run and r.class_id == cls) == want


def test_a_scored_point_is_shuffled_in_few_columns(spark):
    """its kind is known, class and bucket are one number; no other shuffle carries points."""
    made = [(i, 0, 0.5, i, i % 5, [(i * 7 + k) % 97 / 100 + 0.01 for k in range(5)]) for i in range(50)]
    rows = spark.createDataFrame(made, "image_id bigint, kind int, det_score double, pos int, y_true int, scores array<double>")
    plan = pr_curve(rows, 5)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 1 and "_bucket" in dealt[0] and "class_id" not in dealt[0]
    below = plan[plan.index(dealt[0]):].splitlines()[1]
    assert "Project" in below and "kind" not in below and below.count(",") == 5

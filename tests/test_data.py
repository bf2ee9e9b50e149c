"""Order statistics, samples, profiles, sources and tables."""

import statistics
import struct

import numpy as np
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from detframe.functions import buckets
from detframe.operators import profile, ranking, sampling
from detframe.sources import files as sources
from detframe.sources import frames, labels, tables


def test_running_totals_spread_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", float(i % 4), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    out = ranking.running_totals(df, ["g"], [F.col("v").desc(), F.col("id")], {"n": F.lit(1).cast("bigint"), "s": F.col("v")})
    got = {r.id: (r.n, r.s) for r in out.collect()}
    for g in {r[0] for r in rows}:
        total = 0.0
        for n, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            total += row[1]
            assert got[row[2]] == (n, pytest.approx(total))


def test_exact_quantiles(spark):
    rows = [("a" if i % 2 else "b", float((i * i) % 17)) for i in range(101)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ranking.exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    for r in got:
        values = [v for g, v in rows if g == r.g]
        assert (r.p50, r.p95) == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.95)))
    one = ranking.exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert one == pytest.approx(statistics.median(v for _, v in rows))


def test_hash_spreads_and_seeds_differ(spark):
    df = spark.range(4000).select((F.col("id") * 2**31).alias("image_id"))
    assert df.select(ranking.seeded_hash(F.col("image_id"), 1)).distinct().count() == 4000
    one, other = ({r.image_id for r in ranking.take_by_hash(df, [], "image_id", s, F.lit(1000)).collect()} for s in (1, 2))
    assert len(one) == len(other) == 1000 and 190 < len(one & other) < 310  # a quarter by chance


@pytest.mark.parametrize("n", [0, 1, 37, 199, 200, 500])
def test_take_by_hash_is_the_hash_order(spark, n):
    df = spark.range(200).withColumnRenamed("id", "image_id")
    got = {r.image_id for r in ranking.take_by_hash(df, [], "image_id", 9, F.lit(n), bits=3).collect()}
    order = sorted(range(200), key=lambda i: (md5(f"9:{i}".encode()).hexdigest()[:14], i))
    assert got == set(order[:n])


def index(spark, n=300):
    rows = spark.range(n).select(F.col("id").alias("image_id"), (F.col("id") * F.col("id") % 23).alias("num_objects"))
    return rows.withColumn("density_bucket", buckets.density_bucket(F.col("num_objects")))


def test_stratified_sample(spark):
    idx = index(spark)
    sample = sampling.stratified_sample(idx, "density_bucket", 101, 4)
    rows = sample.collect()
    assert len(rows) == 101 == len({r.image_id for r in rows})
    share = {r.density_bucket: r.available / 300 * 101 for r in sampling.stratified_targets(idx, "density_bucket", 101).collect()}
    for bucket, want in share.items():
        assert abs(sum(r.density_bucket == bucket for r in rows) - want) < 1
    assert sampling.unselected(idx, sample).count() == 199
    assert sampling.random_sample(idx, 55, 1).count() == 55


def test_published_rare_targets(spark):
    """Image counts and targets published for a sample of 5,000 from 9,525 images."""
    published = {272: 143, 192: 101, 226: 119, 183: 100, 292: 154, 299: 157, 372: 196, 291: 153}
    df = spark.createDataFrame([(i, i, n) for i, n in enumerate(published)], "class_id int, object_count int, image_count int")
    got = sampling.rare_class_targets(df, 5000 / 9525).collect()
    assert {r.image_count: r.target_image_count for r in got} == published


@pytest.mark.parametrize("size", [60, 150])
def test_rare_targets_are_enforced(spark, size):
    idx = index(spark)
    presence = idx.select("image_id", F.when(F.col("image_id") % 29 == 0, 1).when(F.col("image_id") % 31 == 0, 2).otherwise(0).alias("class_id"))
    targets = spark.createDataFrame([(1, 11, 11, 10), (2, 9, 9, 9)], "class_id int, object_count int, image_count int, target_image_count int")
    base = sampling.random_sample(idx, size, 3)
    out = {r.image_id for r in sampling.enforce_rare_targets(base, idx, presence, targets, size, 3).collect()}
    assert len(out) == size
    assert sum(i % 29 == 0 for i in out) >= 10 and sum(i % 31 == 0 and i % 29 != 0 for i in out) >= 9


def test_sample_bigger_than_the_set_is_refused(spark):
    idx = index(spark, 20)
    presence = idx.select("image_id", F.lit(1).alias("class_id"))
    targets = spark.createDataFrame([(1, 1, 1, 1)], "class_id int, object_count int, image_count int, target_image_count int")
    with pytest.raises(ValueError):
        sampling.enforce_rare_targets(idx, idx, presence, targets, 30, 1)


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "k int, o int, v string")
    assert {tuple(r) for r in sampling.deduplicate(df, "k", "o").collect()} == {(1, 2, "a"), (2, 9, "c")}


def test_buckets_and_names(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 4, 5, 9, 10, 14, 15, 19, 20)], "n int")
    got = [tuple(r) for r in df.orderBy("n").select(buckets.density_bucket(F.col("n")), buckets.crowding_bucket(F.col("n"))).collect()]
    assert [g[0] for g in got] == ["1", "1", "2-4", "2-4", "5-9", "5-9", "10-14", "10-14", "15-19", "15-19", "20+"]
    assert [g[1] for g in got] == ["0", "1-4", "1-4", "1-4", "5-19", "5-19", "5-19", "5-19", "5-19", "5-19", "20+"]
    names = spark.createDataFrame([("  QR code (2)!",), ("Traffic-Light",)], "s string")
    assert [r[0] for r in names.select(buckets.clean_name(F.col("s"))).collect()] == ["qr_code_2", "traffic_light"]
    lists = spark.createDataFrame([('["a", "b"]',), ("['a', 'b']",), ("plain",), (" ",), (None,)], "s string")
    assert [r[0] for r in lists.select(buckets.parse_list(F.col("s"))).collect()] == [["a", "b"], ["a", "b"], ["plain"], [], []]


def test_overlap_profile_counts_all_pairs(spark):
    rows = [(1, p, 0, float(p * 5), 0.0, 10.0, 10.0) for p in range(5)] + [(2, 0, 0, 0.0, 0.0, 5.0, 5.0)]
    gt = spark.createDataFrame(rows, "image_id bigint, pos int, class_id int, x double, y double, w double, h double")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id bigint")
    got = {r.image_id: r for r in profile.overlap_profile(images, gt).collect()}
    assert got[1].pair_count == 10 and got[1].pairs_iou_gt_0_3 == 4 and got[1].mean_pairwise_iou == pytest.approx(4 / 3 / 10)
    assert (got[2].pair_count, got[3].num_objects, got[3].crowding_bucket) == (0, 0, "0")


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.0 0.5 0.5 0.2 0.2\n\nshort 1\n30 0.1 0.1 0.1 0.1\n 2 0.1 0.2 0.3 0.4 9 \n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("1 2 3\n")
    for name in ("a.jpg", "b.jpg", "d.jpg"):
        (tmp_path / name).write_bytes(b"x")
    files = labels.read_label_files(spark, str(tmp_path))
    assert {r.stem for r in files.collect()} == {"a", "b", "c"}
    got = labels.parse_labels(files, 20).orderBy("pos").select("stem", "pos", "class_id", "h").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1, 0.2), ("a", 4, 2, 0.4)]
    with pytest.raises(Exception, match="without five or more numbers"):
        labels.parse_labels_strict(files).collect()
    paired, missing = labels.pair_by_stem(labels.list_images(spark, str(tmp_path)), files.drop("path"))
    assert {r.stem for r in paired.collect()} == {"a", "b"} and [r.stem for r in missing.collect()] == ["d"]


def test_label_folder_is_dealt_by_files_and_bytes(spark, tmp_path):
    for k in range(10_000):
        (tmp_path / f"{k:05d}.txt").write_text("" if k % 3 else "1 0.1 0.2 0.3 0.4\n")
    files = labels.read_label_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 3
    assert labels.read_label_files(spark, str(tmp_path), most_files=700).rdd.getNumPartitions() == 15
    got = files.selectExpr("count(*) n", "count(distinct stem) stems", "count_if(label_text = '') blank").first()
    assert tuple(got) == (10_000, 10_000, 6_666)
    assert labels.parse_labels(files, 20).count() == 3_334
    assert sources.dealt([("a", 50), ("b", 60 << 20), ("c", 70 << 20), ("d", 1)]) == [["a", "b"], ["c"], ["d"]]
    with pytest.raises(FileNotFoundError):
        labels.read_label_files(spark, str(tmp_path / "none"))


def test_driver_holds_no_names_of_a_folder(spark, tmp_path):
    """The driver lists nothing: partitions name a stored part of the listing, however many files that holds."""
    for k in range(500):
        (tmp_path / f"{k:05d}.txt").write_text("1 0.1 0.2 0.3 0.4\n")
    files = labels.read_label_files(spark, str(tmp_path), most_files=100)
    assert files.rdd.getNumPartitions() == 5
    parts = sources._LabelReader({"place": "/listing", "parts": "5"}, None).partitions()
    assert [p.names for p in parts] == [f"/listing/{k}.json" for k in range(5)]
    assert sorted(r.path for r in files.collect()) == sorted(f"{tmp_path}/{k:05d}.txt" for k in range(500))


def test_image_sizes_from_headers(spark, tmp_path):
    def segment(mark, body):
        return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body

    frame_head = segment(0xC2, struct.pack(">BHHB", 8, 480, 640, 3) + b"\x00" * 9)
    images = {
        "a.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 31, 17) + b"\x08\x02\x00\x00\x00",
        "b.gif": b"GIF89a" + struct.pack("<HH", 9, 4) + b"\x00" * 3,
        "c.bmp": b"BM" + b"\x00" * 16 + struct.pack("<ii", 12, -7),
        "d.jpg": b"\xff\xd8" + segment(0xE0, b"JFIF\x00" + b"\x00" * 9) + b"\xff" + frame_head + b"junk",
        "e.jpg": b"\xff\xd8" + segment(0xE1, b"\x00" * 60_000) + segment(0xC4, b"\x01" * 20) + frame_head,
        "f.jpg": b"\xff\xd8\xff", "g.txt": b"not an image", "h.png": b"",
    }
    for name, data in images.items():
        (tmp_path / name).write_bytes(data)
    got = {r.stem: (r.width, r.height) for r in labels.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a": (31, 17), "b": (9, 4), "c": (12, 7), "d": (640, 480), "e": (640, 480)}
    assert labels.unreadable_images(spark, str(tmp_path)).first().unreadable == 3


def test_class_file(spark, tmp_path):
    path = tmp_path / "names"
    path.write_text("box\n\n van \n")
    assert [tuple(r) for r in labels.read_classes(spark, str(path)).collect()] == [(0, "box"), (1, "van")]
    assert [r.class_name for r in labels.read_classes(spark, str(path), keep_blank=True).collect()][:3] == ["box", "", "van"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_are_written_once(spark, tmp_path, fmt):
    one = spark.createDataFrame([(1, [1, 2])], "a int, l array<int>")
    two = spark.createDataFrame([(2, [3])], "a int, l array<int>")
    path = str(tmp_path / fmt)
    label = tables.sample_label(first=5)
    tables.write_table(one, path, label, fmt=fmt)
    assert tables.write_table(two, path, label, fmt=fmt).first().a == 1
    assert tables.write_table(two, path, label, force=True, fmt=fmt).first().a == 2
    back = tables.read_table(spark, f"{path}/run_label={label}", "a int, l array<int>", fmt)
    assert [tuple(r) for r in back.collect()] == [(2, [3])]


def test_frame_rate_must_be_positive(spark):
    rows = spark.range(10).withColumnRenamed("id", "frame_number")
    assert [tuple(r) for r in frames.every_nth(rows, 4).collect()] == [(0, 0), (4, 1), (8, 2)]
    with pytest.raises(ValueError):
        frames.every_nth(rows, 0)

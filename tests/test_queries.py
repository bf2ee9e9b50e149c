"""Registered queries against their DuckDB text on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.run import compare, connect

SF = "/root/testdata/sf0.001"
FAST = [
    "scan_labels", "class_dim", "index_pairs", "missing_labels", "image_dims_join", "decode_predictions", "flatten_predictions", "batch_score",
    "box_hflip", "box_vflip", "conform_scores", "overlay_rows", "nms_sweep", "duplicate_pairs", "best_gt_per_prediction", "match_detections",
    "eval_rows", "eval_lists", "pr_curve", "ap_per_class", "model_comparison", "dataset_index", "class_shares", "dense_image_counts", "overlap_profile",
    "sample_random", "stratified_targets", "image_loss_components", "component_describe", "component_scales", "lambda_summary", "gt_by_condition", "pixels_resize", "augment_plan",
    "nms_hot", "match_hot", "best_gt_hot", "frame_sampling", "stream_frames", "stream_frame_sampling", "stream_nms", "stream_detection_log", "stream_log_replay", "stream_frame_total",
]


def test_every_query_has_an_oracle():
    assert set(entry.registry.QUERIES) == set(entry.registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None, name


def test_entry(spark):
    assert entry.entry(spark).count() == 1719

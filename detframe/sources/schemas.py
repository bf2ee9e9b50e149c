"""Schemas of the stored tables."""

from __future__ import annotations

CLASSES = "class_id int, class_name string"
IMAGES = "image_id bigint, image_file string, width int, height int"
GROUND_TRUTH = "image_id bigint, pos int, class_id int, x double, y double, w double, h double"
DETECTIONS = GROUND_TRUTH + ", score double, cs array<double>"
RAW_PREDICTIONS = "image_id bigint, layer int, pos int, v array<float>"
FRAMES = "frame_number bigint, ts timestamp, camera_id bigint, image_id bigint"
FRAME_DETECTIONS = (
    "frame_number bigint, dets array<struct<pos:int,class_id:int,x:double,y:double,w:double,h:double,score:double>>"
)
PIXELS = "image_id bigint, y int, x int, c int, v int"
COMPONENTS = (
    "image_id bigint, image_file string, num_objects bigint, density_bucket string, class_names_present array<string>, "
    "loc_loss double, conf_loss_obj double, conf_loss_noobj double, class_loss double, raw_prediction_count bigint, "
    "ground_truth_count bigint, matched_prediction_count bigint, false_positive_prediction_count bigint, "
    "matched_gt_count bigint, missed_gt_count bigint"
)

"""Explicit schemas of the inspection store and of the corpus manifest."""

from __future__ import annotations

# Schemas are DDL text: every Spark reader takes it, and no session is needed to import them.
MATERIAL = ("material_id BIGINT, material_code STRING, material_name STRING, support_status STRING, notes STRING")
DEFECT_CLASS = ("class_id INT, class_code STRING, display_name STRING")
MODEL_VERSION = ("model_version_id BIGINT, file_name STRING, version STRING, artefact_sha256 STRING, parameter_count BIGINT,"
    " size_mb DOUBLE, precision STRING, latency_ms DOUBLE, created_at TIMESTAMP, is_active BOOLEAN")
STATION = ("station_id BIGINT, station_code STRING, line_code STRING, mm_per_pixel DOUBLE, camera_status STRING, created_at TIMESTAMP")
PROFILE = ("profile_id BIGINT, material_id BIGINT, version_no INT, crack_threshold DOUBLE, scratch_threshold DOUBLE,"
    " minimum_area_px INT, minimum_skeleton_px INT, created_at TIMESTAMP, is_active BOOLEAN")
BATCH_RUN = ("batch_run_id BIGINT, source_folder STRING, material_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP,"
    " image_count INT, clean_count INT, regions_found_count INT, failure_count INT, status STRING")
INSPECTION = ("inspection_id BIGINT, station_id BIGINT, profile_id BIGINT, model_version_id BIGINT, material_id BIGINT,"
    " batch_run_id BIGINT, image_sha256 STRING, product_id STRING, captured_at TIMESTAMP, processed_at TIMESTAMP,"
    " status STRING, region_count INT, latency_ms DOUBLE, source_image_path STRING, overlay_image_path STRING,"
    " error_code STRING, error_message STRING")
DEFECT_REGION = ("region_id BIGINT, inspection_id BIGINT, region_index INT, class_id INT, area_px INT, length_px DOUBLE,"
    " max_width_px DOUBLE, bbox_x INT, bbox_y INT, bbox_width INT, bbox_height INT, centroid_x DOUBLE, centroid_y DOUBLE")
STORE = {
    "material": MATERIAL,
    "defect_class": DEFECT_CLASS,
    "model_version": MODEL_VERSION,
    "station": STATION,
    "profile": PROFILE,
    "batch_run": BATCH_RUN,
    "inspection": INSPECTION,
    "defect_region": DEFECT_REGION,
}

MANIFEST = ("name STRING, source STRING, sid STRING, material STRING, tier STRING, role STRING, h INT, w INT, crack_px BIGINT,"
    " crack_px_frac DOUBLE, mean_crack_width DOUBLE, skel_len BIGINT, n_components BIGINT, blur DOUBLE,"
    " brightness DOUBLE, contrast DOUBLE, phash STRING, subsource STRING, `group` STRING, split STRING")

# One canonical inspection record, as logged by a producer.
RECORD = ("image_sha256 STRING, model_version STRING, station_id STRING, product_id STRING, processed_at STRING,"
    " processing_profile STRING, empty BOOLEAN,"
    " regions ARRAY<STRUCT<id: INT, type: STRING, area_px: INT, length_px: DOUBLE, max_width_px: DOUBLE, bbox_xywh: ARRAY<INT>>>")

EVENT = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")

# Fixed values of the data model.
STATUSES = ("regions_found", "clean", "acquisition_failure", "processing_failure")
FAILURES = ("acquisition_failure", "processing_failure")
RUN_STATES = ("running", "completed", "failed", "dry_run")
SUPPORT_STATES = (
    "supported", "one_product_only", "thin_coverage", "typing_unsupported", "not_supported", "under_evaluation",
)
LIMITED_STATES = ("one_product_only", "thin_coverage", "typing_unsupported", "not_supported")
CLASSES = ("crack", "scratch")
TRAIN_SIDE = ("train", "wood_bg")
EVAL_SPLITS = (
    "val", "val_unseen_material", "test_seen", "test_factory", "test_factory_scratch", "test_scratch_blob",
    "test_unseen_material", "test_negatives",
)
ROLES = ("positive", "scratch", "hard_negative", "negative")

"""Schemas of the persisted tables; every read names its own."""

from __future__ import annotations

MANIFEST = (
    "schema_version INT, protocol STRING, dataset STRING, split STRING, sample_id STRING, source_group STRING, video_path STRING, fps DOUBLE, history_steps INT, future_steps INT, "
    "anchor_index INT, history_indices ARRAY<INT>, future_indices ARRAY<INT>, history_time_seconds ARRAY<DOUBLE>, future_time_seconds ARRAY<DOUBLE>, trajectory_window_start INT"
)
EPISODE = "member STRING, source STRING, video_name STRING, anno_type STRING, frame_ids ARRAY<BIGINT>, payload_sha256 STRING"
SEGMENT = "clip STRING, hand STRING, segment INT, start INT, end INT, traj3d ARRAY<ARRAY<DOUBLE>>"
CLIP_CAMERA = "MAP<STRING, STRUCT<T_world_from_camera: STRUCT<quaternion_wxyz: ARRAY<DOUBLE>, translation_xyz: ARRAY<DOUBLE>>>>"
CLIP_HANDS = "MAP<STRING, STRUCT<umetrack_pose: STRUCT<T_world_from_wrist: STRUCT<quaternion_wxyz: ARRAY<DOUBLE>, translation_xyz: ARRAY<DOUBLE>>>>>"
CLIP_INFO = "image_timestamps_ns MAP<STRING, BIGINT>, ref_timestamp_ns BIGINT"
ODOMETRY = "clip STRING, step BIGINT, transform ARRAY<DOUBLE>"
ACTION = "id INT, video STRING, start INT, end INT, action INT, verb INT, object INT, toy STRING, shared INT, anchor INT"

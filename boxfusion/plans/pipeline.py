"""The final pipeline as one plan: features, routers, gate, threshold, suppression, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfusion.config import FusionConfig
from boxfusion.operators import nms, scoring, tracking
from boxfusion.operators.features import feature_vector
from boxfusion.schemas import lookup

FRAME, KEY = ["sample_token"], ["sample_token", "expert", "box_pos"]


def label_frames(boxes: DataFrame, first, second, config: FusionConfig = FusionConfig(), tiles: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """The boxes of each frame after gate, threshold, suppression and cap.

    first, second: functions that add a probability column of that name to feature rows, null for
    classes without a router; a class is routed only if both know it."""
    rows = feature_vector(boxes, FRAME, KEY, tiles=tiles, least=config.peer_iou, cell=cell)
    rows = second(first(rows, "first"), "second")
    weight = lookup(config.blend, F.col("class_name"), 1.0)
    routed = rows.withColumn("routed", scoring.blend(F.col("first"), F.col("second"), weight))
    over = scoring.over_threshold(scoring.gated(routed, config), config).select(*boxes.columns)
    kept = nms.suppress(over, FRAME, "class_name", threshold=config.nms_iou)
    return nms.cap(kept, FRAME, most=config.max_boxes)


def run(boxes: DataFrame, frames: DataFrame, first, second, config: FusionConfig = FusionConfig(), tiles: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """``label_frames`` and then, over the frames of each scene (sample_token, scene_token, frame_idx),
    lower scores for boxes seen once and boxes for frames that a track skips."""
    labels = label_frames(boxes, first, second, config, tiles, cell).join(frames.select("sample_token", "scene_token", "frame_idx"), "sample_token")
    at = frames.select("scene_token", "frame_idx", "sample_token")
    return tracking.refine(labels, orphan_penalty=config.orphan_penalty, discount=config.interpolation_discount, excluded=config.untracked_classes, threshold=config.nms_iou, frames=at)

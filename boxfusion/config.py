"""Parameters of the final pipeline: fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FusionConfig:
    iou_label_classes: tuple[str, ...] = ("car", "truck", "bus", "trailer", "barrier", "traffic_cone")
    distance_label_classes: tuple[str, ...] = ("motorcycle", "bicycle", "pedestrian", "construction_vehicle")
    match_iou: float = 0.5
    match_distance: float = 2.0
    peer_iou: float = 0.1
    nms_iou: float = 0.3
    score_threshold: float = 0.1
    max_boxes: int = 500
    global_tau: float = 1.0
    orphan_penalty: float = 0.7
    interpolation_discount: float = 0.9
    untracked_classes: tuple[str, ...] = ("car", "bicycle")
    max_misses: int = 1
    drivable_levels: tuple[float, ...] = (2.0, 8.0)
    drivable_cap: float = 16.0
    blend: dict[str, float] = field(default_factory=lambda: {"car": 0.9, "truck": 0.8, "construction_vehicle": 0.8, "bus": 0.9, "trailer": 0.9, "barrier": 0.974, "motorcycle": 0.8, "bicycle": 0.8, "pedestrian": 0.3, "traffic_cone": 0.9})
    class_tau: dict[str, float] = field(default_factory=lambda: {"car": 0.8, "truck": 1.0, "construction_vehicle": 1.2, "bus": 1.0, "trailer": 1.2, "barrier": 1.0, "motorcycle": 1.0, "bicycle": 1.0, "pedestrian": 0.8, "traffic_cone": 1.2})
    thresholds: dict[str, float] = field(default_factory=lambda: {"car": 0.488, "truck": 0.365, "construction_vehicle": 0.079, "bus": 0.33, "trailer": 0.232, "barrier": 0.315, "motorcycle": 0.187, "bicycle": 0.217, "pedestrian": 0.296, "traffic_cone": 0.163})

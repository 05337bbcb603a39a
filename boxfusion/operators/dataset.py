"""Router rows: features and labels of every expert's boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfusion.config import FusionConfig
from boxfusion.operators.features import feature_vector
from boxfusion.operators.matching import match


def with_frames(boxes: DataFrame, frames: DataFrame, frame: list[str]) -> DataFrame:
    """Every frame, with null columns where it has no box."""
    return frames.join(boxes, frame, "left")


def frames_without_gt(frames: DataFrame, gt_frames: DataFrame, frame: list[str]) -> DataFrame:
    return frames.select(*frame).distinct().join(gt_frames.select(*frame).distinct(), frame, "left_anti")


def same_frames(a: DataFrame, b: DataFrame, frame: list[str]) -> DataFrame:
    """One row: frames of either side that the other lacks."""
    a, b = a.select(*frame).distinct().withColumn("first", F.lit(True)), b.select(*frame).distinct().withColumn("second", F.lit(True))
    both = a.join(b, frame, "full")
    return both.agg(F.count_if(F.col("second").isNull()).alias("only_first"), F.count_if(F.col("first").isNull()).alias("only_second"))


def label_boxes(boxes: DataFrame, gts: DataFrame, frame: list[str], class_col: str = "class_name", expert: str = "expert", order: tuple[str, ...] = ("expert_ord", "box_pos"), criterion: str = "iou", config: FusionConfig = FusionConfig()) -> DataFrame:
    """``boxes`` with ``label``; each expert is matched by itself.  criterion: "iou" for all classes, or
    "config", by which classes of small footprint match by center distance."""
    keys = [*frame, class_col]
    by_iou = lambda b: match(b, gts, keys, (expert,), order=order, metric="iou", threshold=config.match_iou, frame=frame)
    if criterion == "iou":
        return by_iou(boxes)
    near = F.col(class_col).isin(*config.distance_label_classes)
    by_distance = match(boxes.filter(near), gts, keys, (expert,), order=order, metric="center", threshold=config.match_distance, frame=frame)
    return by_iou(boxes.filter(~near)).unionByName(by_distance)


def build(boxes: DataFrame, gts: DataFrame, gt_frames: DataFrame, frame: list[str], key: list[str], class_col: str = "class_name", expert: str = "expert", order: tuple[str, ...] = ("expert_ord", "box_pos"), criterion: str = "iou", **features: object) -> DataFrame:
    """Features and labels of the boxes of frames that have ground truth, which may be empty.

    Boxes are dealt by frame once; labels go along in their rows."""
    inside = boxes.repartition(*frame).join(gt_frames.select(*frame).distinct(), frame, "left_semi")
    labelled = label_boxes(inside, gts, frame, class_col, expert, order, criterion).drop("matched")
    return feature_vector(labelled, frame, key, expert, class_col, **features)


def ordered(rows: DataFrame, frame: list[str], expert: str = "expert", order: tuple[str, ...] = ("box_pos",)) -> DataFrame:
    """For reproducible files."""
    return rows.orderBy(*frame, expert, *order)

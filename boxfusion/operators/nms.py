"""Greedy suppression of overlapping boxes.

A group (frame and class) is folded in score order by a higher-order function, so the greedy order
is exact and nothing leaves the JVM.  A group holds what detectors submit for one class of one
frame, a few hundred boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxfusion.functions.geometry import iou

KEY = "__k__"


def fold_keep(items: Column, kind: str, clash) -> Column:
    """Of sorted ``items`` (array of ``kind``), those that clash with none kept before."""
    return F.aggregate(items, F.array().cast(f"array<{kind}>"), lambda kept, c: F.when(F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.concat(kept, F.array(c))))


def suppress(boxes: DataFrame, frame: list[str], class_col: str | None = "class_name", score: str = "score", order: tuple[str, ...] = ("expert_ord", "box_pos"), threshold: float = 0.3) -> DataFrame:
    """The boxes of which no better kept one of the same frame, and class if given, overlaps by
    ``threshold`` or more.  Equal scores keep the order of ``order``."""
    keys = [*frame, *([class_col] if class_col else [])]
    geometry = boxes.select((-F.col(score)).alias("s"), *order, *"xywl").schema
    kind = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in geometry)},row:{boxes.schema.simpleString()}>"
    item = F.struct((-F.col(score)).alias("s"), *order, *"xywl", F.struct("*").alias("row"))
    # ordered by (score, order) first; order is a key of the frame, so what follows never decides
    grouped = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = fold_keep(F.col("items"), kind, lambda k, c: iou(k, c) >= threshold)
    # keys come from the group, so that rows stay dealt by them
    out = grouped.select(*keys, F.explode(kept).alias("k"))
    return out.select(*[F.col(c) if c in keys else F.col("k.row")[c].alias(c) for c in boxes.columns])


def cap(boxes: DataFrame, frame: list[str], score: str = "score", order: tuple[str, ...] = ("class_name", "expert_ord", "box_pos"), most: int = 500) -> DataFrame:
    """The best ``most`` boxes of each frame."""
    w = Window.partitionBy(*frame).orderBy(F.col(score).desc(), *order)
    return boxes.withColumn(KEY, F.row_number().over(w)).filter(F.col(KEY) <= most).drop(KEY)

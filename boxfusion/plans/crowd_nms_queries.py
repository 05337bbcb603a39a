"""Suppression where one frame holds all scenes side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxfusion.operators import crowded
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import ORDER, nms_sql, query

_ROW = "SELECT box_key, frame_idx, class_ix, x + CAST(scene_id*20 AS DOUBLE) AS x, y, w, l, score FROM {boxes}"


# scenes are 20 m apart, so that boxes of different ones never overlap and the SQL may go scene by scene
@query("SELECT box_key, score FROM kept", **nms_sql("boxes", "scene_id, frame_idx", "kept"))
def nms_crowded(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of joins instead of a fold, classes together."""
    return crowded.suppress(spark.sql(_ROW, boxes=X.boxes(spark, d)), ["frame_idx"], None, order=ORDER).select("box_key", "score")

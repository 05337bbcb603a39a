"""Greedy suppression in groups beyond an array: rounds of joins instead of a fold.

Overlapping boxes meet by cells of a grid.  A box is kept once no better box that overlaps it is left undecided, and goes once a
better one that overlaps it is kept; each round decides these, and the pairs of decided boxes drop out.  What is
kept is what the fold in score order keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.functions.geometry import iou
from boxfusion.operators.state import cut


def overlapping(boxes: DataFrame, keys: list[str], score: str, order: tuple[str, ...], threshold: float, cell: float) -> DataFrame:
    """(better, worse): the ids of boxes of one group that overlap by ``threshold`` or more, each pair once.

    A box lies in every cell that it touches; a pair counts in the cell of the nearest corner of what both share."""
    side = lambda c, size, sign: F.floor((F.col(c) + sign * F.col(size) / 2) / cell)
    place = F.struct((-F.col(score)).alias("s"), *order)
    rows = boxes.select(*keys, F.struct(*keys, *order).alias("id"), place.alias("o"), *"xywl").withColumn("cx", F.explode(F.sequence(side("x", "l", -1), side("x", "l", 1))))
    rows = rows.withColumn("cy", F.explode(F.sequence(side("y", "w", -1), side("y", "w", 1))))
    a = rows.alias("a")
    b = rows.select(*[F.col(k).alias(f"{k}__2") for k in keys], *[F.col(c).alias(f"{c}2") for c in ("id", "o", "x", "y", "w", "l", "cx", "cy")]).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}__2")) for k in keys] + [F.col("a.cx") == F.col("b.cx2"), F.col("a.cy") == F.col("b.cy2")]
    met = a.join(b, reduce(lambda x, y: x & y, same)).filter(F.col("o") < F.col("o2"))
    low = lambda c, size: F.floor(F.greatest(F.col(c) - F.col(size) / 2, F.col(f"{c}2") - F.col(f"{size}2") / 2) / cell)
    here = (F.col("cx") == low("x", "l")) & (F.col("cy") == low("y", "w"))
    return met.filter(here & (iou(None, None, "2") >= threshold)).select(F.col("id").alias("better"), F.col("id2").alias("worse"))


def suppress(boxes: DataFrame, frame: list[str], class_col: str | None = "class_name", score: str = "score", order: tuple[str, ...] = ("expert_ord", "box_pos"), threshold: float = 0.3, cell: float = 8.0) -> DataFrame:
    """The boxes of which no better kept one of the same frame, and class if given, overlaps by ``threshold`` (above 0) or
    more, as ``nms.suppress`` has them, whatever the size of a group; ``order`` tells boxes of a group apart.

    A round joins what is undecided; their number is that of the longest chain of boxes of which each hangs on the one before.
    A cell is to hold few boxes: all pairs within it are looked at."""
    keys = [*frame, *([class_col] if class_col else [])]
    edges = cut(overlapping(boxes, keys, score, order, threshold, cell))
    gone: list[DataFrame] = []
    while edges.limit(1).count():
        worse = edges.select(F.col("worse").alias("id")).distinct()
        free = edges.select(F.col("better").alias("id")).distinct().join(worse, "id", "left_anti")  # kept for good
        lost = cut(edges.join(free.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        gone.append(lost)
        drop = lambda e, side: e.join(lost.withColumnRenamed("id", side), side, "left_anti")
        # pairs of a kept box are done with: their worse ends are lost
        edges = cut(drop(drop(edges, "worse"), "better"))
    if not gone:
        return boxes
    out = reduce(DataFrame.unionByName, gone)
    key: Column = F.struct(*keys, *order)
    return boxes.join(out, key == F.col("id"), "left_anti")

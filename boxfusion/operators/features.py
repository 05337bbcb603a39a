"""Consensus features of boxes: what other experts see in the same place of the same frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxfusion.functions.geometry import drivable_ladder, intersection, iou, norm
from boxfusion.schemas import EXPERT_IDS, FEATURES, UNKNOWN_EXPERT, lookup


def cells(size: float) -> Column:
    """Grid cells that a box covers, seen from above."""

    def span(at: Column, extent: Column) -> Column:
        return F.sequence(F.floor((at - extent / 2) / size), F.floor((at + extent / 2) / size))

    return F.flatten(F.transform(span(F.col("x"), F.col("l")), lambda i: F.transform(span(F.col("y"), F.col("w")), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def peer_pairs(boxes: DataFrame, frame: list[str], key: list[str], expert: str = "expert", class_col: str = "class_name", least: float = 0.1, cell: float | None = None) -> DataFrame:
    """(key of a box, peer_score, peer_expert, same_class, iou) for boxes of other experts in the same
    frame with an overlap of ``least`` or more.

    ``cell``: joins by grid cell too, for frames with thousands of boxes; a pair then meets in the
    least cell that both cover, so that it counts once."""
    a = boxes.select(*frame, *key, expert, class_col, *"xywl", "score")
    if cell:
        a = a.withColumn("cells", cells(cell)).withColumn("cell", F.explode("cells"))
    b = a.select(*frame, *(["cell", F.col("cells").alias("cells2")] if cell else []), *[F.col(c).alias(f"{c}2") for c in (expert, class_col, *"xywl", "score")])
    met = a.join(b, [*frame, *(["cell"] if cell else [])]).filter(F.col(expert) != F.col(f"{expert}2"))
    if cell:
        met = met.filter(F.col("cell") == F.array_min(F.array_intersect("cells", "cells2")))
    met = met.withColumn("iou", iou(None, None, "2")).filter(F.col("iou") >= least)
    return met.select(*key, F.col("score2").alias("peer_score"), F.col(f"{expert}2").alias("peer_expert"), (F.col(class_col) == F.col(f"{class_col}2")).alias("same_class"), "iou")


def peer_features(boxes: DataFrame, frame: list[str], key: list[str], expert: str = "expert", class_col: str = "class_name", least: float = 0.1, cell: float | None = None) -> DataFrame:
    """``boxes`` with n_peer_overlaps ... n_active_experts.  ``key`` names a box.

    Boxes are dealt by frame once, if they are not yet: a window hands each box its frame's boxes, whose overlaps are
    folded in its row.
    With ``cell``, for frames with thousands of boxes, peers come from ``peer_pairs``."""
    others = F.col("n_active_experts") - 1
    if cell:
        return _joined_features(boxes, frame, key, expert, class_col, least, cell, others)
    whole = Window.partitionBy(*frame)
    ends = {"x0": F.col("x") - F.col("l") / 2, "x1": F.col("x") + F.col("l") / 2, "y0": F.col("y") - F.col("w") / 2, "y1": F.col("y") + F.col("w") / 2}
    peer = F.struct(F.col(expert).alias("e"), F.col(class_col).alias("c"), *"xywl", F.col("score").alias("s"), *[v.alias(k) for k, v in ends.items()])
    known = boxes.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in frame]))  # a box of no frame has no peers to tell
    at = known.withColumns({"__all": F.collect_list(peer).over(whole), "n_active_experts": F.size(F.collect_set(expert).over(whole)).cast("int")})

    def met(x: Column) -> Column:
        p = x["p"]
        return F.struct(iou(None, p, inter=x["n"]).alias("i"), p["s"].alias("s"), p["e"].alias("e"), (p["c"] == F.col(class_col)).cast("double").alias("same"))

    def reaches(p: Column) -> Column:
        """Few comparisons leave most peers out, as lambdas are slow; areas and overlaps are taken of the rest."""
        other = p["e"] != F.col(expert)
        if not least > 0:
            return other
        return other & (p["x0"] < F.col("__x1")) & (p["x1"] > F.col("__x0")) & (p["y0"] < F.col("__y1")) & (p["y1"] > F.col("__y0"))

    at = at.withColumns({f"__{k}": v for k, v in ends.items()})
    shared = F.transform(F.filter("__all", reaches), lambda p: F.struct(p.alias("p"), intersection(None, p).alias("n")))
    apart = F.transform(F.filter(shared, lambda x: x["n"] > 0) if least > 0 else shared, met)
    at = at.withColumns({"__near": F.filter(apart, lambda p: p["i"] >= least), "max_class_score": F.array_max(F.transform(F.filter("__all", lambda p: p["c"].eqNullSafe(F.col(class_col))), lambda p: p["s"]))})

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    scores = F.filter(F.transform("__near", lambda p: p["s"]), lambda v: v.isNotNull())
    same = F.filter(F.transform("__near", lambda p: p["same"]), lambda v: v.isNotNull())
    at = at.withColumns({"n_peer_overlaps": F.size("__near"), "__scores": scores, "__same": same})
    at = at.withColumn("__mean", F.when(F.size("__scores") > 0, total(F.col("__scores")) / F.size("__scores")))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    experts = F.size(F.array_distinct(F.transform("__near", lambda p: p["e"])))
    return at.withColumns(
        {
            "max_peer_iou": zero(F.array_max(F.transform("__near", lambda p: p["i"]))),
            "mean_peer_score": zero(F.col("__mean")),
            "score_variance": zero(F.when(F.size("__scores") > 0, total(F.transform("__scores", lambda v: (v - F.col("__mean")) * (v - F.col("__mean")))) / F.size("__scores"))),
            "expert_agreement": F.when(others > 0, experts / others).otherwise(F.lit(0.0)),
            "class_agreement": F.when(F.size("__same") > 0, total(F.col("__same")) / F.size("__same")).otherwise(F.lit(-1.0)),
            "n_spatial_overlaps": F.col("n_peer_overlaps"),
        }
    ).drop("__all", "__near", "__scores", "__same", "__mean", *[f"__{k}" for k in ends])


def _joined_features(boxes: DataFrame, frame: list[str], key: list[str], expert: str, class_col: str, least: float, cell: float, others: Column) -> DataFrame:
    peers = peer_pairs(boxes, frame, key, expert, class_col, least, cell).groupBy(*key).agg(
        F.count("*").cast("int").alias("n_peer_overlaps"), F.max("iou").alias("max_peer_iou"), F.avg("peer_score").alias("mean_peer_score"), F.var_pop("peer_score").alias("score_variance"),
        F.count_distinct("peer_expert").alias("peer_experts"), F.avg(F.col("same_class").cast("double")).alias("class_agreement"),
    )
    active = boxes.groupBy(*frame).agg(F.count_distinct(expert).cast("int").alias("n_active_experts"))
    out = boxes.join(peers, key, "left").join(active, frame)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("max_peer_iou", "mean_peer_score", "score_variance")}
    return out.withColumns(
        {
            "n_peer_overlaps": F.coalesce("n_peer_overlaps", F.lit(0)),
            **zero,
            "expert_agreement": F.when(others > 0, F.coalesce("peer_experts", F.lit(0)) / others).otherwise(F.lit(0.0)),
            "class_agreement": F.coalesce("class_agreement", F.lit(-1.0)),
            "n_spatial_overlaps": F.coalesce("n_peer_overlaps", F.lit(0)),
            "max_class_score": F.max("score").over(Window.partitionBy(*frame, class_col)),
        }
    ).drop("peer_experts")


def drivable_distance(boxes: DataFrame, tiles: DataFrame | None, scene: str = "scene_token", cell: float = 0.5, x: str = "x", y: str = "y", scenes: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """``boxes`` with dist_to_drivable_area, from ``tiles`` (scene, ix, iy, distance): the ladder over
    the true distance of the box's tile; beyond the tiles of a known scene the greatest value, -1
    for scenes without tiles.  ``scenes``: those with tiles, if cheaper to tell from another table;
    ``keep``: a column for the true distance, null beyond the tiles."""
    if tiles is None:
        out = boxes.withColumn("dist_to_drivable_area", F.lit(-1.0))
        return out.withColumn(keep, F.lit(None).cast("double")) if keep else out
    known = (tiles if scenes is None else scenes).select(scene).distinct().withColumn("__known__", F.lit(True))
    at = boxes.withColumns({"ix": F.floor(F.col(x) / cell), "iy": F.floor(F.col(y) / cell)})
    met = at.join(tiles.select(scene, "ix", "iy", F.col("distance").alias("__d__")), [scene, "ix", "iy"], "left").join(known, scene, "left")
    d = F.when(F.col("__known__"), F.coalesce("__d__", F.lit(1e9)))
    out = met.withColumn("dist_to_drivable_area", drivable_ladder(d))
    return (out.withColumn(keep, F.col("__d__")) if keep else out).drop("ix", "iy", "__d__", "__known__")


def feature_vector(boxes: DataFrame, frame: list[str], key: list[str], expert: str = "expert", class_col: str = "class_name", tiles: DataFrame | None = None, scene: str = "scene_token", least: float = 0.1, cell: float | None = None) -> DataFrame:
    """``boxes`` with all of FEATURES."""
    # the map's tiles meet boxes while these are narrow
    out = peer_features(drivable_distance(boxes, tiles, scene), frame, key, expert, class_col, least, cell)
    names = dict(boxes.dtypes)
    expert_id = lookup(EXPERT_IDS, F.col(expert), UNKNOWN_EXPERT) if names[expert] == "string" else F.col(expert)
    height = F.col("h") if "h" in names else F.lit(None).cast("double")
    speed = norm(F.col("vx"), F.col("vy")) if "vx" in names else F.lit(0.0)
    out = out.withColumns({"expert_id": expert_id, "detection_score": F.col("score"), "dist_from_ego": norm(F.col("x"), F.col("y")), "box_width": F.col("w"), "box_length": F.col("l"), "box_height": height, "vel_magnitude": speed})
    rest = [c for c in out.columns if c not in FEATURES]
    return out.select(*rest, *FEATURES)

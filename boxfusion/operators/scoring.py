"""Blending, gating and thresholding of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.config import FusionConfig
from boxfusion.functions.geometry import clip, sigmoid
from boxfusion.schemas import lookup

#: A router gives a probability from the columns of a row; any expression or scalar pandas UDF will do.
Router = Callable[[DataFrame], Column] | Column


def blend(first: Column, second: Column, weight: Column) -> Column:
    """weight * first + (1 - weight) * second; null, that is no router, unless both are there."""
    return weight * first + (1 - weight) * second


def gate(score: Column, routed: Column, tau: Column) -> Column:
    """The router's probability pulls the score by the weight sigmoid(probability / tau); a box without
    a router keeps its score."""
    w = sigmoid(routed / tau)
    # greatest and least would skip a null
    return F.when(routed.isNull(), score).otherwise(clip(w * routed + (1 - w) * score))


def route(boxes: DataFrame, routers: dict[str, Router], class_col: str = "class_name", name: str = "routed") -> DataFrame:
    """``boxes`` with the probability of their class's router, null without one."""
    out = F.lit(None).cast("double")
    for cls, router in routers.items():
        out = F.when(F.col(class_col) == cls, router(boxes) if callable(router) and not isinstance(router, Column) else router).otherwise(out)
    return boxes.withColumn(name, out)


def gated(boxes: DataFrame, config: FusionConfig = FusionConfig(), class_col: str = "class_name", routed: str = "routed", per_class: bool = True) -> DataFrame:
    """``boxes`` with gated scores; ``per_class`` takes the temperature of the class, else the global one."""
    tau = lookup(config.class_tau, F.col(class_col), config.global_tau) if per_class else F.lit(config.global_tau)
    return boxes.withColumn("score", gate(F.col("score"), F.col(routed), tau))


def over_threshold(boxes: DataFrame, config: FusionConfig = FusionConfig(), class_col: str = "class_name") -> DataFrame:
    return boxes.filter(F.col("score") >= lookup(config.thresholds, F.col(class_col), config.score_threshold))


def hard_label(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def diagnosis(train_ap: Column, eval_ap: Column, gap: float = 0.15, low: float = 0.30) -> Column:
    return F.when(train_ap - eval_ap > gap, "overfitting risk").when((train_ap < low) & (eval_ap < low), "underfitting risk").otherwise("OK")

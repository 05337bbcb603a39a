"""Routers trained on the rows of the router table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.operators import metrics
from boxfusion.operators.ml import boosting, descent, neural
from boxfusion.operators.state import cut, hold, remove, scratch
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import NUMERIC, query, router_rows

SHAPE = {"hidden": (16, 8)}


def trained(rows: DataFrame, epochs: int = 12) -> tuple[dict, dict]:
    return descent.train(rows, NUMERIC, "class_id", ["box_key"], shape=SHAPE, epochs=epochs, rate=0.05)


@query()
def perceptron_router(spark: SparkSession, d: str) -> DataFrame:
    """The probability of each row by its class's perceptron; a tenth of the rows was held out of its training."""
    rows = cut(router_rows(spark, d).select("box_key", "class_id", "label", *NUMERIC))
    routers, _ = trained(rows)
    held = F.pmod(F.xxhash64(F.lit(42), "box_key"), F.lit(10)) == 0
    return neural.predict(descent.filled(rows, routers, NUMERIC), routers, NUMERIC, "class_id").select("box_key", "class_id", "label", held.alias("held_out"), F.round("p", 6).alias("p"))


#: Small trees and few rounds, for the fixture's few features; class 2 is calibrated.
BOOST = {"rounds": 30, "patience": 5, "depth": 3, "step": 0.3, "bins": 32, "calibrated": (2,)}


def boosted(spark: SparkSession, d: str, folder: str) -> tuple[DataFrame, dict]:
    """Rows with the probabilities of their class's forest, and the forests; ``folder`` holds the rows."""
    boxes = hold(X.boxes(spark, d), f"{folder}/boxes")
    rows = hold(router_rows(spark, d, boxes).select("box_key", "class_id", "label", *NUMERIC), f"{folder}/rows")
    remove(spark, f"{folder}/boxes")
    held = F.pmod(F.xxhash64(F.lit(42), "box_key"), F.lit(10)) == 0
    rows = rows.withColumn("held_out", held)
    forests = boosting.train(rows, NUMERIC, key=["box_key"], held="held_out", **BOOST)
    return boosting.predict(rows, forests, NUMERIC, raw="raw"), forests


@query()
def boosted_router(spark: SparkSession, d: str) -> DataFrame:
    """The probability of each row by its class's boosted trees, before and after calibration."""
    return boosted(spark, d, scratch(spark, "boosted"))[0].select("box_key", "class_id", "label", "held_out", F.round("raw", 6).alias("raw"), F.round("p", 6).alias("p"))


@query()
def boosted_router_report(spark: SparkSession, d: str) -> DataFrame:
    """Each class's best round and the rounds grown, and on rows held out and not its precision, area and Brier scores."""
    folder = scratch(spark, "boosted")
    scored, forests = boosted(spark, d, folder)
    by = ["class_id", "held_out"]
    # rows of equal probabilities are one
    scored = scored.filter("p is not null").groupBy(*by, "raw", "p").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
    scored = hold(scored, f"{folder}/scored")
    remove(spark, f"{folder}/rows")
    named = lambda f, kind: F.element_at(F.create_map(*[F.lit(v) for k, forest in forests.items() for v in (k, f(forest))]) if forests else F.create_map().cast(f"map<int,{kind}>"), F.col("class_id"))
    figures = metrics.ranking_figures(scored, by, "raw", "positives", "n")
    square = lambda p: F.round(F.sum(F.col("positives") * (F.col(p) - 1) ** 2 + (F.col("n") - F.col("positives")) * F.col(p) ** 2) / F.sum("n"), 6)
    brier = scored.groupBy(*by).agg(square("raw").alias("brier_raw"), square("p").alias("brier"))
    return figures.join(brier, by).select(
        *by, named(lambda f: f.rounds, "int").alias("best_round"), named(lambda f: len(f.models[0]), "int").alias("rounds"), named(lambda f: f.calibration is not None, "boolean").alias("calibrated"),
        "n", "positives", F.round("ap", 6).alias("ap"), F.round("auc", 6).alias("auc"), "brier_raw", "brier",
    )

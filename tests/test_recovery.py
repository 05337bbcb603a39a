"""Masks of recovering sources, and gap tables, on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boxfusion.operators import analytics, metrics, recovery

BOX = "frame int, source int, box_pos int, x double, y double, score double"
GT = "frame int, gt_pos int, x double, y double"


def case(spark):
    gts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 20.0, 0.0), (2, 0, 0.0, 0.0)], GT)
    boxes = [(1, 0, 0, 0.5, 0.0, 0.9), (1, 1, 0, 0.1, 0.0, 0.8), (1, 2, 0, 0.2, 0.0, 0.7), (1, 0, 1, 10.5, 0.0, 0.6), (1, 2, 1, 20.5, 0.0, 0.5), (1, 0, 2, 22.0, 0.0, 0.5), (3, 0, 0, 0.0, 0.0, 0.5), (1, None, 0, 0.0, 0.0, 0.9), (1, 9, 0, 0.0, 0.0, 0.9)]
    return recovery.masks(spark.createDataFrame(boxes, BOX), gts, ["frame"], 3)


def test_masks_and_what_follows(spark):
    found = case(spark)
    assert {(r.frame, r.gt_pos): r.found for r in found.collect()} == {(1, 0): 0b111, (1, 1): 0b001, (1, 2): 0b100, (2, 0): 0}
    # sources 0 and 1 are experts, 2 is fused
    assert recovery.counts(found, 2, 2).first().asDict() == {"n_gt": 4, "n_none": 2, "n_one": 1, "n_all": 1, "n_fused": 2, "fused_unique": 0, "fused_new": 1, "fused_lost": 1}
    assert [tuple(r) for r in recovery.by_source(found, 3).orderBy("source").collect()] == [(0, 4, 2, 1, 0.5), (1, 4, 1, 0, 0.25), (2, 4, 2, 1, 0.5)]
    assert [tuple(r) for r in recovery.overlaps(found, 3).orderBy("a", "b").collect()] == [(0, 1, 1, 1, 0, 2), (0, 2, 1, 1, 1, 3), (1, 2, 1, 0, 1, 2)]


def test_empty_tables_and_bounds(spark):
    none = recovery.masks(spark.createDataFrame([], BOX), spark.createDataFrame([(1, 0, 0.0, 0.0)], GT), ["frame"], 3)
    assert [r.found for r in none.collect()] == [0]
    empty = recovery.masks(spark.createDataFrame([], BOX), spark.createDataFrame([], GT), ["frame"], 3)
    assert recovery.counts(empty, 2, 2).first()["n_gt"] == 0
    assert [r.recall for r in recovery.by_source(empty, 2).collect()] == [None, None]
    with pytest.raises(ValueError, match="sources"):
        recovery.masks(none, none, ["frame"], 64)


def test_figures_of_one_curve_and_gaps(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("class_id"), F.lit("m").alias("model"), (F.col("id") % 7 / 7).alias("score"), (F.col("id") * 5 % 11 < 4).cast("int").alias("label"), (F.col("id") % 4 > 0).alias("fit"))
    rows = rows.unionByName(rows.filter("fit and class_id = 0").withColumn("class_id", F.lit(9).cast("long")))
    by = ["class_id", "fit"]
    both = metrics.ranking_figures(rows, by).join(metrics.average_precision(rows, by).select(*by, F.col("ap").alias("ap2")), by).join(metrics.roc_auc(rows, by).select(*by, F.col("auc").alias("auc2")), by)
    assert both.count() == 7 and both.filter("abs(ap - ap2) > 1e-12 or abs(auc - auc2) > 1e-12 or auc is null").count() == 0
    table = analytics.gap_table(rows, "fit")
    assert {r.class_id for r in table.collect()} == {0, 1, 2}  # class 9 is never evaluated
    assert table.filter("abs(gap_ap - (train_ap - eval_ap)) > 1e-12").count() == 0
    flags = analytics.gap_flags(table).first()
    assert flags.n_pairs == 3 == flags.n_overfitting + flags.n_underfitting + flags.n_ok

"""Boxes are dealt by frame once, and features and labels follow without further shuffles."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

from boxfusion.operators import analytics, features, matching
from boxfusion.plans import queries as Q
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Reused)\bExchange ", plan.split("== Initial Plan ==")[-1]))


def test_router_rows_and_drafts_are_shuffled_by_frame_once(spark):
    # boxes (three readings, of which one is the other's) and their frames, truths and frames with truths
    assert exchanges(Q.router_dataset(spark, SF)) <= 6
    assert exchanges(Q.draft_labels(spark, SF)) <= 2


def test_peer_features_equal_the_joined_ones(spark):
    r = np.random.default_rng(7)
    n = 400
    df = pd.DataFrame({"frame": r.integers(0, 12, n).astype(float), "key": np.arange(n), "expert": r.choice(["a", "b", "c"], n), "class_name": r.choice(["car", "bus"], n), "x": r.uniform(0, 9, n), "y": r.uniform(0, 9, n), "w": r.uniform(1, 4, n), "l": r.uniform(1, 5, n), "score": r.random(n).round(3)})
    df.loc[r.random(n) < 0.05, "frame"] = np.nan
    df["expert"] = df.expert.where(r.random(n) >= 0.05, None)
    df["class_name"] = df.class_name.where(r.random(n) >= 0.05, None)
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None), "frame double, key long, expert string, class_name string, x double, y double, w double, l double, score double")
    each = [features.peer_features(rows, ["frame"], ["key"], cell=c).toPandas().sort_values("key").reset_index(drop=True) for c in (None, 3.0)]
    assert len(each[0]) == len(each[1]) and set(each[0]) == set(each[1])
    for c in each[0]:
        a, b = each[0][c], each[1][c]
        assert ((a == b) | (a.isna() & b.isna()) | (np.isclose(a, b, atol=1e-12) if a.dtype.kind == "f" else False)).all(), c


def test_matching_by_frame_equals_matching_by_keys(spark):
    boxes, gt = Q.X.boxes(spark, SF), Q.X.gt(spark, SF)
    each = [matching.match(boxes, gt, Q.KEYS, ("expert_ix",), order=Q.ORDER, frame=f).select("box_key", "matched", "label") for f in (None, Q.FRAME)]
    assert each[0].exceptAll(each[1]).isEmpty() and each[1].exceptAll(each[0]).isEmpty() and not each[0].filter("label = 1").isEmpty()


def test_describe_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(1000, numPartitions=4).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b").mapInPandas(count, "a double, b double")
    out = {r["feature"]: r for r in analytics.describe(rows, ["a", "b"]).collect()}
    assert seen.value == 1000
    assert (out["a"]["count"], out["a"]["min"], out["a"]["p25"], out["a"]["p50"], out["a"]["max"]) == (1000, 0, 249.75, 499.5, 999) and out["b"]["p50"] == 3


def test_recovery_deals_boxes_once_to_suppress_and_once_to_match(spark):
    # boxes, groups to suppress, all sources by frame; truths, their order, truths by frame; masks and their counts
    assert exchanges(Q.QUERIES["recovery_counts"](spark, SF)) <= 9

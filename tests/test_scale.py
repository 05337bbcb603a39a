"""What keeps the cost of a query in proportion to its input: work is done once, in columns, or on what is distinct."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from boxfusion.operators import analytics, evaluation, metrics
from boxfusion.plans import evaluation_queries
from boxfusion.plans import queries as Q
from tests.conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_correlations_come_from_matrices_of_tasks(spark):
    """gaps count pair by pair, constants and empty columns give null; no aggregate for each pair."""
    names = ["a", "b", "c", "same", "none"]
    rows = spark.range(700).select(
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(997)) / 10 + F.col("id") * k + 1e6).alias(n) for k, n in enumerate("ab")],
        F.when(F.col("id") % 7 > 1, F.col("id") * 0.5 + F.pmod(F.xxhash64("id"), F.lit(100))).alias("c"), F.lit(0.1).alias("same"), F.lit(None).cast("double").alias("none"),
    )
    found = analytics.correlations(rows.repartition(5), names)
    assert "corr(" not in plan(found)
    got = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    x = rows.toPandas().astype(float)
    assert list(got) == list(itertools.combinations(names, 2))
    for (a, b), r in got.items():
        if {"same", "none"} & {a, b}:
            assert r is None
        else:
            assert np.isclose(r, x[a].corr(x[b]), rtol=0, atol=1e-10)
    assert analytics.correlations(rows.limit(0), names).count() == 0


def test_figures_of_counted_rows_are_those_of_all_rows(spark):
    """rows of one score may come as one row and its count."""
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(9)) / 10).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    once = rows.groupBy("k", "score").agg(F.sum("label").alias("label"), F.count("*").alias("n"))
    figures = lambda df, **more: sorted(map(tuple, metrics.ranking_figures(df, ["k"], **more).select("k", "n", "positives", F.round("ap", 9), F.round("auc", 9)).collect()))
    assert figures(once, count="n") == figures(rows)


def test_frames_are_matched_once(spark):
    """the ranking and what reads it start from verdicts that are held."""
    sf = f"{DATA}/sf0.001"
    for df in (evaluation_queries.per_class(spark, sf).drop("class_name").select("aps", *evaluation.ERRORS), Q.QUERIES["detection_eval"](spark, sf)):
        assert "collect_list" not in plan(df)

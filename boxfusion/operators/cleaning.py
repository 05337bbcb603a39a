"""Cleaning of router rows, in order, and the counts of what each step drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.operators.quantiles import quantiles

DIMENSIONS = ("box_width", "box_length", "box_height")


def missing_counts(rows: DataFrame) -> DataFrame:
    """One row: per column how many values are null or NaN."""

    def gone(name: str, kind: str) -> Column:
        c = F.col(name)
        return (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()

    return rows.agg(*[F.count_if(gone(n, k)).alias(n) for n, k in rows.dtypes])


def steps(rows: DataFrame, experts: tuple[str, ...] | None = None, model: str = "model_name", classes: range = range(10)) -> dict[str, Column]:
    """Whether a row passes each step.  Infinite values drop, NaN does not by itself; scores lie in
    [0, 1]; no dimension is 0 or less; class and expert are known."""
    numeric = [n for n, k in rows.dtypes if k in ("double", "float")]
    finite = F.lit(True)
    for n in numeric:
        finite = finite & F.coalesce(F.abs(F.col(n)) != F.lit(float("inf")), F.lit(True))
    sizes = F.lit(True)
    for n in DIMENSIONS:
        if n in rows.columns:
            sizes = sizes & ~F.coalesce(F.col(n) <= 0, F.lit(False))
    known = F.col("class_id").isin(*classes)
    if experts is not None:
        known = known & F.col(model).isin(*experts)
    return {"finite": finite, "score": F.coalesce(F.col("detection_score").between(0, 1), F.lit(False)), "dimensions": sizes, "known": F.coalesce(known, F.lit(False))}


def clean(rows: DataFrame, **more: object) -> DataFrame:
    out = rows
    for ok in steps(rows, **more).values():
        out = out.filter(ok)
    return out


def summary(rows: DataFrame, **more: object) -> DataFrame:
    """One row: rows before, dropped by each step in turn, and left."""
    passed, counts = F.lit(True), []
    for name, ok in steps(rows, **more).items():
        counts.append(F.count_if(passed & ~ok).alias(f"dropped_{name}"))
        passed = passed & ok
    return rows.agg(F.count("*").alias("n_before"), *counts, F.count_if(passed).alias("n_after"))


def winsorise(rows: DataFrame, column: str = "dist_from_ego", factor: float = 3.0, at: float = 0.99) -> DataFrame:
    """Values above ``factor`` times the quantile ``at`` become that."""
    cap = quantiles(rows, [column], [at])[column, at]
    return rows if cap is None else rows.withColumn(column, F.least(F.col(column), F.lit(cap * factor)))

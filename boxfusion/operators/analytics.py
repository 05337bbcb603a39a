"""Tables behind the exploratory figures and reports."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxfusion.functions.geometry import bin_label
from boxfusion.operators.quantiles import quantiles
from boxfusion.operators.scoring import diagnosis


def rate_by(rows: DataFrame, by: str, label: str = "label") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(label).alias("tp_rate"))


def rate_by_class(rows: DataFrame, classes: DataFrame, by: str = "class_id", label: str = "label") -> DataFrame:
    """One row for each of ``classes``, null where a class has no rows."""
    return classes.join(rate_by(rows, by, label), by, "left")


def rate_pivot(rows: DataFrame, by: str, across: str, values: list, label: str = "label", prefix: str = "class_") -> DataFrame:
    out = rows.groupBy(by).pivot(across, values).agg(F.avg(label))
    return out.select(by, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def agreement_bins(rows: DataFrame, column: str = "expert_agreement", label: str = "label") -> DataFrame:
    """Only bins that have rows."""
    return rows.withColumn("bin", bin_label(F.col(column))).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(label).alias("tp_rate"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for the lower triangle of Pearson correlations, in one pass; null where either is constant or both are never
    known together.

    A task adds up counts, means and sums of squares and products of all pairs as matrices, one row each; these are merged
    in groups of tasks and then in one."""
    k, kind = len(columns), "m array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = merged(total, moments(b))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    def together(t: pa.Table) -> pa.Table:
        total = None
        for m in t.column("m").to_pylist():  # one vector for each task of the group
            total = merged(total, np.array(m).reshape(4, k, k))
        return pa.table({"m": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def ended(t: pa.Table) -> pa.Table:
        n, _, squares, products = np.array(together(t).column("m")[0].as_py()).reshape(4, k, k)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = products / np.sqrt(squares * squares.T)
        at = list(itertools.combinations(range(k), 2))
        values = [float(r[i, j]) if n[i, j] > 1 and squares[i, j] != 0 and squares[j, i] != 0 else None for i, j in at]
        return pa.table({"a": [columns[i] for i, _ in at], "b": [columns[j] for _, j in at], "r": pa.array(values, pa.float64())})

    each = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(sums, kind)
    parts = each.groupBy((F.spark_partition_id() % 32).alias("part")).applyInArrow(together, kind)
    return parts.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(ended, "a string, b string, r double")


def moments(b: pa.RecordBatch) -> np.ndarray:
    """For each pair of columns, over the rows in which both are known: how many, the first's mean and its squares' sum
    about it, and the sum of products about both."""
    known = np.stack([np.asarray(c.is_valid()) for c in b.columns], axis=1)
    x = np.stack([np.asarray(c.fill_null(0.0)) for c in b.columns], axis=1)
    base = x[known.argmax(axis=0), np.arange(x.shape[1])]  # near the values, so that little is lost; constants are 0 exactly
    base = np.where(np.isfinite(base), base, 0.0)
    x, m = np.where(known, x - base, 0.0), known.astype(float)
    n = m.T @ m
    s, least = x.T @ m, np.maximum(n, 1)
    return np.stack([n, base[:, None] + s / least, (x * x).T @ m - s * s / least, x.T @ x - s * s.T / least])


def merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The ``moments`` of the rows of both."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart, share = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0), b[0] / np.maximum(n, 1)
    mean = np.where(a[0] > 0, a[1] + apart * share, b[1])
    return np.stack([n, mean, a[2] + b[2] + apart**2 * a[0] * share, a[3] + b[3] + apart * apart.T * a[0] * share])


def label_correlations(rows: DataFrame, columns: list[str], label: str = "label", strong: float = 0.3) -> DataFrame:
    """By falling |r|, with the split into strong and weak."""
    one = rows.agg(*[F.corr(c, label).alias(f"r{k}") for k, c in enumerate(columns)])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{k}").alias("r")) for k, c in enumerate(columns)])))
    return out.withColumn("strong", F.coalesce(F.abs("r") >= strong, F.lit(False))).orderBy(F.abs("r").desc_nulls_last(), "feature")


def redundant(rows: DataFrame, columns: list[str], least: float = 0.65, same: float = 0.9999) -> DataFrame:
    return correlations(rows, columns).filter(F.abs("r") >= least).withColumn("duplicate", F.abs("r") > same)


def histogram(rows: DataFrame, column: str, bins: int = 60, low: float = 0.0, high: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n, density): equal bins, the last one closed at both ends."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.filter(F.col(column).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * width))


def clipped_histogram(rows: DataFrame, column: str, bins: int = 40, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Of values clipped to two quantiles."""
    q = quantiles(rows, [column], [low, high])
    first, last = q[column, low], q[column, high]
    return histogram(rows.withColumn(column, F.greatest(F.lit(first), F.least(F.lit(last), F.col(column)))), column, bins, first, last)


def best_expert(metrics: DataFrame, expert: str = "expert", fused: str = "fused", by: str = "class_id", value: str = "ap") -> DataFrame:
    """(by, fused value, best expert and its value, delta, won), by falling delta.  Of equals the
    first expert by name."""
    is_fused = F.col(expert) == fused
    best = F.min(F.when(~is_fused, F.struct((-F.col(value)).alias("v"), F.col(expert).alias("e"))))
    out = metrics.groupBy(by).agg(F.max(F.when(is_fused, F.col(value))).alias("fused_value"), best.alias("b"))
    out = out.select(by, "fused_value", F.col("b.e").alias("best_expert"), (-F.col("b.v")).alias("best_value"))
    return out.withColumn("delta", F.col("fused_value") - F.col("best_value")).withColumn("won", F.col("delta") > 0).orderBy(F.col("delta").desc(), by)


def wins(best: DataFrame) -> DataFrame:
    """One row (n, n_won, mean_delta, least_delta, greatest_delta) of what ``best_expert`` gives, classes without a delta left out."""
    known = best.filter("delta is not null")
    return known.agg(F.count("*").alias("n"), F.count_if("won").alias("n_won"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("least_delta"), F.max("delta").alias("greatest_delta"))


def gap_table(rows: DataFrame, fit: str, by: list[str] | tuple[str, ...] = ("class_id", "model"), score: str = "score", label: str = "label", count: str | None = None) -> DataFrame:
    """(by, n_train, n_eval, train_ap, eval_ap, gap_ap, train_auc, eval_auc, diagnosis) from rows of both sides (``fit``: of
    training), by one ranking for both figures; groups without rows to train or positives to evaluate are left out.  ``count``: as of ``metrics.curve``."""
    from boxfusion.operators.metrics import ranking_figures

    each = ranking_figures(rows, [*by, fit], score, label, count)
    side = lambda c, name, yes: F.max(F.when(F.col(fit) == yes, F.col(c))).alias(f"{name}_{c}")
    both = each.groupBy(*by).agg(*[side(c, name, yes) for c in ("n", "ap", "auc") for name, yes in (("train", True), ("eval", False))])
    both = both.filter("train_n is not null and eval_ap is not null")
    gap = F.col("train_ap") - F.col("eval_ap")
    return both.select(
        *by, F.col("train_n").alias("n_train"), F.col("eval_n").alias("n_eval"), "train_ap", "eval_ap", gap.alias("gap_ap"), "train_auc", "eval_auc", diagnosis(F.col("train_ap"), F.col("eval_ap")).alias("diagnosis")
    )


def gap_flags(gaps: DataFrame) -> DataFrame:
    """One row: how many pairs of class and model have each diagnosis."""
    of = lambda d: F.count_if(F.col("diagnosis") == d)
    return gaps.agg(of("overfitting risk").alias("n_overfitting"), of("underfitting risk").alias("n_underfitting"), of("OK").alias("n_ok"), F.count("*").alias("n_pairs"))


def dataset_summary(rows: DataFrame, frame: str = "sample_token", model: str = "model_name", label: str = "label") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("positive_rate"), F.count_distinct(frame).alias("frames"), F.count_distinct(model).alias("experts"), F.count_distinct("class_id").alias("classes"))


def class_weights(rows: DataFrame, by: str = "class_id", label: str = "label") -> DataFrame:
    pos = F.sum(label)
    return rows.groupBy(by).agg(F.count("*").alias("n"), pos.alias("positives"), ((F.count("*") - pos) / F.greatest(pos, F.lit(1))).alias("weight"))


def gap_summary(folds: DataFrame, by: str | list[str] = "class_id", gap: str = "gap", wide: float = 0.3) -> DataFrame:
    """Mean, sample deviation and range of a gap over folds; ``unstable`` if the range is wide."""
    out = folds.groupBy(*([by] if isinstance(by, str) else by)).agg(F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"), F.min(gap).alias("low"), F.max(gap).alias("high"))
    return out.withColumn("unstable", F.col("high") - F.col("low") > wide)


def top_frames(boxes: DataFrame, frame: list[str], k: int = 3) -> DataFrame:
    """The ``k`` frames of the most boxes."""
    return boxes.groupBy(*frame).count().orderBy(F.col("count").desc(), *frame).limit(k)


def sample(rows: DataFrame, key: list[str], most: int = 60_000) -> DataFrame:
    """``most`` rows by the hash of their key."""
    return rows.orderBy(F.xxhash64(*key), *key).limit(most)


def median_gate(rows: DataFrame, less: str = "box_width", more: str = "box_length") -> DataFrame:
    """One row: both medians and whether the first is the lesser."""
    q = quantiles(rows, [less, more], [0.5])
    low, high = (F.lit(q[c, 0.5]).cast("double") for c in (less, more))
    return rows.sparkSession.range(1).select(low.alias("low"), high.alias("high"), (low < high).alias("ok"))


def log_summary(log: DataFrame, fields: list[str], ts: str = "ts") -> DataFrame:
    """(field, greatest value, when) of a hardware log; of equals the first time."""
    one = log.agg(*[F.min(F.when(F.col(f).isNotNull(), F.struct((-F.col(f).cast("double")).alias("v"), F.col(ts).alias("t")))).alias(f) for f in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), (-F.col(f"`{f}`.v")).alias("peak"), F.col(f"`{f}`.t").alias("at")) for f in fields])))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (linear between values) and greatest, one row for
    each of ``columns``.  ``rows`` are computed once; one row comes back to the driver."""
    names = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    rows = rows.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)

    def of(c: str):
        values = (F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), *[F.lit(q[c, p]) for p in (0.25, 0.5, 0.75)], F.max(c))
        return F.struct(F.lit(c).alias("feature"), *[v.cast("double").alias(n) for n, v in zip(names, values, strict=True)]).alias(c)

    try:
        q = quantiles(rows, columns, [0.25, 0.5, 0.75])
        one = rows.agg(*[of(c) for c in columns]).select(F.inline(F.array(*[F.col(c) for c in columns])))
        return rows.sparkSession.createDataFrame(one.collect(), one.schema)
    finally:
        rows.unpersist()


def router_table(rows: DataFrame, scores: list[str], by: str = "class_id", label: str = "label") -> DataFrame:
    """(by, n, positive_rate, one average precision for each of ``scores``): classes with positives."""
    from boxfusion.operators.metrics import average_precision

    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(label).alias("positive_rate")).filter("positive_rate > 0")
    long = rows.select(by, label, F.inline(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores])))
    ap = average_precision(long, [by, "model"], "score", label).groupBy(by).pivot("model", scores).agg(F.first("ap"))
    return out.join(ap.select(by, *[F.col(f"`{s}`").alias(f"{s}_ap") for s in scores]), by)

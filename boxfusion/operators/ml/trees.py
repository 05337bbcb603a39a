"""Boosted trees, one model for each class.

Spark's trees have no L2 term and sample columns at each node, so they come near to, but do not
equal, those of other libraries."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfusion.functions.geometry import sigmoid
from boxfusion.operators.metrics import average_precision
from boxfusion.operators.splits import stratified_folds


@dataclass
class Router:
    """A fitted model and, if calibrated, slope and intercept over its raw probability."""

    model: GBTClassificationModel
    rounds: int
    calibration: tuple[float, float] | None = None


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x__", handleInvalid="keep").transform(rows.withColumns({f: F.col(f).cast("float").cast("double") for f in features}))


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with a weight that balances the labels."""
    n = rows.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    return rows.withColumn("__w__", F.when(F.col(label) == 1, F.lit((n["n"] - n["p"]) / max(n["p"], 1))).otherwise(F.lit(1.0)))


def _fit(rows: DataFrame, rounds: int, depth: int, step: float, seed: int, label: str) -> GBTClassificationModel:
    return GBTClassifier(featuresCol="__x__", labelCol=label, weightCol="__w__", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(weighted(rows, label))


def probability(rows: DataFrame, model: GBTClassificationModel, name: str = "p") -> DataFrame:
    return model.transform(rows).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def best_rounds(model: GBTClassificationModel, held_out: DataFrame, patience: int = 40, every: int = 1, label: str = "label") -> int:
    """The number of leading trees of the best average precision on ``held_out``; the search ends after
    ``patience`` trees without a gain.  All prefixes are scored in one pass."""
    weights, trees = model.treeWeights, model.trees
    columns, total = {}, F.lit(0.0)
    rows = held_out
    for k, tree in enumerate(trees):
        rows = tree.setFeaturesCol("__x__").setPredictionCol(f"__t{k}__").transform(rows)
        total = total + F.col(f"__t{k}__") * weights[k]
        if (k + 1) % every == 0 or k + 1 == len(trees):
            columns[k + 1] = total
    long = rows.select(label, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("score")) for k, c in columns.items()])))
    ap = {r["k"]: r["ap"] for r in average_precision(long, ["k"], "score", label).collect()}
    best, at = -1.0, len(trees)
    for k in sorted(ap):
        if (ap[k] or 0.0) > best:
            best, at = ap[k] or 0.0, k
        elif k - at >= patience:
            break
    return at


def train_class(rows: DataFrame, features: list[str], held_out: DataFrame | None = None, key: list[str] | None = None, min_positives: int = 20, most_rounds: int = 500, fallback_rounds: int = 150, patience: int = 40, depth: int = 6, step: float = 0.05, seed: int = 42, calibrate: bool = False, folds: int = 3, label: str = "label") -> Router | None:
    """A router from one class's rows; None with fewer than ``min_positives`` positives."""
    positives = rows.agg(F.sum(label)).first()[0] or 0
    if positives < min_positives:
        return None
    x = vectors(rows, features).persist()
    try:
        rounds = fallback_rounds
        if held_out is not None and (held_out.agg(F.sum(label)).first()[0] or 0) > 0:
            rounds = best_rounds(_fit(x, most_rounds, depth, step, seed, label), vectors(held_out, features), patience, label=label)
        model = _fit(x, rounds, depth, step, seed, label)
        fitted = None
        if calibrate:
            dealt = stratified_folds(x, key or features, label, folds, seed)
            parts = None
            for k in range(folds):
                p = probability(dealt.filter(F.col("fold") == k), _fit(dealt.filter(F.col("fold") != k), rounds, depth, step, seed, label)).select("p", label)
                parts = p if parts is None else parts.unionByName(p)
            one = VectorAssembler(inputCols=["p"], outputCol="__p__").transform(parts)
            lr: LogisticRegressionModel = LogisticRegression(featuresCol="__p__", labelCol=label).fit(one)
            fitted = (float(lr.coefficients[0]), float(lr.intercept))
        return Router(model, rounds, fitted)
    finally:
        x.unpersist()


def train(rows: DataFrame, features: list[str], classes: dict[str, int], held_out: DataFrame | None = None, calibrated: tuple[str, ...] = ("bicycle",), class_col: str = "class_id", **more: object) -> dict[str, Router | None]:
    """A router for each class, or None."""
    out = {}
    for name, k in classes.items():
        mine = held_out.filter(F.col(class_col) == k) if held_out is not None else None
        out[name] = train_class(rows.filter(F.col(class_col) == k), features, mine, calibrate=name in calibrated, **more)
    return out


def predict(rows: DataFrame, router: Router, features: list[str], name: str = "p") -> DataFrame:
    out = probability(vectors(rows, features), router.model, name).drop("__x__")
    if router.calibration:
        a, b = router.calibration
        out = out.withColumn(name, sigmoid(a * F.col(name) + b))
    return out


def save(routers: dict[str, Router | None], path: str) -> None:
    """One folder for each trained class, and a list of all of them."""
    for name, r in routers.items():
        if r is not None:
            r.model.write().overwrite().save(f"{path}/{name}")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/meta.json", "w") as f:
        json.dump({n: None if r is None else {"rounds": r.rounds, "calibration": r.calibration} for n, r in routers.items()}, f)


def load(path: str) -> dict[str, Router | None]:
    with open(f"{path}/meta.json") as f:
        meta = json.load(f)
    return {n: None if m is None else Router(GBTClassificationModel.load(f"{path}/{n}"), m["rounds"], tuple(m["calibration"]) if m["calibration"] else None) for n, m in meta.items()}

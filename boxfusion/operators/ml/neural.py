"""Neural routers: scoring by a feature-token transformer or a perceptron, in Arrow batches.

The forward passes need numpy only.  Weights come from wherever they were trained, by the names of
the arrays below; ``train_perceptron`` trains Spark's own perceptron where none are at hand."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.operators.ml.trees import vectors

#: Rows of one forward pass.
CHUNK = 8192


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + eps) * weight + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def attention(x: np.ndarray, w: dict[str, np.ndarray], heads: int) -> np.ndarray:
    b, s, d = x.shape
    q, k, v = np.split(x @ w["in_weight"].T + w["in_bias"], 3, axis=-1)
    q, k, v = (t.reshape(b, s, heads, d // heads).transpose(0, 2, 1, 3) for t in (q, k, v))
    mixed = softmax(q @ k.transpose(0, 1, 3, 2) / np.sqrt(d // heads)) @ v
    return mixed.transpose(0, 2, 1, 3).reshape(b, s, d) @ w["out_weight"].T + w["out_bias"]


def transformer(x: np.ndarray, w: dict, heads: int = 4) -> np.ndarray:
    """Logits: each feature is a token (weight * value + bias) behind a token of its own that is read
    out; layers normalise first; ReLU between the two linear maps of each."""
    tokens = x[:, :, None] * w["token_weight"] + w["token_bias"]
    h = np.concatenate([np.broadcast_to(w["cls"].reshape(1, 1, -1), (len(x), 1, tokens.shape[-1])), tokens], axis=1)
    for layer in w["layers"]:
        h = h + attention(layer_norm(h, layer["norm1_weight"], layer["norm1_bias"]), layer, heads)
        f = np.maximum(layer_norm(h, layer["norm2_weight"], layer["norm2_bias"]) @ layer["linear1_weight"].T + layer["linear1_bias"], 0)
        h = h + f @ layer["linear2_weight"].T + layer["linear2_bias"]
    return (layer_norm(h[:, 0], w["norm_weight"], w["norm_bias"]) @ w["head_weight"].T + w["head_bias"])[:, 0]


def perceptron(x: np.ndarray, w: dict) -> np.ndarray:
    """Logits: linear maps, each but the last with batch norm (running figures) and ReLU."""
    for layer in w["layers"]:
        x = x @ layer["weight"].T + layer["bias"]
        x = np.maximum((x - layer["mean"]) / np.sqrt(layer["var"] + 1e-5) * layer["scale"] + layer["shift"], 0)
    return (x @ w["head_weight"].T + w["head_bias"])[:, 0]


def initial_transformer(features: int, d: int = 64, layers: int = 3, factor: int = 4, seed: int = 42) -> dict:
    r = np.random.default_rng(seed)
    at = lambda *shape: r.normal(0, 1 / np.sqrt(shape[-1]), shape)
    one = lambda: {"in_weight": at(3 * d, d), "in_bias": np.zeros(3 * d), "out_weight": at(d, d), "out_bias": np.zeros(d), "norm1_weight": np.ones(d), "norm1_bias": np.zeros(d), "norm2_weight": np.ones(d), "norm2_bias": np.zeros(d), "linear1_weight": at(factor * d, d), "linear1_bias": np.zeros(factor * d), "linear2_weight": at(d, factor * d), "linear2_bias": np.zeros(d)}
    return {"token_weight": at(features, d), "token_bias": np.zeros((features, d)), "cls": r.normal(0, 0.02, d), "layers": [one() for _ in range(layers)], "norm_weight": np.ones(d), "norm_bias": np.zeros(d), "head_weight": at(1, d), "head_bias": np.zeros(1)}


@dataclass(frozen=True)
class NeuralRouter:
    """kind: "transformer" or "perceptron"; mean and std scale the features; knots, if any, are the
    points of an isotonic calibration of the probability."""

    kind: str
    weights: dict
    mean: np.ndarray
    std: np.ndarray
    heads: int = 4
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), CHUNK):
            z = (x[at : at + CHUNK].astype(np.float32) - self.mean) / np.where(self.std == 0, 1, self.std)
            logits = transformer(z, self.weights, self.heads) if self.kind == "transformer" else perceptron(z, self.weights)
            out[at : at + CHUNK] = 1 / (1 + np.exp(-logits))
        return out if self.knots is None else np.interp(out, *self.knots)


def save(routers: dict[str, NeuralRouter | None], path: str) -> None:
    """One file of arrays for each router, and a list of trained classes and of those without one."""
    os.makedirs(path, exist_ok=True)
    meta = {"trained": [], "fallback": [], "kinds": {}}
    for name, r in routers.items():
        if r is None:
            meta["fallback"].append(name)
            continue
        meta["trained"].append(name)
        meta["kinds"][name] = [r.kind, r.heads]
        flat = {k: v for k, v in r.weights.items() if k != "layers"} | {f"layer{n}.{k}": v for n, layer in enumerate(r.weights["layers"]) for k, v in layer.items()}
        knots = {} if r.knots is None else {"knots.x": r.knots[0], "knots.y": r.knots[1]}
        np.savez(f"{path}/{name}.npz", **flat, **{"scale.mean": r.mean, "scale.std": r.std}, **knots)
    with open(f"{path}/meta.json", "w") as f:
        json.dump(meta, f)


def load(path: str) -> dict[str, NeuralRouter | None]:
    with open(f"{path}/meta.json") as f:
        meta = json.load(f)
    out: dict[str, NeuralRouter | None] = dict.fromkeys(meta["fallback"])
    for name in meta["trained"]:
        a = dict(np.load(f"{path}/{name}.npz"))
        layers: dict[int, dict] = {}
        for k in [k for k in a if k.startswith("layer") and "." in k]:
            n, key = k.removeprefix("layer").split(".", 1)
            layers.setdefault(int(n), {})[key] = a.pop(k)
        mean, std = a.pop("scale.mean"), a.pop("scale.std")
        knots = (a.pop("knots.x"), a.pop("knots.y")) if "knots.x" in a else None
        kind, heads = meta["kinds"][name]
        out[name] = NeuralRouter(kind, a | {"layers": [layers[n] for n in sorted(layers)]}, mean, std, heads, knots)
    return out


def predict(rows: DataFrame, routers: dict[object, NeuralRouter], features: list[str], class_col: str = "class_name", name: str = "p") -> DataFrame:
    """``rows`` with the probability of their class's router, null without one.  All routers go to
    every task; each batch is scored class by class."""
    shared = rows.sparkSession.sparkContext.broadcast(routers)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = pd.Series(np.nan, index=b.index)
            for cls, at in b.groupby(class_col).groups.items():
                if cls in shared.value:
                    p[at] = shared.value[cls].predict(b.loc[at, features].to_numpy(np.float32))
            yield b.assign(**{name: p})

    out = rows.mapInPandas(run, schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def scaling(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations."""
    r = rows.agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)]).first()
    return np.array([r[f"m{k}"] for k in range(len(features))]), np.array([r[f"s{k}"] for k in range(len(features))])


def scaled(rows: DataFrame, features: list[str], mean: np.ndarray, std: np.ndarray) -> DataFrame:
    return rows.withColumns({f: (F.col(f) - float(m)) / float(s or 1.0) for f, m, s in zip(features, mean, std, strict=True)})


def isotonic(rows: DataFrame, p: str = "p", label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising calibration of ``p``; beyond them it stays level."""
    m = IsotonicRegression(featuresCol=p, labelCol=label, isotonic=True).fit(rows.select(F.col(p).cast("double").alias(p), F.col(label).cast("double").alias(label)))
    return np.array(m.boundaries.toArray()), np.array(m.predictions.toArray())


def calibrated(p: Column, knots: tuple[np.ndarray, np.ndarray]) -> Column:
    """The calibration as an expression."""
    x, y = (v.tolist() for v in knots)
    out = F.when(p <= x[0], F.lit(y[0]))
    for k in range(1, len(x)):
        share = (p - x[k - 1]) / (x[k] - x[k - 1]) if x[k] > x[k - 1] else F.lit(1.0)
        out = out.when(p <= x[k], y[k - 1] + share * (y[k] - y[k - 1]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out.otherwise(F.lit(y[-1]))))


def train_perceptron(rows: DataFrame, features: list[str], hidden: tuple[int, ...] = (256, 128, 64), rounds: int = 100, seed: int = 42, label: str = "label", min_positives: int = 20):
    """Spark's perceptron (sigmoid units, without weights or dropout) over scaled features: a function
    that adds ``p`` to rows; None with too few positives."""
    if (rows.agg(F.sum(label)).first()[0] or 0) < min_positives:
        return None
    mean, std = scaling(rows, features)
    make = lambda df: vectors(scaled(df, features, mean, std), features)
    model = MultilayerPerceptronClassifier(featuresCol="__x__", labelCol=label, layers=[len(features), *hidden, 2], maxIter=rounds, seed=seed).fit(make(rows))

    def score(df: DataFrame, name: str = "p") -> DataFrame:
        key = df.withColumn("__row__", F.struct(*df.columns))
        out = model.transform(make(key))
        return out.select("__row__.*", F.get(vector_to_array("probability"), F.lit(1)).alias(name))

    return score

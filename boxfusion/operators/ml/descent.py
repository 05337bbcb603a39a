"""Training of neural routers on all rows of all classes: each step is one Spark job.

A task sums loss and gradients over its rows, one vector for each class; the vectors are added in the JVM,
first in groups of tasks and then for each class, and the driver gets one vector for each class, whose length
is that of the weights.  No row goes to the driver, and the sums do not depend on how rows are parted.

A perceptron's layers are normalised by the figures of the steps before, which the same job sums for the next
step; so a step needs one reading of the rows, and its gradients are those of a fixed function.

Rows lie in blocks of one class and batch, as bytes, so that a step makes no object for each row."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.operators.ml import fitting
from boxfusion.operators.ml.neural import NeuralRouter, initial_transformer, isotonic, predict, softmax
from boxfusion.operators.state import cut

#: Rows of one forward and backward pass, and groups of tasks whose vectors are added first.
CHUNK, GROUPS = 1024, 32
#: Rows of a block, and of a task's blocks.
BLOCK, TASK = 1 << 13, 1 << 17
EPS = 1e-5


def arrays(kind: str, w: dict) -> list[tuple[dict, str]]:
    """Where the trained arrays of ``w`` are, in a fixed order."""
    fixed = ("mean", "var") if kind == "perceptron" else ()
    own = [(w, k) for k in w if k != "layers"]
    return own + [(layer, k) for layer in w["layers"] for k in layer if k not in fixed]


def flat(kind: str, w: dict) -> np.ndarray:
    return np.concatenate([d[k].ravel() for d, k in arrays(kind, w)])


def moved(kind: str, w: dict, values: np.ndarray) -> dict:
    """``w`` with the trained arrays of ``values``."""
    out, at = copy.deepcopy(w), 0
    for d, k in arrays(kind, out):
        d[k] = values[at : at + d[k].size].reshape(d[k].shape).copy()
        at += d[k].size
    return out


def _losses(z: np.ndarray, y: np.ndarray, positive: float) -> tuple[float, np.ndarray]:
    """The sum of the weighted cross entropy, and its slope at each logit."""
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return float(np.where(y > 0, positive * np.logaddexp(0, -z), np.logaddexp(0, z)).sum()), np.where(y > 0, positive * (p - 1), p)


def perceptron_sums(w: dict, x: np.ndarray, y: np.ndarray, positive: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows of loss, gradients, and each layer's values and their squares before normalisation."""
    held, seen = [], []
    for layer in w["layers"]:
        z = x @ layer["weight"].T + layer["bias"]
        seen += [z.sum(axis=0), (z * z).sum(axis=0)]
        root = np.sqrt(layer["var"] + EPS)
        even = (z - layer["mean"]) / root
        out = even * layer["scale"] + layer["shift"]
        held.append((x, even, root, out > 0))
        x = np.maximum(out, 0)
    loss, slope = _losses((x @ w["head_weight"].T + w["head_bias"])[:, 0], y, positive)
    found = {"head_weight": slope[None] @ x, "head_bias": slope.sum()[None], "layers": []}
    back = slope[:, None] @ w["head_weight"]
    for layer, (before, even, root, on) in zip(reversed(w["layers"]), reversed(held), strict=True):
        back = back * on
        plain = back * layer["scale"] / root
        found["layers"].insert(0, {"weight": plain.T @ before, "bias": plain.sum(axis=0), "scale": (back * even).sum(axis=0), "shift": back.sum(axis=0)})
        back = plain @ layer["weight"]
    return loss, _in_order("perceptron", w, found), np.concatenate(seen)


def _in_order(kind: str, w: dict, found: dict) -> np.ndarray:
    own = [found[k].ravel() for k in w if k != "layers"]
    return np.concatenate(own + [g[k].ravel() for layer, g in zip(w["layers"], found["layers"], strict=True) for d, k in [(layer, k) for k in layer] if k in g])


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=-1, keepdims=True)
    root = np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + EPS)
    return (x - mean) / root, root


def _norm_back(back: np.ndarray, weight: np.ndarray, even: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the input, weight and bias."""
    over = tuple(range(back.ndim - 1))
    b = back * weight
    return (b - b.mean(axis=-1, keepdims=True) - even * (b * even).mean(axis=-1, keepdims=True)) / root, (back * even).sum(axis=over), back.sum(axis=over)


def transformer_sums(w: dict, x: np.ndarray, y: np.ndarray, positive: float, heads: int) -> tuple[float, np.ndarray, np.ndarray]:
    """As ``perceptron_sums``; nothing is kept for normalisation."""
    n, width = len(x), w["cls"].size
    part = lambda t: t.reshape(n, -1, heads, width // heads).transpose(0, 2, 1, 3)
    whole = lambda t: t.transpose(0, 2, 1, 3).reshape(n, -1, width)
    tokens = x[:, :, None] * w["token_weight"] + w["token_bias"]
    h = np.concatenate([np.broadcast_to(w["cls"], (n, 1, width)), tokens], axis=1)
    held = []
    for layer in w["layers"]:
        even1, root1 = _norm(h)
        a = even1 * layer["norm1_weight"] + layer["norm1_bias"]
        q, k, v = (part(t) for t in np.split(a @ layer["in_weight"].T + layer["in_bias"], 3, axis=-1))
        share = softmax(q @ k.transpose(0, 1, 3, 2) / np.sqrt(width // heads))
        mixed = whole(share @ v)
        h = h + mixed @ layer["out_weight"].T + layer["out_bias"]
        even2, root2 = _norm(h)
        b = even2 * layer["norm2_weight"] + layer["norm2_bias"]
        f = np.maximum(b @ layer["linear1_weight"].T + layer["linear1_bias"], 0)
        h = h + f @ layer["linear2_weight"].T + layer["linear2_bias"]
        held.append((even1, root1, a, q, k, v, share, mixed, even2, root2, b, f))
    even, root = _norm(h[:, 0])
    read = even * w["norm_weight"] + w["norm_bias"]
    loss, slope = _losses((read @ w["head_weight"].T + w["head_bias"])[:, 0], y, positive)
    found: dict = {"head_weight": slope[None] @ read, "head_bias": slope.sum()[None], "layers": []}
    first, found["norm_weight"], found["norm_bias"] = _norm_back(slope[:, None] @ w["head_weight"], w["norm_weight"], even, root)
    back = np.zeros_like(h)
    back[:, 0] = first
    rows = lambda t: t.reshape(-1, t.shape[-1])
    for layer, (even1, root1, a, q, k, v, share, mixed, even2, root2, b, f) in zip(reversed(w["layers"]), reversed(held), strict=True):
        g = {"linear2_weight": rows(back).T @ rows(f), "linear2_bias": rows(back).sum(axis=0)}
        inner = (back @ layer["linear2_weight"]) * (f > 0)
        g |= {"linear1_weight": rows(inner).T @ rows(b), "linear1_bias": rows(inner).sum(axis=0)}
        into, g["norm2_weight"], g["norm2_bias"] = _norm_back(inner @ layer["linear1_weight"], layer["norm2_weight"], even2, root2)
        back = back + into
        g |= {"out_weight": rows(back).T @ rows(mixed), "out_bias": rows(back).sum(axis=0)}
        m = part(back @ layer["out_weight"])
        s = m @ v.transpose(0, 1, 3, 2)
        s = share * (s - (s * share).sum(axis=-1, keepdims=True)) / np.sqrt(width // heads)
        qkv = np.concatenate([whole(s @ k), whole(s.transpose(0, 1, 3, 2) @ q), whole(share.transpose(0, 1, 3, 2) @ m)], axis=-1)
        g |= {"in_weight": rows(qkv).T @ rows(a), "in_bias": rows(qkv).sum(axis=0)}
        into, g["norm1_weight"], g["norm1_bias"] = _norm_back(qkv @ layer["in_weight"], layer["norm1_weight"], even1, root1)
        back = back + into
        found["layers"].insert(0, g)
    found |= {"cls": back[:, 0].sum(axis=0), "token_bias": back[:, 1:].sum(axis=0), "token_weight": (back[:, 1:] * x[:, :, None]).sum(axis=0)}
    return loss, _in_order("transformer", w, found), np.zeros(0)


def filled(rows: DataFrame, routers: dict[object, NeuralRouter], features: list[str], by: str = "class_id") -> DataFrame:
    """``rows`` with null and NaN features set to the mean of their class, as in training, before ``neural.predict``."""

    def mean(at: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for k, r in routers.items() for v in (k, float(r.mean[at]))]), F.col(by))

    value = {f: F.col(f).cast("double") for f in features}
    return rows.withColumns({f: F.coalesce(F.when(~F.isnan(v), v), mean(k)) for k, (f, v) in enumerate(value.items())}) if routers else rows


@dataclass
class Fit:
    """One class's weights and the state of their training; ``held_losses``: before each epoch's first step."""

    kind: str
    w: dict
    heads: int
    positive: float
    rate: float
    best: dict = field(default_factory=dict)
    best_loss: float = np.inf
    since: int = 0
    stalled: int = 0
    steps: int = 0
    done: bool = False
    first: np.ndarray | None = None
    second: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return perceptron_sums(self.w, x, y, self.positive) if self.kind == "perceptron" else transformer_sums(self.w, x, y, self.positive, self.heads)

    def normalise(self, seen: np.ndarray, n: float, momentum: float) -> None:
        at = 0
        for layer in self.w["layers"] if self.kind == "perceptron" else []:
            size = layer["mean"].size
            mean = seen[at : at + size] / n
            var = np.maximum(seen[at + size : at + 2 * size] / n - mean**2, 0)
            layer["mean"] = layer["mean"] + momentum * (mean - layer["mean"])
            layer["var"] = layer["var"] + momentum * (var - layer["var"])
            at += 2 * size

    def step(self, gradient: np.ndarray, decay: float, clip: float) -> None:
        """One of Adam, the gradient's norm being at most ``clip``."""
        values = flat(self.kind, self.w)
        g = gradient * min(1.0, clip / (np.linalg.norm(gradient) + 1e-6)) + decay * values
        self.steps += 1
        self.first = 0.1 * g if self.first is None else self.first + 0.1 * (g - self.first)
        self.second = 0.001 * g * g if self.second is None else self.second + 0.001 * (g * g - self.second)
        m, v = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.999**self.steps)
        self.w = moved(self.kind, self.w, values - self.rate * m / (np.sqrt(v) + 1e-8))

    def judge(self, held_loss: float, patience: int, stall: int, least: float = 1e-4) -> None:
        """Keeps the best weights; halves the rate on a plateau and ends when patience does."""
        self.held_losses.append(held_loss)
        if held_loss < self.best_loss - least:
            self.best, self.best_loss, self.since, self.stalled = copy.deepcopy(self.w), held_loss, 0, 0
            return
        self.since, self.stalled = self.since + 1, self.stalled + 1
        if self.stalled > stall:
            self.rate, self.stalled = self.rate / 2, 0
        self.done = self.since >= patience


def pass_sums(rows: DataFrame, fits: dict, held: bool = True) -> dict:
    """By class (column ``by``): sums over ``rows`` (of ``blocks_of``) of gradients, loss and count of rows to fit, loss and
    count of rows held out, and figures for normalisation."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for row in b.itertuples():
                fit, every = shared.value[row.by], np.frombuffer(row.y)
                values = np.frombuffer(row.x).reshape(len(every), -1)
                for at in range(0, len(every), CHUNK):
                    loss, gradient, seen = fit.sums(values[at : at + CHUNK], every[at : at + CHUNK])
                    n = len(every[at : at + CHUNK])
                    found = [0 * gradient, [0, 0, loss, n], 0 * seen] if row.held else [gradient, [loss, n, 0, 0], seen]
                    found = np.concatenate(found)
                    total[row.by] = total[row.by] + found if row.by in total else found
        if total:
            yield pd.DataFrame({"by": list(total), "sums": list(total.values())})

    kind = rows.schema["by"].dataType.simpleString()
    at = rows.filter(F.col("by").isin(list(fits)) & (F.lit(True) if held else ~F.col("held")))
    each = at.mapInPandas(run, f"by {kind}, sums array<double>").select("by", (F.spark_partition_id() % GROUPS).alias("part"), array_to_vector("sums").alias("v"))
    for keys in (["by", "part"], ["by"]):
        each = each.groupBy(*keys).agg(Summarizer.metrics("sum").summary(F.col("v")).alias("v")).select(*keys, F.col("v.sum").alias("v"))
    out = {r["by"]: np.array(r["v"]) for r in each.select("by", vector_to_array("v").alias("v")).collect()}  # one row for each class
    shared.unpersist()
    return out


def blocks_of(rows: DataFrame, count: int) -> DataFrame:
    """(by, held, batch, x, y): blocks of ``rows`` (as of ``prepare``, without nulls in x, ``count`` of them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}

        def block(key: tuple) -> dict:
            b = pd.concat(kept.pop(key))
            by, held, batch = key
            return {"by": by, "held": held, "batch": batch, "x": np.stack(b["x"].to_numpy()).astype(float).tobytes(), "y": b["y"].to_numpy(float).tobytes()}

        for b in batches:
            for key, some in b.groupby(["by", "held", "batch"]):
                kept.setdefault(key, []).append(some)
            full = [key for key, some in kept.items() if sum(map(len, some)) >= BLOCK]
            if full:
                yield pd.DataFrame([block(key) for key in full])
        if kept:
            yield pd.DataFrame([block(key) for key in list(kept)])

    made = rows.mapInPandas(run, f"by {rows.schema['by'].dataType.simpleString()}, held boolean, batch int, x binary, y binary")
    return made.repartition(max(1, -(-count // TASK)))  # as many tasks a step as rows ask for


def prepare(rows: DataFrame, features: list[str], by: str, key: list[str], label: str, batches: int, seed: int) -> DataFrame:
    """(by, x, y, held, batch): a tenth held out and the rest dealt into batches, by a hash of the key."""
    hashed = F.xxhash64(F.lit(seed), *key)
    x = F.array(*[F.col(f).cast("double") for f in features])
    known = F.transform(x, lambda v: F.when(~F.isnan(v), v))
    return rows.filter(F.col(by).isNotNull() & F.col(label).isNotNull()).select(
        F.col(by).alias("by"), known.alias("x"), F.col(label).cast("double").alias("y"), (F.pmod(hashed, F.lit(10)) == 0).alias("held"), F.pmod(F.shiftright(hashed, 20), F.lit(batches)).cast("int").alias("batch")
    )


def train(
    rows: DataFrame, features: list[str], by: str = "class_id", key: list[str] | None = None, kind: str = "perceptron", shape: dict | None = None, label: str = "label", epochs: int = 60, batches: int = 1, rate: float = 1e-2,
    decay: float = 1e-4, clip: float = 1.0, patience: int = 10, stall: int = 3, momentum: float = 0.5, min_positives: int = 20, seed: int = 42,
) -> tuple[dict[object, NeuralRouter], dict[object, Fit]]:
    """A router, and its training, for each class with ``min_positives`` positives among the rows to fit and a row held out.

    ``shape``: of ``initial`` (hidden) or ``initial_transformer``.  An epoch is ``batches`` steps, each a job over its part of
    the rows.  The held-out loss, taken with an epoch's first step, halves the rate when it stalls, ends the training and
    chooses the weights; the isotonic calibration is fitted on the same rows.  Null and NaN features count as the
    mean (``filled`` for scoring); rows without class or label are left out; repeated rows count as often as they come; an empty table
    gives no routers.  Without dropout, whose draws would hang on how rows are parted."""
    if kind not in ("perceptron", "transformer"):
        raise ValueError(f"unknown kind {kind}")
    ready = cut(prepare(rows, features, by, key or [*features, label], label, batches, seed))
    to_fit = ~F.col("held")
    columns = [F.when(to_fit, F.get("x", F.lit(k))) for k in range(len(features))]
    figures = ready.groupBy("by").agg(
        F.count_if(to_fit).alias("n"), F.count_if("held").alias("n_held"), F.sum(F.when(to_fit, F.col("y"))).alias("positives"),
        F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in columns]).alias("mean"), F.array(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in columns]).alias("std"),
    )
    fits, scale, count = {}, {}, 0
    for r in figures.collect():  # one row for each class
        count += r["n"] + r["n_held"]
        if (r["positives"] or 0) < min_positives or not r["n_held"]:
            continue
        w = fitting.initial(len(features), (shape or {}).get("hidden", (256, 128, 64)), seed) if kind == "perceptron" else initial_transformer(len(features), **(shape or {}), seed=seed)
        fits[r["by"]] = Fit(kind, w, (shape or {}).get("heads", 4), (r["n"] - r["positives"]) / r["positives"], rate)
        scale[r["by"]] = np.array(r["mean"]), np.where(np.array(r["std"]) == 0, 1, np.array(r["std"]))
    if not fits:
        return {}, {}

    named = F.create_map(*[v for k, (m, s) in scale.items() for v in (F.lit(k), F.arrays_zip(F.array(*map(F.lit, m.tolist())).alias("m"), F.array(*map(F.lit, s.tolist())).alias("s")))])
    even = F.zip_with("x", F.element_at(named, F.col("by")), lambda v, z: F.coalesce((v - z["m"]) / z["s"], F.lit(0.0)))
    scaled = ready.filter(F.col("by").isin(list(fits))).withColumn("x", even)
    ready = cut(blocks_of(scaled, count))

    def split(key: object, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = flat(kind, fits[key].w).size
        return v[:size], v[size : size + 4], v[size + 4 :]

    if kind == "perceptron":  # layer by layer, as each one's figures hang on the ones before
        for _ in next(iter(fits.values())).w["layers"]:
            for k, v in pass_sums(ready, fits, held=False).items():
                _, (_, n, _, _), seen = split(k, v)
                fits[k].normalise(seen, n, 1.0)
    for _ in range(epochs):
        for batch in range(batches):
            going = {k: f for k, f in fits.items() if not f.done}
            if not going:
                break
            part = ready if batches == 1 else ready.filter((F.col("batch") == batch) | (F.col("held") & F.lit(batch == 0)))
            for k, v in pass_sums(part, going, held=batch == 0).items():
                gradient, (loss, n, held_loss, n_held), seen = split(k, v)
                f = fits[k]
                if batch == 0 and n_held:
                    f.judge(held_loss / n_held, patience, stall)
                if n and not f.done:
                    f.losses.append(loss / n)
                    f.step(gradient / n, decay, clip)
                    f.normalise(seen, n, momentum)
    out = {k: NeuralRouter(kind, f.best, np.zeros(len(features)), np.ones(len(features)), f.heads) for k, f in fits.items()}
    held = scaled.filter("held").select("by", "y", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(len(features))])
    scored = cut(predict(held, out, [f"x{k}" for k in range(len(features))], "by").select("by", "p", "y"))
    for k, router in out.items():
        mean, std = scale[k]
        out[k] = replace(router, mean=mean, std=std, knots=isotonic(scored.filter(F.col("by") == k), "p", "y"))
    return out, fits
